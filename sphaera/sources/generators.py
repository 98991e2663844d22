"""Synthetic surfaces: deterministic, distributed, any number of points.

Points come from spark.range and the portable generator, so a point depends on
its number and the seed alone, not on partitions, and every engine gets the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import gaussian, settled, uniform
from .clouds import AXES

SQRT3 = 1.7320508075688772


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"{name} must be positive")


def _whole(n: int) -> None:
    if not (isinstance(n, int) and n > 0):
        raise ValueError("n must be a positive integer")


def _pick(k: Column, *cases: Column) -> Column:
    out = F.when(k == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(k == i, c)
    return out


def _ids(spark: SparkSession, n: int) -> DataFrame:
    _whole(n)
    return spark.range(n).withColumnRenamed("id", "point_id")


def cube(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Faces of [-1, 1]**3 in turn: z, x and y, positive before negative."""
    p = _ids(spark, n).withColumns({"u": uniform(seed, 0, F.col("point_id")) * 2 - 1, "v": uniform(seed, 1, F.col("point_id")) * 2 - 1, "k": F.col("point_id") % 6})
    k, u, v = F.col("k"), F.col("u"), F.col("v")
    one, minus = F.lit(1.0), F.lit(-1.0)
    return p.select("point_id", _pick(k, u, u, one, minus, u, u).alias("x"), _pick(k, v, v, u, u, one, minus).alias("y"), _pick(k, one, minus, v, v, v, v).alias("z"))


def cylinder(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Caps z = 1 and -1 (drawn in the square, kept in the disc) and sides x = +-sqrt(1 - y**2), y = +-sqrt(1 - x**2).

    Candidates are drawn three times over; those rejected leave no gap, as ids
    count accepted points in candidate order.
    """
    _whole(n)
    total = 2 * n + 64
    c = spark.range(total).withColumnRenamed("id", "c")
    c = c.withColumns({"u": uniform(seed, 0, F.col("c")) * 2 - 1, "v": uniform(seed, 1, F.col("c")) * 2 - 1, "k": F.col("c") % 6})
    k, u, v = F.col("k"), F.col("u"), F.col("v")
    one, minus, arc = F.lit(1.0), F.lit(-1.0), F.sqrt(F.greatest(F.lit(0.0), 1 - u * u))
    ok = (k > 1) | (u * u + v * v <= 1)
    p = c.filter(ok).select("c", _pick(k, u, u, arc, -arc, u, u).alias("x"), _pick(k, v, v, u, u, arc, -arc).alias("y"), _pick(k, one, minus, v, v, v, v).alias("z"))
    return number_first(p, "c", n)


def number_first(p: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by order, numbered from 0: counts per block of order, then ranks within blocks.

    No task sorts more than a block, and only the blocks' counts meet.
    """
    from pyspark.sql import Window

    size = 1 << 16
    p = p.withColumn("__block", F.floor(F.col(order) / size))
    counts = p.groupBy("__block").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = p.withColumn("__rank", F.row_number().over(Window.partitionBy("__block").orderBy(order)))
    out = ranked.join(before, "__block").withColumn("point_id", F.col("__before") + F.col("__rank") - 1)
    return out.filter(F.col("point_id") < n).select("point_id", *AXES)


def hexagon_prism(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Circumradius 1: three rhombi on each of z = +-1, then opposite pairs of side walls."""
    p = _ids(spark, n).withColumns({"u": uniform(seed, 0, F.floor(F.col("point_id") / 2)), "v": uniform(seed, 1, F.floor(F.col("point_id") / 2)), "k": F.col("point_id") % 12})
    k, u, v = F.col("k"), F.col("u"), F.col("v")
    h = SQRT3 / 2
    # rhombus j is spanned by the corners at 120 j and 120 (j + 1) degrees
    corner = [(1.0, 0.0), (-0.5, h), (-0.5, -h)]
    xs, ys, zs = [], [], []
    for j in range(3):
        (a, b), (c, d) = corner[j], corner[(j + 1) % 3]
        for side in (1.0, -1.0):
            xs.append(u * a + v * c)
            ys.append(u * b + v * d)
            zs.append(F.lit(side))
    # wall j joins the corners at 60 j and 60 (j + 1) degrees; its pair is opposite
    walls = [((1.0, 0.0), (0.5, h)), ((0.5, h), (-0.5, h)), ((-0.5, h), (-1.0, 0.0))]
    for (a, b), (c, d) in walls:
        for side in (1.0, -1.0):
            xs.append((u * a + (1 - u) * c) * side)
            ys.append((u * b + (1 - u) * d) * side)
            zs.append(v * 2 - 1)
    return p.select("point_id", _pick(k, *xs).alias("x"), _pick(k, *ys).alias("y"), _pick(k, *zs).alias("z"))


def sphere(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Gaussian directions of length one."""
    p = _ids(spark, n).withColumns({a: gaussian(seed + 2 * i, i, F.col("point_id")) for i, a in enumerate(AXES)})
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return p.select("point_id", *[(F.col(a) / r).alias(a) for a in AXES])


def ellipsoid(spark: SparkSession, n: int, a: float, b: float, c: float, seed: int = 1, mode: str = "reference") -> DataFrame:
    """Directions u accepted with probability w / bound, then u / sqrt(D) with D = sum (u / axis)**2, S = sum u**2 / axis**4.

    ``reference`` takes w = D**2 / sqrt(S), which is what the surveyed generator
    does; ``area`` takes its reciprocal, the area element, which is uniform.
    """
    _whole(n)
    _positive(a=a, b=b, c=c)
    if mode not in ("reference", "area"):
        raise ValueError("mode must be reference or area")
    axes = (a, b, c)

    def weighted(p: DataFrame) -> DataFrame:
        d = sum(F.col(v) ** 2 / s**2 for v, s in zip(AXES, axes))
        s4 = sum(F.col(v) ** 2 / s**4 for v, s in zip(AXES, axes))
        w = d * d / F.sqrt(s4)
        return p.withColumns({"d": d, "w": w if mode == "reference" else 1 / w})

    def candidates(count: int, own: int) -> DataFrame:
        return settled(weighted(settled(sphere(spark, count, own))))

    bound = candidates(20_000, seed + 100).agg((F.max("w") * 1.10).alias("bound"))
    most = float(bound.first()[0])
    # the mean of w tells how many candidates n points take
    share = float(candidates(20_000, seed + 200).agg(F.avg("w")).first()[0]) / most
    total = int(n / share * 1.2) + 256
    p = candidates(total, seed).withColumn("r", uniform(seed + 50, 9, F.col("point_id"))).filter(F.col("r") < F.col("w") / most)
    p = p.select(F.col("point_id").alias("c"), *[(F.col(v) / F.sqrt("d")).alias(v) for v in AXES])
    return number_first(p, "c", n)


def outliers(spark: SparkSession, n: int, s: float = 2.0, seed: int = 1) -> DataFrame:
    """Uniform in [-s, s]**3."""
    return _ids(spark, n).select("point_id", *[((uniform(seed, i, F.col("point_id")) * 2 - 1) * s).alias(a) for i, a in enumerate(AXES)])


def jittered(cloud: DataFrame, sigma: float = 0.007, seed: int = 1) -> DataFrame:
    """Gaussian noise on each axis."""
    return cloud.withColumns({a: F.col(a) + gaussian(seed + 2 * i, i, F.col("point_id")) * sigma for i, a in enumerate(AXES)})
