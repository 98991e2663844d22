"""Point clouds: sources, cleaning and normalisation.

A cloud is a DataFrame of point_id, x, y, z (and gt where the truth is known).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import EPS, finite

AXES = ("x", "y", "z")


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of each vector; label comes along."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("point_id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate(AXES)], "label")


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax, each scaled to its range."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return t.select(key.alias("point_id"), (F.col("l_quantity") / 50.0).alias("x"), (F.col("l_discount") / 0.1 + 0.0).alias("y"), (F.col("l_tax") / 0.08 + 0.0).alias("z"))


def finite_rows(cloud: DataFrame) -> DataFrame:
    """Drops rows with a coordinate that is null, NaN or infinite."""
    keep = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    return cloud.filter(keep)


def centroid(cloud: DataFrame) -> DataFrame:
    """One row: cx, cy, cz."""
    return cloud.agg(*[F.avg(a).alias(f"c{a}") for a in AXES])


def centred(cloud: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Minus the centroid (or another row of cx, cy, cz), a broadcast of one row."""
    both = cloud.join(F.broadcast(centroid(cloud) if at is None else at))
    return both.select(*[(F.col(c) - F.col(f"c{c}")).alias(c) if c in AXES else F.col(c) for c in cloud.columns])


def scaled(cloud: DataFrame) -> DataFrame:
    """Divided by the largest absolute coordinate, if that is more than eps."""
    top = cloud.agg(F.max(F.greatest(*[F.abs(a) for a in AXES])).alias("__top"))
    both = cloud.join(F.broadcast(top))
    return both.select(*[F.when(F.col("__top") > EPS, F.col(c) / F.col("__top")).otherwise(F.col(c)).alias(c) if c in AXES else F.col(c) for c in cloud.columns])


def normalised(cloud: DataFrame) -> DataFrame:
    """Finite rows, centred, scaled to one: scaled(centred(...)) with one pass for both.

    The largest distance from the centroid on an axis is that of its least or
    largest value, so means and extremes of one aggregation are all it takes.
    """
    good = finite_rows(cloud)
    stats = good.agg(*[f(a).alias(f"__{n}{a}") for a in AXES for n, f in (("c", F.avg), ("l", F.min), ("h", F.max))])
    both = good.join(F.broadcast(stats))
    top = F.greatest(*[F.greatest(F.col(f"__h{a}") - F.col(f"__c{a}"), F.col(f"__c{a}") - F.col(f"__l{a}")) for a in AXES])
    own = {a: F.col(a) - F.col(f"__c{a}") for a in AXES}
    return both.select(*[F.when(top > EPS, own[c] / top).otherwise(own[c]).alias(c) if c in AXES else F.col(c) for c in cloud.columns])


def shifted(cloud: DataFrame, displacement: tuple[float, float, float]) -> DataFrame:
    return cloud.withColumns({a: F.col(a) - float(d) for a, d in zip(AXES, displacement)})


def summary(cloud: DataFrame) -> DataFrame:
    """Rows, and least and largest value of each axis."""
    return cloud.agg(F.count("*").alias("n_points"), *[f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def concatenated(inliers: DataFrame, outliers: DataFrame, n_in: int, n_out: int) -> DataFrame:
    """The first n_in inliers, then the first n_out outliers, renumbered; gt marks inliers."""
    a = inliers.filter(F.col("point_id") < n_in).select("point_id", *AXES, F.lit(True).alias("gt"))
    b = outliers.filter(F.col("point_id") < n_out).select((F.col("point_id") + n_in).alias("point_id"), *AXES, F.lit(False).alias("gt"))
    return a.unionByName(b)


def register(cloud: DataFrame, name: str) -> None:
    cloud.createOrReplaceTempView(name)


def lookup(spark: SparkSession, name: str) -> DataFrame | None:
    """A registered cloud, or None if there is none of that name."""
    return spark.table(name) if spark.catalog.tableExists(name) else None
