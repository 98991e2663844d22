"""Statistics over iteration logs: histograms, exceedance, running state, look-ups.

Running values of a key are computed by blocks of its order: a block's sum, largest or
least value meets those of the blocks before, and a window runs within the block. So a
key may hold any share of the rows, and no task sorts more than a block of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import REALMIN, finite, hazen


def finite_values(log: DataFrame, value: str) -> DataFrame:
    return log.filter(finite(F.col(value)))


def histogram_edges(values: DataFrame, value: str) -> DataFrame:
    """One row: n, low, width of Freedman-Diaconis bins (2 IQR n**(-1/3)), on the pooled values."""
    q = hazen(values, [], value, [25, 75])
    s = finite_values(values, value).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    both = s.join(F.broadcast(q))
    return both.select("n", "low", "high", (2 * (F.col("p75") - F.col("p25")) * F.pow(F.col("n").cast("double"), F.lit(-1 / 3))).alias("width"))


def histogram_fd(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bin, n: counts per series in shared bins."""
    edges = histogram_edges(values, value)
    both = finite_values(values, value).join(F.broadcast(edges))
    at = F.when(F.col("width") > 0, F.floor((F.col(value) - F.col("low")) / F.col("width"))).otherwise(F.lit(0))
    return both.select(*keys, at.cast("long").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def histogram_fixed(values: DataFrame, keys: list[str], value: str, bins: int = 60) -> DataFrame:
    """keys, bin (1 to bins), n with empty bins: equal bins between each series' least and largest value."""
    good = finite_values(values, value)
    span = good.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins), F.floor((F.col(value) - F.col("low")) / ((F.col("high") - F.col("low")) / bins)) + 1)).otherwise(F.lit(1))
    counts = good.join(span, keys).select(*keys, at.cast("int").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    grid = span.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def exceedance(values: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """keys, alpha, p: share of finite values above alpha (strict); one pass, the thresholds unfold after it."""
    good = finite_values(values, value)
    sums = good.groupBy(*keys).agg(*[F.avg((F.col(value) > float(t)).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    cells = F.array(*[F.struct(F.lit(float(t)).alias("alpha"), F.col(f"t{i}").alias("p")) for i, t in enumerate(thresholds)])
    return sums.select(*keys, F.inline(cells))


def iterations_for(p: Column, conf: float) -> Column:
    """ceil(ln(1 - conf) / ln(1 - p)): 1 at p = 1, null at p = 0."""
    rest = F.ln(F.greatest(F.lit(REALMIN), 1.0 - p))
    return F.when(p > 0, F.ceil(F.log(F.lit(1.0 - conf)) / F.when(rest < 0, rest))).cast("double")


def pivot_thresholds(rates: DataFrame, by: str, names: list) -> DataFrame:
    """alpha and one column for each name: the matrix behind a plot of curves."""
    return rates.groupBy("alpha").pivot(by, names).agg(F.first("p"))


#: Numbers of the order column (iterations) in a block.
BLOCK = 1 << 16


def by_blocks(log: DataFrame, keys: list[str], order: str, sums: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """log with, for each name, the total of its aggregate over the blocks before (null in the first), and the keys of a block.

    The aggregates are sums, or largest or least values (max, min); order is a number.
    """
    log = log.withColumn("__block", F.floor(F.col(order) / BLOCK))
    blocks = log.groupBy(*keys, "__block").agg(*[c.alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"max": F.max, "min": F.min}
    own = [*keys, "__block"]
    # each block gets its sums by a row of its own, which costs no join: rows meet by block anyway
    carried = blocks.select(*own, *[fold.get(n.split("_")[0], F.sum)(n).over(w).alias(n) for n in sums], F.lit(True).alias("__carrier"))
    both = log.withColumn("__carrier", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    block = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumns({n: F.max(n).over(block) for n in sums}).filter("NOT __carrier")
    return both.select(*log.columns, *sums), own


def running(log: DataFrame, keys: list[str], order: str, value: str, floor: float) -> DataFrame:
    """best: largest value before each row, at least floor, and gate: whether the row reaches it."""
    good = F.when(~F.isnan(value), F.col(value))
    both, own = by_blocks(log, keys, order, {"max_before": F.max(good)})
    w = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.lit(floor), F.col("max_before"), F.max(good).over(w))  # nulls are left out
    return both.withColumn("best", best).withColumn("gate", F.col(value) >= F.col("best")).drop("__block", "max_before")


def running_weight(log: DataFrame, keys: list[str], order: str, score: str, value: str, first: float = 0.33, mass: float = 4.6) -> DataFrame:
    """omega after each row: (mass first + sum score value) / (mass + sum score), the closed form of the recursion."""
    product = F.col(score) * F.col(value)
    both, own = by_blocks(log, keys, order, {"sum_product": F.sum(product), "sum_score": F.sum(score)})
    w = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda name, c: F.coalesce(F.col(name), F.lit(0.0)) + F.coalesce(F.sum(c).over(w), F.lit(0.0))
    omega = (mass * first + upto("sum_product", product)) / (mass + upto("sum_score", F.col(score)))
    return both.withColumn("omega", omega).drop("__block", "sum_product", "sum_score")


def running_limit(log: DataFrame, keys: list[str], order: str, share: str, k: int, conf: float, limit: float) -> DataFrame:
    """max_iter after each row: least of the limit and twice the theoretical number so far."""
    inner = F.greatest(F.lit(REALMIN), F.least(F.lit(1 - 1e-12), 1.0 - F.pow(F.col(share), F.lit(k))))
    log = log.withColumn("__own", (2 * F.ceil(F.log(F.lit(1.0 - conf)) / F.log(inner))).cast("double"))
    both, own = by_blocks(log, keys, order, {"min_before": F.min("__own")})
    w = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("max_iter", F.least(F.lit(float(limit)), F.col("min_before"), F.min("__own").over(w))).drop("__block", "__own", "min_before")


def ranked(log: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """name: the row's number in its key, from 1 on, in the order."""
    both, own = by_blocks(log, keys, order, {"sum_rows": F.count("*")})
    at = F.row_number().over(Window.partitionBy(*own).orderBy(order))
    return both.withColumn(name, F.coalesce("sum_rows", F.lit(0)) + at).drop("__block", "sum_rows")


def moving_average(log: DataFrame, keys: list[str], order: str, value: str, first: float | Column, keep: float = 0.8) -> DataFrame:
    """w after each row of w <- keep w + (1 - keep) value, from first on: a number, or a column that is the same in all rows of a key.

    Rows go in blocks of L, with keep**L below 1e-20. Within a block, the i-th row adds
    (1 - keep) keep**i sum keep**-j value_j to keep**i times the value before the block. That is
    the last value of the block before, whose own predecessor weighs less than a double resolves.
    """
    size = max(1, math.ceil(math.log(1e-20) / math.log(keep)))
    at = F.col("__n") - 1
    rows = ranked(log, keys, order, "__n").withColumn("__part", F.floor(at / size)).withColumn("__i", (at % size + 1).cast("double"))
    w = Window.partitionBy(*keys, "__part").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    decay = lambda i: F.pow(F.lit(keep), i)
    rows = rows.withColumn("__w", F.lit(1 - keep) * decay(F.col("__i")) * F.sum(decay(-F.col("__i")) * F.col(value)).over(w))
    ends = rows.filter(F.col("__i") == size).select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], (F.col("__part") + 1).alias("__next"), F.col("__w").alias("__end"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)] + [F.col("__part") == F.col("__next")]
    both = rows.join(ends, on, "left")
    first = first if isinstance(first, Column) else F.lit(float(first))
    start = F.when(F.col("__part") == 0, first).otherwise(F.col("__end") + F.when(F.col("__part") == 1, first * keep**size).otherwise(0.0))
    return both.select(*log.columns, (F.col("__w") + decay(F.col("__i")) * start).alias("w"))


def last_valid(log: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows up to the last one whose value is no NaN."""
    last = log.groupBy(*keys).agg(F.max(F.when(~F.isnan(value) & F.col(value).isNotNull(), F.col(order))).alias("__last"))
    return log.join(last, keys).filter(F.col(order) <= F.col("__last")).drop("__last")


def best_row(log: DataFrame, keys: list[str], order: str, value: str, floor: float | None = None, late: bool = True) -> DataFrame:
    """The row with the largest value; among equal ones the last (or the first)."""
    good = log.filter(finite(F.col(value)))
    if floor is not None:
        good = good.filter(F.col(value) >= floor)
    tie = F.col(order) if late else -F.col(order)
    cells = F.struct(F.col(value).alias("v"), tie.alias("t"), F.struct(*log.columns).alias("row"))
    return good.groupBy(*keys).agg(F.max(cells).alias("m")).select("m.row.*")


def above_percentile(log: DataFrame, keys: list[str], value: str, percent: float, factor: float = 1.0) -> DataFrame:
    """Rows whose value is at least factor times the percentile of their key."""
    p = hazen(log, keys, value, [percent])
    name = [c for c in p.columns if c not in keys][0]
    return log.join(p, keys).filter(F.col(value) >= factor * F.col(name)).drop(name)


def _cell(value: Column, tolerance: float) -> Column:
    """Cells somewhat wider than twice the tolerance, so that a value's band meets two of them as a rule."""
    return F.floor(value / (2 * tolerance * (1 + 1e-6)))


def _in_band(wanted: DataFrame, results: DataFrame, exact: list[str], near: dict[str, float]) -> DataFrame:
    """Rows of wanted with each of results (columns r_...) that has equal exact keys and near ones within tolerance.

    A hash join on the exact keys and the near keys' cells: a result is in one cell of each key, a wanted
    row goes to those that its band meets. The check itself follows as the residual condition.
    """
    if any(t <= 0 for t in near.values()):
        return wanted.join(results.limit(0).select(*[F.col(c).alias(f"r_{c}") for c in results.columns]))
    right = results.select(*[F.col(c).alias(f"r_{c}") for c in results.columns], *[_cell(F.col(c), t).alias(f"__r{k}") for k, (c, t) in enumerate(near.items())])
    left = wanted
    for k, (c, t) in enumerate(near.items()):
        v = F.col(c).cast("double")
        reach = F.lit(t * (1 + 1e-9)) + F.abs(v) * 4e-16  # what rounding may add
        left = left.filter(finite(v)).withColumn(f"__w{k}", F.explode(F.sequence(_cell(v - reach, t), _cell(v + reach, t))))
    on = [left[c] == right[f"r_{c}"] for c in exact] + [left[f"__w{k}"] == right[f"__r{k}"] for k in range(len(near))]
    on += [F.abs(left[c] - right[f"r_{c}"]) < t for c, t in near.items()]
    return left.join(right, on).drop(*[f"__{s}{k}" for k in range(len(near)) for s in "wr"])


def look_up(wanted: DataFrame, results: DataFrame, exact: list[str], near: dict[str, float], order: str) -> DataFrame:
    """For each (different) wanted row the last result with equal exact keys and near ones within tolerance.

    Of results with the same keys only the last can be found, so repeats of one experiment are
    one row before they are joined. Null, NaN and infinite keys find nothing, nor does a tolerance of zero.
    """
    keys = [*exact, *near]
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*results.columns), order).alias("__r")).select("__r.*")
    both = _in_band(wanted, last, exact, near)
    found = F.max_by(F.struct(*[f"r_{c}" for c in results.columns]), f"r_{order}").alias("__r")
    return both.groupBy(*wanted.columns).agg(found).select(*wanted.columns, "__r.*")


def misses(wanted: DataFrame, results: DataFrame, exact: list[str], near: dict[str, float]) -> DataFrame:
    """Wanted rows without such a result."""
    keys = [*exact, *near]
    hits = _in_band(wanted.select(*keys).distinct(), results.select(*keys).distinct(), exact, near).select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct()
    return wanted.join(hits, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left_anti")


def strength_tag(strength: Column) -> Column:
    """OLS for 0, else the number as 2e-03 with its exponent shortened: 2m3."""
    raw = F.format_string("%.0e", strength)
    return F.when(strength == 0, F.lit("OLS")).otherwise(F.regexp_replace(F.regexp_replace(raw, r"e\+0*", "e"), "e-0*", "m"))
