"""Solver state of iteration logs, carried from one batch to the next.

A configuration's state after some iterations is a few numbers: last iteration, best score,
score mass, inlier weight w and the bound on iterations. ``advance`` gives every row of a
batch its state, starting from what the batches before left, so any split of a log into
batches that follow each other gives the rows that the whole log gives. Rows of one
configuration are not one task's: the batch is cut into blocks of iterations, whose sums
meet the blocks after them (see operators.analysis).

``follow`` does that for a file stream. Each batch writes folders of its own and reads the
state of the batch before, so a batch that runs again after a failure replaces itself.

Defined cases: of rows that repeat configuration and iteration within a batch the one with
the largest score (then share) counts; rows without an iteration, and rows whose iteration is
not after the last one of their configuration, come late and are set aside; a score or share
that is null, NaN or infinite updates nothing and its row carries the state on; a null
configuration is one of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.portable import REALMIN, finite
from ..functions.shared import exists, work_path
from ..operators.analysis import BLOCK, moving_average

LOG = "config string, iter bigint, score double, share double"
STATE = "config string, last_iter bigint, n_rows bigint, best double, mass double, w double, max_iter double"
ROWS = "config string, iter bigint, score double, share double, best double, gate boolean, mass double, w double, max_iter double"


@dataclass(frozen=True)
class Rule:
    """Fixed values of the estimator and its parameters: floor of the best score, share of it that a row must reach, first mass and w."""

    floor: float = 0.13
    update_thresh: float = 0.55
    first_mass: float = 4.6
    min_inlier_ratio: float = 0.65
    ema: float = 0.8
    sample_size: int = 6
    conf: float = 0.96
    limit: float = 2000.0


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, f"state-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How the aggregates of the blocks before are put together, by the first word of their name.
_FOLD = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}


def _with_blocks(log: DataFrame, state: DataFrame | None = None, **aggregates: Column) -> tuple[DataFrame, Window]:
    """log with each aggregate of its configuration's earlier blocks, and the state's columns as start_<name>; the window of a block."""
    log = log.withColumn("__block", F.floor(F.col("iter") / BLOCK))
    blocks = log.groupBy("config", "__block").agg(*[c.alias(n) for n, c in aggregates.items()], F.count("*").alias("__rows"))
    w = Window.partitionBy("config").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    names = list(aggregates)
    before = blocks.select("config", "__block", *[_FOLD[n.split("_")[0]](n).over(w).alias(n) for n in names])
    if state is not None:
        own = [c for c in state.columns if c != "config"]
        start = state.select(F.col("config").alias("__of"), *[F.col(c).alias(f"start_{c}") for c in own])
        before = before.join(start, F.col("config").eqNullSafe(F.col("__of")), "left").drop("__of")
        names += [f"start_{c}" for c in own]
    # a row of its own brings a block what comes before it, as its rows meet anyway
    both = log.withColumn("__carrier", F.lit(False)).unionByName(before.withColumn("__carrier", F.lit(True)), allowMissingColumns=True)
    block = Window.partitionBy("config", "__block").orderBy("iter")
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumns({n: F.max(n).over(whole) for n in names}).filter("NOT __carrier")
    return both.select(*log.columns, *names), block


def _least_rows(share: Column, rule: Rule) -> Column:
    """Twice the number of draws that the share of inliers implies."""
    inner = F.greatest(F.lit(REALMIN), F.least(F.lit(1 - 1e-12), 1.0 - F.pow(share, F.lit(rule.sample_size))))
    return (2 * F.ceil(F.log(F.lit(1.0 - rule.conf)) / F.log(inner))).cast("double")


def advance(log: DataFrame, state: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their state, late rows, and the state after them, of a batch (config, iter, score, share) and the state before."""
    upto, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    placed = log.filter("iter IS NOT NULL").groupBy("config", "iter").agg(F.max(F.struct("score", "share")).alias("v")).select("config", "iter", "v.*")
    placed, _ = _with_blocks(placed, state)
    placed = _stored(placed.drop("__block"), "placed")
    is_late = F.coalesce(F.col("iter") <= F.col("start_last_iter"), F.lit(False))
    late = log.filter("iter IS NULL").unionByName(placed.filter(is_late).select(*log.columns))
    rows = placed.filter(~is_late)

    good = F.when(finite(F.col("score")), F.col("score"))
    rows, own = _with_blocks(rows, max_before=F.max(good))
    best = F.greatest(F.lit(rule.floor), F.col("start_best"), F.col("max_before"), F.max(good).over(own.rowsBetween(*before)))
    rows = rows.withColumn("best", best).withColumn("gate", F.coalesce(good >= F.col("best") * rule.update_thresh, F.lit(False)))
    rows = _stored(rows.drop("__block", "max_before"), "best")

    gated = F.when(F.col("gate"), F.col("score")).otherwise(0.0)
    rows, own = _with_blocks(rows, sum_before=F.sum(gated))
    mass = F.coalesce("start_mass", F.lit(rule.first_mass)) + F.coalesce("sum_before", F.lit(0.0)) + F.sum(gated).over(own.rowsBetween(*upto))
    rows = rows.withColumn("mass", mass).drop("__block", "sum_before").withColumn("first_w", F.coalesce("start_w", F.lit(rule.min_inlier_ratio)))
    has = finite(F.col("share"))
    rows = _stored(rows, "mass")
    moved = moving_average(rows.filter(has), ["config"], "iter", "share", F.col("first_w"), rule.ema)
    rows = _stored(moved.unionByName(rows.filter(~has).withColumn("w", F.lit(None).cast("double"))).withColumn("own", _least_rows(F.col("w"), rule)), "w")

    rows, own = _with_blocks(rows, last_before=F.max_by("w", F.when(F.col("w").isNotNull(), F.col("iter"))), min_before=F.min("own"))
    w = F.coalesce(F.last("w", ignorenulls=True).over(own.rowsBetween(*upto)), F.col("last_before"), F.col("first_w"))
    limit = F.least(F.lit(float(rule.limit)), F.col("start_max_iter"), F.col("min_before"), F.min("own").over(own.rowsBetween(*upto)))
    rows = _stored(rows.withColumn("w", w).withColumn("max_iter", limit).select(*[c.split()[0] for c in ROWS.split(", ")], "start_n_rows"), "rows")

    last = F.max_by(F.struct("mass", "w", "max_iter"), "iter").alias("last")
    ends = rows.groupBy("config").agg(F.max("iter").alias("last_iter"), F.count("*").alias("n"), F.max("start_n_rows").alias("old"), F.max("best").alias("best"), F.max(good).alias("own"), last)
    n_rows = (F.coalesce("old", F.lit(0)) + F.col("n")).alias("n_rows")
    ends = ends.select("config", "last_iter", n_rows, F.greatest("best", "own").alias("best"), "last.*")
    still = state.join(ends.select(F.col("config").alias("__new")), F.col("config").eqNullSafe(F.col("__new")), "left_anti")
    return rows.drop("start_n_rows"), late, still.unionByName(ends)


def state_before(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """The state that the last batch before this one left."""
    if not exists(spark, f"{out}/state/batch=*"):
        return spark.createDataFrame([], STATE)
    found = spark.read.schema(f"{STATE}, batch bigint").parquet(f"{out}/state")
    last = found.filter(F.col("batch") < batch).agg(F.max("batch")).first()[0]
    if last is None:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{out}/state/batch={last}")


def put(log: DataFrame, batch: int, out: str, rule: Rule = Rule()) -> None:
    """One batch: its rows (a folder a configuration), late rows, and the state after it."""
    rows, late, state = advance(log, state_before(log.sparkSession, out, batch), rule)
    rows.write.mode("overwrite").partitionBy("config").parquet(f"{out}/rows/batch={batch}")
    late.write.mode("overwrite").parquet(f"{out}/late/batch={batch}")
    state.write.mode("overwrite").parquet(f"{out}/state/batch={batch}")


def follow(stream: DataFrame, out: str, checkpoint: str, rule: Rule = Rule()):
    """Takes what is new in a stream of log rows and ends; the finished query."""
    start = stream.writeStream.foreachBatch(lambda batch, number: put(batch, number, out, rule))
    q = start.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return q


def _read(spark: SparkSession, out: str, part: str, schema: str) -> DataFrame:
    own = f"{schema}, batch bigint"
    if not exists(spark, f"{out}/{part}/batch=*"):
        return spark.createDataFrame([], own)
    return spark.read.schema(own).parquet(f"{out}/{part}")


def read_rows(spark: SparkSession, out: str) -> DataFrame:
    """All rows with their state, and the number of the batch that brought them."""
    return _read(spark, out, "rows", ROWS)


def read_late(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, out, "late", LOG)
