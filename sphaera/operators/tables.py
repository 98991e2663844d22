"""Experiment tables: grids, logs, nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import exists, work_path


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """One row for each combination of the axes' values, numbered in order; axes are short lists."""
    out = None
    for name, values in axes.items():
        kind = "int" if all(isinstance(v, int) for v in values) else "double"
        cells = F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name)
        out = spark.range(1).select(cells) if out is None else out.select("*", cells)
    return out


def with_counts(configs: DataFrame, n: int) -> DataFrame:
    """n_out = n eps, halves up, and n_in, the rest."""
    n_out = F.floor(F.lit(n) * F.col("eps") + 0.5).cast("long")
    return configs.withColumn("n_out", n_out).withColumn("n_in", F.lit(n).cast("long") - F.col("n_out"))


def within_capacity(configs: DataFrame, inliers: DataFrame, outliers: DataFrame) -> DataFrame:
    """Configurations that the pools have enough points for."""
    pools = inliers.agg(F.count("*").alias("__in")).join(F.broadcast(outliers.agg(F.count("*").alias("__out"))))
    return configs.join(F.broadcast(pools)).filter("n_in <= __in AND n_out <= __out").drop("__in", "__out")


def with_constants(log: DataFrame, **values) -> DataFrame:
    return log.withColumns({k: F.lit(v) for k, v in values.items()})


def ordered(log: DataFrame, names: list[str]) -> DataFrame:
    return log.select(*names)


def appended(first: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A log with one more batch; the first batch is taken as it is."""
    return batch if first is None else first.unionByName(batch, allowMissingColumns=True)


def nested(log: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """One row for each key, with each value's vector in order. A key is one configuration, whose iterations are bounded."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__at"), *values)))
    return log.groupBy(*keys).agg(own.alias("__rows")).select(*keys, *[F.col("__rows").getField(v).alias(v) for v in values])


def value_at(array: Column, keys: Column, key: float) -> Column:
    """The entry of array where keys equals key, NaN if there is none."""
    hit = F.filter(F.arrays_zip(keys.alias("k"), array.alias("v")), lambda z: z["k"] == key)
    return F.coalesce(F.try_element_at(hit, F.lit(1))["v"], F.lit(float("nan")))


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def existing(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A registered table, or an empty one."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def numbered(df: DataFrame, order: list[str], name: str = "row_id", after: int = 0) -> DataFrame:
    """df with consecutive numbers from after + 1 on, in the order of the keys.

    Parts by ranges of the keys are sorted and stored; only their sizes meet, so no task sorts all rows.
    """
    spark = df.sparkSession
    path = work_path(spark, "numbered")
    own = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).drop("__size")
    return rows.join(before, "__part").withColumn(name, F.col("__before") + F.col("__at") + 1 + after).drop("__part", "__at", "__before")


def append_results(results: DataFrame, path: str, run: str) -> None:
    """Adds the rows of one run to a table that survives re-runs: a folder for each run, which a repeated run replaces.

    A run that failed leaves nothing that readers see (Spark publishes files when the write ends), and
    writers of different runs don't touch each other's folders.
    """
    if "run" in results.columns or "row_id" in results.columns:
        raise ValueError("run and row_id are given by the table")
    stored = results.withColumn("run", F.lit(run))
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_results(spark: SparkSession, path: str, schema: str, order: list[str]) -> DataFrame:
    """row_id, run and the columns of schema: all runs, numbered from 1 on in the order of their keys, a run's rows in the order of theirs.

    With keys that ascend (times, numbers of one length) numbers stay what they are when runs are added.
    """
    if not exists(spark, f"{path}/run=*"):
        return spark.createDataFrame([], f"row_id bigint, run string, {schema}")
    found = spark.read.schema(f"{schema}, run string").parquet(path)
    return numbered(found, ["run", *order]).select("row_id", "run", *[c for c in found.columns if c != "run"])


def output_path(root: str) -> str:
    """root/yyyymmdd_HHMM of now."""
    from datetime import datetime

    return f"{root.rstrip('/')}/{datetime.now():%Y%m%d_%H%M}"
