"""Shared plumbing: work folder, materialised tables, skew-proof joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import work_path

#: A key counts as hot when it holds more than this share of the rows; so there
#: are at most 1 / HOT_SHARE hot keys, whatever the size of the input.
HOT_SHARE = 1 / 1024


#: Bytes that Arrow sends to a Python worker at once; a longer row is a batch of its own.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches of whole texts, on both sides, by bytes.

    Results are evaluated lazily, so the bound stays set in the session. A smaller one that is set already holds.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(size) << 10 * "bkmg".find(unit or "b") <= ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write Parquet to the shared folder and read it back.

    The table outlives any executor. Files stay until the folder is cleaned, as
    lazily evaluated results may still read them.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = work_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """Left join of many rows to their groups, safe for keys with many rows.

    ``groups`` has one row per ``key`` with its number of rows in ``count``.
    Keys with more than ``total * HOT_SHARE`` rows number at most 1024, so they
    are broadcast; their rows get a spread-out key that matches nothing in the
    shuffled join, which therefore has no hot partition. ``spread`` is hashed
    for that, ``key`` must be binary.
    """
    others = [c for c in groups.columns if c != key]
    floor = max(2, int(total * HOT_SHARE))
    hot = groups.filter(F.col(count) > floor).select(F.col(key), *[F.col(c).alias(f"__hot_{c}") for c in others])
    rest = groups.filter(F.col(count) <= floor).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__rest_{c}") for c in others])
    left = rows.join(F.broadcast(hot), key, "left")
    # a 9-byte key can equal no digest: those have 8, 16 or 32 bytes
    dealt = F.when(F.col(f"__hot_{count}").isNull(), F.col(key)).otherwise(F.concat(F.encode(F.lit("~"), "UTF-8"), F.unhex(F.lpad(F.hex(F.xxhash64(spread)), 16, "0"))))
    both = left.withColumn("__key", dealt).join(rest, "__key", "left")
    return both.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__rest_{c}").alias(c) for c in others])


def number(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ordered: bool = False) -> DataFrame:
    """docs with __row: a unique, non-null long.

    Where doc_id is such a key itself, as it should be, it is used as it is.
    Otherwise the rows are numbered and stored, so that the numbers stay the same
    each time they are read; with ``ordered`` in the order of doc_id (null first)
    and a hash of the text.
    """
    key = F.col(doc_id).cast("long")
    n, ids = docs.agg(F.count("*"), F.count_distinct(key)).first()
    if n == ids:
        return docs.withColumn("__row", key)
    if ordered:
        order = [key.asc_nulls_first(), F.xxhash64(text).asc()]
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def identify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ordered: bool = False) -> DataFrame:
    """row, doc_id, text of docs, with a unique, non-null long in row (see number)."""
    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return number(lean, ordered=ordered).select(F.col("__row").alias("row"), "doc_id", "text")


def lean_rows(numbered: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row, doc_id, text of numbered documents."""
    return numbered.select(F.col("__row").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def without_rows(numbered: DataFrame, gone: DataFrame, max_broadcast: int = 1 << 20) -> DataFrame:
    """Numbered documents whose __row is not in gone (row); few such rows are broadcast, more are joined."""
    gone = materialise(gone.select(F.col("row").alias("__row")), "gone")
    return numbered.join(F.broadcast(gone) if gone.count() <= max_broadcast else gone, "__row", "left_anti").drop("__row")


def fields(df: DataFrame) -> str:
    """The columns of df as a DDL string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def smallest_hashes(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows with the smallest hashes of key: a sample of fixed size, for fitting only.

    Rows beyond the hash that some more than n of the total stay below are left
    out first, so the tasks send about n rows in all to the final sort.
    """
    h = F.xxhash64(key)
    share = (1.3 * n + 200) / max(1, total)
    if share < 1:
        rows = rows.filter(h < int(-(1 << 63) + share * (1 << 64)))
    return rows.orderBy(h, key).limit(n)
