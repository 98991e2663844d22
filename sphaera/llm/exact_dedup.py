"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 finds the hashes that occur again. The hash space is cut into shards in
proportion to the rows, a row's place in its shard is a number of 32 bits. Each task
packs the places of a shard into one list, so what shuffles is some 4 bytes a row in
a few records a task; places that a list holds twice, or two lists of a shard hold,
are possibly repeated. With at most ``MAX_TASKS`` tasks a list has ``LEAST_LIST`` places on
average at least, however many rows there are. The places make a Bloom filter of 16 bits each, two of them set in one
word of 64: a text whose bits are not in it is certainly unique. Pass 2 looks every
row up in that filter (a broadcast hash join on the filter's word) and only the
possibly repeated rows shuffle, by digest; the rest pass straight through.

The filter grows with the repeated texts. Up to ``RANGE_WORDS`` words are one broadcast;
a larger filter is cut into ranges of that many, the digests are written anew by
range (rows stay in their tasks), and each range meets its own part of the filter. So
the filter is equally dense at every size, and no broadcast exceeds its bound. A list is as
long as a task's rows in a shard: copies of one text count once for each task when lists meet,
so no group makes a long one. What shuffles are places, ids and digests, no texts.

Defined cases: a null text equals the empty one; equal means identical code
points; of equal texts the largest doc_id stays (nulls are smaller than any id;
a group with null ids only keeps all its rows); rows that repeat both doc_id and
text are all kept together; a text of any length is hashed whole, once; an empty table gives an
empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import work_path
from .common import fields, join_counted, materialise, text_or_empty

#: Bits of filter a repeated place, least number of its words, and words of one broadcast (4 MB of bits).
BITS_PER_PLACE, MIN_WORDS, RANGE_WORDS = 16, 1 << 10, 1 << 19
#: Rows of a shard, about, and least number of shards.
SHARD_ROWS, MIN_SHARDS = 1 << 22, 16
#: Places of a list on average when shards are full, and the tasks that takes: rows / tasks / shards.
LEAST_LIST = 64
MAX_TASKS = SHARD_ROWS // LEAST_LIST


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest (SHA-256), h (64-bit hash for the filter)."""
    digest = F.unhex(F.sha2(text_or_empty(text), 256))
    return docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest")).withColumn("h", F.xxhash64("digest"))


def repeated_places(hashed: DataFrame, n_shards: int) -> DataFrame:
    """shard, slot: places that two rows or more have (few others: those of different hashes)."""
    at = hashed.select(F.spark_partition_id().alias("task"), _shard(n_shards).alias("shard"), _slot().alias("slot"))
    packed = at.groupBy("task", "shard").agg(F.array_sort(F.collect_list("slot")).alias("s"))
    again = F.array_distinct(F.expr("filter(s, (x, i) -> x <=> get(s, i - 1))"))
    packed = packed.select("shard", again.alias("again"), F.array_distinct("s").alias("s"))
    met = packed.groupBy("shard").agg(F.flatten(F.collect_list("again")).alias("own"), F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    return met.select("shard", F.explode(F.array_union("own", again)).alias("slot"))


def _shard(n_shards: int) -> Column:
    return F.pmod("h", F.lit(n_shards)).cast("int")


def _slot() -> Column:
    """The upper half of a hash."""
    return F.shiftright("h", 32).cast("int")


def repeat_filter(places: DataFrame, n_words: int) -> DataFrame:
    """word, twice: the Bloom filter of repeated places."""
    key = F.xxhash64("shard", "slot")
    return places.select(*_bits(key, n_words)).groupBy("word").agg(F.bit_or("mask").alias("twice"))


def _by_ranges(rows: DataFrame, bits: DataFrame, n: int) -> DataFrame:
    """rows with their word of the filter, a broadcast for each of n ranges of words; rows are written by range, without a shuffle."""
    spark = rows.sparkSession
    path = work_path(spark, "exact-ranges")
    rows.withColumn("range", F.floor(F.col("word") / RANGE_WORDS).cast("int")).write.partitionBy("range").parquet(path)
    stored = spark.read.schema(f"{fields(rows)}, range int").parquet(path)
    found = None
    for k in range(n):
        own = bits.filter((F.col("word") >= k * RANGE_WORDS) & (F.col("word") < (k + 1) * RANGE_WORDS))
        met = stored.filter(F.col("range") == k).drop("range").join(F.broadcast(own), "word", "left")
        found = met if found is None else found.unionByName(met)
    return found


def _bits(key: Column, n_words: int) -> list[Column]:
    """The word of a place in the filter and its two bits there."""
    a = key.bitwiseAND(F.lit(63)).cast("int")
    b = F.pmod(a + 1 + F.pmod(F.shiftrightunsigned(key, 6), F.lit(63)).cast("int"), F.lit(64))
    one = F.lit(1).cast("long")
    return [F.shiftrightunsigned(key, 16).bitwiseAND(F.lit(n_words - 1)).alias("word"), F.call_function("shiftleft", one, a).bitwiseOR(F.call_function("shiftleft", one, b)).alias("mask")]


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept."""
    hashed = materialise(digests(docs, text, doc_id), "exact-digests")
    total = hashed.count()
    n_shards = max(MIN_SHARDS, total // SHARD_ROWS)
    places = materialise(repeated_places(hashed.coalesce(MAX_TASKS), n_shards), "exact-places")
    wanted, n_words = places.count() * BITS_PER_PLACE // 64, MIN_WORDS
    while n_words < wanted:
        n_words *= 2
    rows = hashed.select("doc_id", "digest", *_bits(F.xxhash64(_shard(n_shards), _slot()), n_words))
    bits = repeat_filter(places, n_words)
    if n_words > RANGE_WORDS:
        found = _by_ranges(rows, materialise(bits, "exact-filter"), n_words // RANGE_WORDS)
    else:
        found = rows.join(F.broadcast(bits), "word", "left")
    suspect = F.coalesce(F.col("twice").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    found = found.select("doc_id", "digest", suspect.alias("suspect"))
    again = found.filter("suspect").select("doc_id", "digest")
    groups = again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = join_counted(again, groups, "digest", "group_size", total, F.col("doc_id"))
    joined = joined.select("doc_id", "digest", "keep_id", "group_size")
    single = found.filter("NOT suspect").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return single.unionByName(joined).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    gone = annotate(docs, text, doc_id).filter("NOT kept").select(F.col("doc_id").alias("__gone_id"), F.col("digest").alias("__gone_digest")).distinct()
    mark = docs.withColumn("__digest", F.unhex(F.sha2(text_or_empty(text), 256)))
    on = mark[doc_id].eqNullSafe(gone["__gone_id"]) & (mark["__digest"] == gone["__gone_digest"])
    return mark.join(gone, on, "left_anti").drop("__digest")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return annotate(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
}
