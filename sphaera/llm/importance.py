"""Quality selection by importance resampling.

Two generative models of hashed word n-grams (words and pairs of words, one
distribution over the buckets each) are counted: one over texts labelled good, the
target, one over all texts, the raw corpus. A text's log weight is the sum over
its n-grams of the log ratio of the two. Adding independent Gumbel noise to the
log weights and taking the k largest draws k texts without replacement, with
probabilities in proportion to the weights.

All counts cover all documents. The models grow with the corpus: ``BUCKETS`` up to
64 MB of text, then with the square root of its size, so a bucket mixes more n-grams
only as fast as it sees more of them; ``MAX_BUCKETS`` (32 MB) bounds the broadcast.
Each task sums its counts, and sends them as packed arrays of ``RANGE`` buckets; these are added up
by ``MERGED`` in a tree, so no task holds more than ``MERGED`` arrays of one range.
At the bound a bucket of a 100 TB corpus mixes five times the n-grams that one of 4 TB does; texts are still all counted and weighed.
The k-th largest key is found by narrowing a histogram, not by a global sort.

By default k is the number of texts times the labelled share of good ones.

Defined cases: null and empty texts have no n-grams and log weight 0; labels that
repeat a doc_id count as good if any is; without good labels the target is the
raw corpus; noise depends on doc_id and seed only, so rows that repeat doc_id and
text are kept or dropped together (then more than k may be kept); a null doc_id
has noise of its own; texts of any length are read whole, block by block; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import materialise, small_batches

BUCKETS, MAX_BUCKETS = 1 << 14, 1 << 22
BUCKETS_BYTES = 1 << 26
SMOOTHING = 1.0
SEED = 17
#: Ids of good texts up to this number are broadcast (8 bytes each), more, or others than integers, are joined.
MAX_BROADCAST_LABELS = 1 << 22
_BINS = 1024
#: Buckets of a packed array, arrays that are added up at once.
RANGE, MERGED = 1 << 14, 64


def block_grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """document and bucket of every word and pair of words."""
    low = tx.LOWER[data]
    start, end, doc = tx.split_words(low, offsets, tx.NOT_SPACE)
    if not len(start):
        return doc, doc
    words = tx.mix(tx.range_hash(tx.prefix_sums(low), start, end))
    pairs = tx.gram_hash(words, 2)
    same = doc[: len(pairs)] == doc[1:]
    both = np.concatenate((words, pairs[same])) % np.uint64(buckets)
    return np.concatenate((doc, doc[:-1][same])), both.astype(np.int64)


def count_grams(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of n-grams by bucket, over the target and over all texts."""
    good = labels.filter(f"{label} = 1 AND {doc_id} IS NOT NULL").select(F.col(doc_id).alias("__id")).distinct()
    lean = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    whole = all(isinstance(x.schema["__id"].dataType, T.IntegralType) for x in (good, lean))
    ids = None
    if whole and good.count() <= MAX_BROADCAST_LABELS:
        ids = np.sort(good.select(F.col("__id").cast("long")).toArrow().column(0).to_numpy())
        lean = lean.select(F.col("__id").cast("long").alias("good"), "text")
    else:
        lean = lean.join(good.withColumn("good", F.lit(1).cast("long")), "__id", "left").select("good", "text")
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            mark = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if shared.value is not None:
                mark &= np.isin(batch.column(0).fill_null(0).to_numpy(), shared.value)
            for row, _, data, offsets in tx.blocks(batch.column(1)):
                doc, gram = block_grams(data, offsets, buckets)
                raw += np.bincount(gram, minlength=buckets)
                target += np.bincount(gram[mark[row + doc]], minlength=buckets)
        part = TaskContext.get().partitionId()
        for at in range(0, buckets, RANGE):
            if raw[at : at + RANGE].any():
                yield _packed(part, at // RANGE, target[at : at + RANGE], raw[at : at + RANGE])

    target, raw = np.zeros(buckets), np.zeros(buckets)
    for at, t, r in summed(lean.mapInArrow(tx.lean(run), _PACKED), lean.rdd.getNumPartitions()).toLocalIterator():
        for out, own in ((target, t), (raw, r)):
            own = np.frombuffer(own, np.int64)
            out[at * RANGE : at * RANGE + len(own)] += own
    return target, raw


_PACKED = "part bigint, range int, target binary, raw binary"


def _packed(part: int, at: int, target: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([part], pa.int64()), pa.array([at], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (target, raw)]]
    return pa.RecordBatch.from_arrays(cells, names=["part", "range", "target", "raw"])


def summed(counts: DataFrame, parts: int) -> DataFrame:
    """range, target, raw: packed arrays added up, MERGED parts at a time until few are left; the caller adds those."""

    def add(table: pa.Table) -> pa.Table:
        both = [np.sum([np.frombuffer(v.as_py(), np.int64) for v in table.column(c)], axis=0) for c in ("target", "raw")]
        return pa.Table.from_batches([_packed(table.column("part")[0].as_py() // MERGED, table.column("range")[0].as_py(), *both)])

    while True:
        counts = counts.groupBy("range", F.floor(F.col("part") / MERGED)).applyInArrow(add, _PACKED)
        parts = -(-parts // MERGED)
        if parts <= 1:
            return counts.select("range", "target", "raw")


def buckets_for(n_bytes: int) -> int:
    """Buckets for so much text: a power of two."""
    n = BUCKETS
    while n < MAX_BUCKETS and (2 * n // BUCKETS) ** 2 * BUCKETS_BYTES <= n_bytes:
        n *= 2
    return n


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    if not target.sum():
        target = raw
    p, q = target + smoothing, raw + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_grams, log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for row, end, data, offsets in tx.blocks(batch.column(1)):
                doc, gram = block_grams(data, offsets, len(ratio))
                sums.append(np.bincount(doc, weights=ratio[gram], minlength=end - row))
                sizes.append(np.bincount(doc, minlength=end - row))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_grams": np.concatenate(sizes), "log_weight": np.concatenate(sums)})

    return lean.mapInArrow(tx.lean(run), f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, n_grams bigint, log_weight double")


def gumbel(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value: the histogram bin that holds it becomes the next range, until that is one value or few rows."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return low
    if k <= 0:
        return None
    above = 0
    for _ in range(12):
        inside = rows.filter((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / _BINS
        if width <= 0 or not low + width > low:
            return low
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(_BINS - 1))
        bins = {r[0]: r[1:] for r in inside.groupBy(at.alias("bin")).agg(F.count("*"), F.min(key), F.max(key)).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b][0] >= k:
                break
            above += bins[b][0]
        number, low, high = bins[b]
        if number <= _BINS:
            best = rows.filter((F.col(key) >= low) & (F.col(key) <= high)).select(key).orderBy(F.desc(key)).limit(k - above).collect()
            return best[-1][0]
    return low


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept of every row; kept marks the k rows drawn."""
    small_batches(docs.sparkSession)
    known = labels.filter(f"quality IN (0, 1) AND {doc_id} IS NOT NULL").groupBy(doc_id).agg(F.max("quality").alias("quality"))
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    ratio = log_ratio(*count_grams(docs, known, text, doc_id, buckets=buckets_for(size)))
    rows = materialise(weigh(docs, ratio, text, doc_id).withColumn("key", F.col("log_weight") + gumbel("doc_id", seed)), "importance-keys")
    if k is None:
        share = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        k = round(rows.count() * (1.0 if share is None else share))
    floor = kth_largest(rows, "key", k)
    return rows.withColumn("kept", F.lit(False) if floor is None else F.col("key") >= floor)


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels that op3 learns from as well: crc32(doc_id) modulo 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return resample(docs, labels).select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("gumbel_key"), "kept")


QUERIES = {"op9_importance": op9_importance}
ORACLE_SQL: dict[str, str] = {}
