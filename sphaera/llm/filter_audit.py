"""Filter interaction audit by inclusion and exclusion over joint failures.

Which filter of a chain removes what depends on the order of the chain. Instead of running
every order, one aggregation counts for each part of the corpus, and for each of the 2**n
sets of filters, the documents that fail all filters of the set: sums of products of 0/1
flags. Möbius inversion of these joint failures gives everything else:

* survivors of a set S of filters: sum over T in S of (-1)**|T| J(T);
* documents that fail exactly T: sum over the sets around T of (-1)**|S - T| J(S);
* removed by filter i after the filters P: survivors(P) - survivors(P + i), so one number
  for each (i, P) serves all orders that put P before i;
* the number of removed documents is a game of the filters whose Harsanyi dividend of T is
  -(-1)**|T| J(T); a filter's Shapley value is the sum of dividends / |T| over the sets it
  is in, and the sum over all n! orders is n! times that, a whole number.

The text is read once. Repeats of a text are found by its digest: the smallest id of each
digest is a pre-aggregated minimum, and documents meet it by (id, digest), a key that copies
do not share, so no group of copies meets in one task. What shuffles are ids, digests and
flags; the sums are one row a part and task. The result has n! * n rows a part.

Defined cases: a null text is empty, a null part is the empty string; an empty text has no
words, so it fails A and passes B, C and D; of rows that repeat id and text none is a repeat
of the other; a null id is smaller than none and has no smaller one, so it never fails E, and
has no labels; several label rows of one id count as one that has each mark that any of them has;
a null mark is none; texts of any length are taken whole; an empty table gives an empty result;
other columns are neither read nor in the way.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import materialise, small_batches

#: The registered chain, in the order of its letters; E goes by the whole table, the others by a text.
FILTERS = ("A", "B", "C", "D", "E")
#: Bytes of a text whose words are split at once.
PIECE = 1 << 20
_ODD = re.compile(rb"[#$%&*|]")


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails: too short, repetitive, shouting, odd characters."""
    data = np.frombuffer(text, np.uint8)
    n_words, different = 0, set()
    for piece in textops.pieces(data, PIECE):
        found = piece.tobytes().split()  # at [\x20\x09-\x0D]
        n_words += len(found)
        different.update(found)
    capitals = int(np.count_nonzero((data >= 0x41) & (data <= 0x5A)))
    code_points = int(np.count_nonzero(data & 0xC0 != 0x80))
    fails = (n_words < 200, 100 * len(different) < 50 * n_words, 100 * capitals > 2 * code_points, _ODD.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def flag(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """doc_id, part, fails of every row of docs: the bits of the filters A to E that it fails."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, digests = [], []
            for _, _, data, offsets in textops.blocks(batch.column(2)):
                for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = data[start:end].tobytes()
                    bits.append(text_failures(own))
                    digests.append(hashlib.sha256(own).digest())
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bits, pa.int32())]
            yield pa.record_batch(columns, names=["doc_id", "part", "digest", "bits"])

    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(text).alias("text"))
    rows = materialise(lean.mapInArrow(textops.lean(run), "doc_id long, part string, digest binary, bits int"), "audit-flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeats = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", F.col("bits").bitwiseOR(repeats).alias("fails"))


def with_marks(flagged: DataFrame, labels: DataFrame, marks: dict[str, Column], doc_id: str = "doc_id") -> DataFrame:
    """flagged with a 0/1 column for each mark, a condition on the rows of labels."""
    own = labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in marks.items()])
    known = flagged.filter("doc_id IS NOT NULL").join(own, "doc_id", "left").select(*flagged.columns, *[F.coalesce(k, F.lit(0)).alias(k) for k in marks])
    # rows without an id have no marks, and must not meet in one task as one key
    return known.unionByName(flagged.filter("doc_id IS NULL").select("*", *[F.lit(0).alias(k) for k in marks]))


def joint_failures(marked: DataFrame, n: int = len(FILTERS), weights: Sequence[str] = (), part: str = "part") -> DataFrame:
    """part, set, n and a sum of each weight: the rows that fail all filters of a set (bits), where there are any.

    The product of a row's flags over a set is 1 for the subsets of what it fails and 0 for the
    others, so a row adds its weights to those subsets; tasks sum before anything shuffles.
    """
    subsets = [[s for s in range(1 << n) if s & fails == s] for fails in range(1 << n)]
    table = F.expr(f"array({', '.join(f'array({str(s)[1:-1]})' for s in subsets)})")
    products = marked.select(part, F.explode(F.get(table, F.col("fails"))).alias("set"), *weights)
    return products.groupBy(part, "set").agg(F.count("*").alias("n"), *[F.sum(F.col(w).cast("long")).alias(w) for w in weights])


def survivor_matrix(n: int) -> np.ndarray:
    """Row S times joint failures: the rows that fail nothing of S, sum over T in S of (-1)**|T| J(T)."""
    sets = range(1 << n)
    return np.array([[(-1) ** t.bit_count() if t & s == t else 0 for t in sets] for s in sets], np.int64)


def exact_matrix(n: int) -> np.ndarray:
    """Row S times joint failures: the rows that fail S and nothing else, sum over T around S of (-1)**|T - S| J(T)."""
    sets = range(1 << n)
    return np.array([[(-1) ** (t ^ s).bit_count() if t & s == s else 0 for t in sets] for s in sets], np.int64)


def shapley_matrix(n: int) -> np.ndarray:
    """Row i times joint failures: n! times the Shapley value of filter i, from the dividends -(-1)**|T| J(T)."""
    dividends = [[-((-1) ** t.bit_count()) * (math.factorial(n) // t.bit_count()) if t >> i & 1 else 0 for t in range(1 << n)] for i in range(n)]
    return np.array(dividends, np.int64)


def steps(names: Sequence[str]) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
    """filter_order, step, filter and the set before it, of each step of each order."""
    orders, numbers, own, before = [], [], [], []
    for order in itertools.permutations(range(len(names))):
        gone = 0
        for step, i in enumerate(order, 1):
            orders.append("".join(names[k] for k in order))
            numbers.append(step)
            own.append(i)
            before.append(gone)
            gone |= 1 << i
    return orders, numbers, np.array(own), np.array(before)


def chains(joint: DataFrame, names: Sequence[str] = FILTERS, weights: Sequence[str] = (), part: str = "part") -> DataFrame:
    """The audit: a row per part, order of the filters and step, from joint failures.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, <weight>_lost of each weight, shapley.
    """
    n = len(names)
    counted = F.map_from_entries(F.collect_list(F.struct("set", F.array("n", *weights))))
    wide = joint.groupBy(part).agg(counted.alias("sums"))  # 2**n entries at most
    every = F.expr(f"array({', '.join(map(str, range(1 << n)))})")
    none = F.array(*[F.lit(0).cast("long")] * (1 + len(weights)))
    wide = wide.select(F.col(part).alias("part"), F.flatten(F.transform(every, lambda s: F.coalesce(F.get(F.array(F.col("sums")[s]), F.lit(0)), none))).alias("sums"))
    run = _expand(tuple(names), tuple(weights))
    found = wide.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in _counts(weights))}")
    return found.withColumnRenamed("part", part)


def _counts(weights: Sequence[str]) -> list[str]:
    return ["kept", "removed", "redundant", "unique_fails", *[f"{w}_lost" for w in weights], "shapley"]


def _expand(names: Sequence[str], weights: Sequence[str]) -> Callable:
    """All steps of all orders for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        orders, numbers, own, before = steps(names)
        single, survive = 1 << own, survivor_matrix(n)
        gone = survive[before] - survive[before | single]
        redundant = -gone
        redundant[np.arange(len(own)), single] += 1
        alone, shapley = exact_matrix(n)[single], shapley_matrix(n)[own]
        for batch in batches:
            sums = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, 1 << n, 1 + len(weights))
            for i, part in enumerate(batch.column(0).to_pylist()):
                joint = sums[i]
                counts = [survive[before | single] @ joint[:, 0], gone @ joint[:, 0], redundant @ joint[:, 0], alone @ joint[:, 0]]
                counts += [gone @ joint[:, 1 + k] for k in range(len(weights))] + [shapley @ joint[:, 0]]
                columns = [pa.array([part] * len(own), pa.string()), pa.array(orders), pa.array(numbers, pa.int32()), *map(pa.array, counts)]
                yield pa.record_batch(columns, names=["part", "filter_order", "step", *_counts(weights)])

    return run


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five registered filters over docs, losses by the marks of labels (quality, toxic)."""
    marked = with_marks(flag(docs), labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return chains(joint_failures(marked, len(FILTERS), ("good", "toxic")), FILTERS, ("good", "toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM t
), m AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END ||
         CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END ||
         CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END ||
         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
         CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN m ON w.doc_id = m.doc_id
), p AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x
    AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x
), r AS (
  SELECT part, filter_order, s.step, substr(filter_order, s.step, 1) AS x,
         n, good, toxic, contains(fails, substr(filter_order, s.step, 1)) AS own,
         length(translate(fails, substr(filter_order, 1, s.step - 1), '')) < length(fails) AS earlier,
         fails = substr(filter_order, s.step, 1) AS only_own
  FROM p, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), g AS (
  SELECT part, filter_order, step, x,
         coalesce(sum(n) FILTER (NOT earlier AND NOT own), 0) AS kept, coalesce(sum(n) FILTER (NOT earlier AND own), 0) AS removed,
         coalesce(sum(n) FILTER (earlier AND own), 0) AS redundant, coalesce(sum(n) FILTER (only_own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT earlier AND own), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT earlier AND own), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM g
"""
}
