"""Benchmark decontamination by word windows.

The normalised windows of all test items form a hash set that is broadcast:
every document's token windows are hashed in one vectorised pass and looked up,
hits are verified word by word. The driver builds the set once, from at most
``MAX_BROADCAST_BYTES`` of item text, and broadcasts it if it takes no more than
``MAX_INDEX_BYTES``; both are measured. A larger benchmark is joined by two
independent 64-bit hashes of the windows instead (``joined_hits``): documents' windows
first pass a bit table of bounded size, frequent ones are salted, and hits are
verified word by word as well. Both ways give the same result.

Cutting removes the hit words and what is between them, and does so again while the
words left form windows anew; only the surroundings of cuts are looked at again.

Words are maximal runs of ASCII letters (lower-cased), digits and characters
from U+0080 on. A window is 10 consecutive words of an item, or the whole item
if it has fewer, but not none.

Defined cases: null texts have no words; items without words match nothing;
items that repeat an item_id count once; items with a null item_id hit words but
are not counted or listed; documents that repeat a doc_id are judged row by row
(one result row each); empty tables work; other columns of either table are not
read by the scan.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import fields, lean_rows, materialise, number, small_batches, text_or_empty, without_rows

WINDOW = 10
#: Items with more text, or whose windows take more, are not broadcast.
MAX_BROADCAST_BYTES, MAX_INDEX_BYTES = 16 << 20, 128 << 20
#: Most words of 64 bits of the table that documents' windows pass before a join (32 MB); copies of the windows that salted ones meet.
MAX_TABLE_WORDS, SALTS = 1 << 22, 16


class WindowIndex:
    """Different windows by length: sorted hashes, a bit table before them, where their words stand, and their items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names: list[str | None] = list(dict.fromkeys(name for name, _ in items))
        number = {name: k for k, name in enumerate(self.names)}
        texts = [(t or "").encode() for _, t in items]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
        self.low = tx.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        self.start, self.end, doc = tx.split_words(self.low, offsets, tx.ALNUM)
        item = np.array([number[name] for name, _ in items], np.int32)[doc] if len(doc) else np.zeros(0, np.int32)
        size = np.minimum(np.bincount(doc, minlength=len(items)), window)[doc] if len(doc) else doc
        words = np.concatenate([tx.range_hash(tx.prefix_sums(part), a, b) for part, a, b in self._parts(offsets)]) if len(doc) else np.zeros(0, np.uint64)
        self.by_length = {}
        for n in np.unique(size).tolist():
            grams = tx.gram_hash(words, n)
            at = np.flatnonzero((doc[: len(grams)] == doc[n - 1 :]) & (size[: len(grams)] == n))
            at = at[np.lexsort((item[at], grams[at]))]
            known, first = np.unique(grams[at], return_index=True)
            # windows of one hash are one window, but for a chance: those go apart
            groups, spare = np.split(at, first[1:]), []
            for k in np.flatnonzero(np.diff(np.append(first, len(at))) > 1).tolist():
                same = np.array([self.words_at(i, n) == self.words_at(groups[k][0], n) for i in groups[k].tolist()])
                spare += [(known[k], np.array([i])) for i in groups[k][~same].tolist()]
                groups[k] = groups[k][same]
            if spare:
                known, groups = np.append(known, [h for h, _ in spare]), groups + [g for _, g in spare]
                order = np.argsort(known, kind="stable")
                known, groups = known[order], [groups[k] for k in order.tolist()]
            own = [np.unique(item[g]) for g in groups]
            bits = max(12, int(len(known)).bit_length() + 3)
            table = np.zeros(1 << bits, bool)
            table[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in own])))
            self.by_length[n] = (known, np.uint64(64 - bits), table, np.array([g[0] for g in groups], np.int64), bounds, np.concatenate(own))

    def _parts(self, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes and words of about a block of items at a time."""
        row = 0
        while row < len(offsets) - 1:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + tx.BLOCK_BYTES, "right")) - 1)
            own = slice(*np.searchsorted(self.start, (offsets[row], offsets[end])))
            yield self.low[offsets[row] : offsets[end]], self.start[own] - offsets[row], self.end[own] - offsets[row]
            row = end

    def nbytes(self) -> int:
        return self.low.nbytes + self.start.nbytes + self.end.nbytes + sum(x.nbytes for own in self.by_length.values() for x in own)

    def words_at(self, i: int, n: int) -> bytes:
        return _words(self.low, self.start, self.end, i, n)

    def hits(self, words: np.ndarray, docs: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """length, position of the first word and items of each verified window; words are hashes, docs keep them apart."""
        for n, (known, shift, table, where, bounds, items) in self.by_length.items():
            grams = tx.gram_hash(words, n)
            at = np.flatnonzero(table[(grams >> shift).astype(np.int64)])
            at = at[docs[at] == docs[at + n - 1]]
            near = np.searchsorted(known, grams[at])
            some = np.minimum(near, len(known) - 1)
            hit = known[some] == grams[at]
            for i, k in zip(at[hit].tolist(), near[hit].tolist()):
                while k < len(known) and known[k] == grams[i]:
                    if _words(low, start, end, i, n) == self.words_at(where[k], n):
                        yield n, i, items[bounds[k] : bounds[k + 1]]
                        break
                    k += 1


def _words(low: np.ndarray, start: np.ndarray, end: np.ndarray, i: int, n: int) -> bytes:
    return b" ".join([low[a:b].tobytes() for a, b in zip(start[i : i + n].tolist(), end[i : i + n].tolist())])


def scan_block(index: WindowIndex, data: np.ndarray, offsets: np.ndarray):
    """words per document, and for documents with verified hits: {document: (hit word mask, items)}."""
    n_docs = len(offsets) - 1
    low = tx.LOWER[data]
    start, end, doc = tx.split_words(low, offsets, tx.ALNUM)
    n_words = np.bincount(doc, minlength=n_docs)
    if not len(start):
        return n_words, {}
    words = tx.range_hash(tx.prefix_sums(low), start, end)
    first = np.concatenate(([0], np.cumsum(n_words)))
    found: dict = {}
    for n, i, items in index.hits(words, doc, low, start, end):
        d = int(doc[i])
        if d not in found:
            found[d] = (np.zeros(n_words[d], bool), set())
        found[d][0][i - first[d] : i - first[d] + n] = True
        found[d][1].update(items.tolist())
    return n_words, found


def clean_text(index: WindowIndex, text: str) -> str:
    """The text without hit words; again while the rest forms windows anew."""
    raw = np.frombuffer(text.encode(), np.uint8)
    low = tx.LOWER[raw]
    start, end, doc = tx.split_words(low, np.array([0, len(raw)]), tx.ALNUM)
    words = tx.range_hash(tx.prefix_sums(low), start, end)
    keep = np.ones(len(raw), bool)
    reach = max(index.by_length, default=1) - 1
    look = np.arange(len(start))  # words to look at, by their number among those left
    while len(look):
        part = np.cumsum(np.append(0, np.diff(look) > 1))
        gone = np.zeros(len(start), bool)
        for n, i, _ in index.hits(words[look], part, low, start[look], end[look]):
            gone[look[i : i + n]] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            keep[start[a] : end[b - 1]] = False
        cut = edge[::2] - np.concatenate(([0], np.cumsum(edge[1::2] - edge[::2])))[:-1]  # where words left meet
        start, end, words = start[~gone], end[~gone], words[~gone]
        near = (cut[:, None] + np.arange(-reach, reach)).ravel()
        look = np.unique(near[(near >= 0) & (near < len(start))])
    return raw[keep].tobytes().decode()


def _index(benchmark: DataFrame, text: str, item_id: str) -> WindowIndex | None:
    """The items' windows, or None if they are too many for a broadcast."""
    lean = benchmark.select(F.col(item_id).cast("string").alias("item"), text_or_empty(text).alias("text"))
    size = lean.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > MAX_BROADCAST_BYTES:
        return None
    index = WindowIndex([tuple(r) for r in lean.collect()])
    return index if index.nbytes() <= MAX_INDEX_BYTES else None


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", clean: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array of strings); with ``clean`` also cleaned: the text without hit spans."""
    small_batches(docs.sparkSession)
    index = _index(benchmark, text, item_id)
    if index is None:
        return joined_hits(docs, benchmark, text, doc_id, item_id, clean)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(1)
            words, hit, names, cleaned = [], [], [], []
            for row, end, data, offsets in tx.blocks(texts):
                n_words, found = scan_block(index, data, offsets)
                words += n_words.tolist()
                for d in range(end - row):
                    mask, own = found.get(d, (None, ()))
                    hit.append(int(mask.sum()) if mask is not None else 0)
                    names.append(sorted(index.names[i] for i in own if index.names[i] is not None))
                    if clean:
                        cleaned.append(clean_text(index, texts[row + d].as_py()) if mask is not None else texts[row + d].as_py())
            out = {"doc_id": batch.column(0), "n_words": pa.array(words, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "items": pa.array(names, pa.list_(pa.string()))}
            if clean:
                out["cleaned"] = pa.array(cleaned, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    id_type = lean.schema["doc_id"].dataType.simpleString()
    return lean.mapInArrow(tx.lean(run), f"doc_id {id_type}, n_words bigint, n_hit bigint, items array<string>" + ", cleaned string" * clean)


def _windows(texts: pa.Array, lengths: list[int], spelt: bool = False):
    """For each length: row, position, two independent hashes and (if spelt) the words of every window; words of each text."""
    for row, _, data, offsets in tx.blocks(texts):
        low = tx.LOWER[data]
        start, end, doc = tx.split_words(low, offsets, tx.ALNUM)
        if not len(start):
            continue
        one, two = (tx.range_hash(tx.prefix_sums(low, kind), start, end, kind) for kind in (0, 1))
        first = np.searchsorted(doc, np.arange(len(offsets)))
        for n in lengths:
            a, b = tx.gram_hash(one, n), tx.gram_hash(two, n)
            at = np.flatnonzero(doc[: len(a)] == doc[n - 1 :]) if len(a) else np.zeros(0, np.int64)
            yield n, row + doc[at], at - first[doc[at]], a[at], b[at], np.diff(first), [_words(low, start, end, i, n) for i in at.tolist()] if spelt else []


def joined_hits(docs: DataFrame, benchmark: DataFrame, text: str, doc_id: str, item_id: str, clean: bool = False, window: int = WINDOW) -> DataFrame:
    """The same result as scan() for a benchmark of any size: a join by window hash.

    Documents are numbered first, so repeated doc_ids stay apart. Hits and items of a
    document are gathered by document only.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "decontaminate-rows")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))

    def item_windows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.column(1).slice(i, 1)
                n_words = max((int(x[5][0]) for x in _windows(one, [1])), default=0)
                for n, row, _, a, b, _, spelt in _windows(one, [min(window, n_words)] if n_words else [], True):
                    yield pa.RecordBatch.from_pydict({"item": pa.array([batch.column(0)[i].as_py()] * len(row), pa.string()), "n": pa.array([n] * len(row), pa.int32()), "a": tx.signed(a), "b": tx.signed(b), "words": pa.array(spelt, pa.binary())})

    known = materialise(items.mapInArrow(tx.lean(item_windows), "item string, n int, a bigint, b bigint, words binary").distinct(), "decontaminate-windows")
    different = materialise(known.select("n", "a", "b", "words").distinct(), "decontaminate-different")
    lengths = sorted(r[0] for r in different.select("n").distinct().collect())
    n_words = 1 << 10
    while n_words < min(different.count() // 4, MAX_TABLE_WORDS):
        n_words *= 2
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("a").bitwiseAND(F.lit(63)).cast("int"))
    bits = different.groupBy(F.shiftrightunsigned("a", 6).bitwiseAND(F.lit(n_words - 1)).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(n_words, np.uint64)
    table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def doc_windows(batches):
        table = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for n, row, at, a, b, *_ in _windows(batch.column(1), lengths):
                some = np.flatnonzero(table[(a >> np.uint64(6) & np.uint64(n_words - 1)).astype(np.int64)] >> (a & np.uint64(63)) & np.uint64(1))
                yield pa.RecordBatch.from_pydict({"row": ids[row[some]], "at": at[some], "n": pa.array(np.full(len(some), n, np.int32)), "a": tx.signed(a[some]), "b": tx.signed(b[some])})

    salted = different.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def hits_of(texts: DataFrame) -> DataFrame:
        found = texts.select("row", "text").mapInArrow(tx.lean(doc_windows), "row bigint, at bigint, n int, a bigint, b bigint")
        found = found.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["n", "a", "b", "salt"])
        return found.groupBy("row").agg(F.collect_list(F.struct("at", "n", "a", "b", "words")).alias("hits"))

    def finish(batches):
        for batch in batches:
            out = {"row": batch.column(0), "n_words": [], "n_hit": [], "windows": [], "cleaned": []}
            for t, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = np.frombuffer((t or "").encode(), np.uint8)
                low = tx.LOWER[raw]
                start, end, _ = tx.split_words(low, np.array([0, len(raw)]), tx.ALNUM)
                mask, keep, sure = np.zeros(len(start), bool), np.ones(len(raw), bool), {}
                for h in hits or ():
                    if _words(low, start, end, h["at"], h["n"]) == h["words"]:
                        mask[h["at"] : h["at"] + h["n"]] = True
                        sure[h["n"], h["words"]] = {k: h[k] for k in ("n", "a", "b", "words")}
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    keep[start[a] : end[b - 1]] = False
                out["n_words"].append(len(start))
                out["n_hit"].append(int(mask.sum()))
                out["windows"].append(list(sure.values()))
                out["cleaned"].append(t if t is None or keep.all() else raw[keep].tobytes().decode())
            kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "cleaned": pa.string(), "windows": pa.list_(pa.struct([("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("words", pa.binary())]))}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) if k in kinds else v for k, v in out.items()})

    def cut(texts: DataFrame, how: str) -> DataFrame:
        both = texts.select("row", "text").join(hits_of(texts), "row", how).select("row", "text", "hits")
        return both.mapInArrow(tx.lean(finish), "row bigint, n_words bigint, n_hit bigint, windows array<struct<n:int,a:bigint,b:bigint,words:binary>>, cleaned string")

    first = materialise(cut(rows, "left"), "decontaminate-cut")
    named = first.filter("n_hit > 0").select("row", F.inline("windows")).join(known, ["n", "a", "b", "words"])
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = first.drop("windows").join(named, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    if clean:
        # the rest of a cut text may form windows anew: changed texts are cut again until none is hit
        changed, later = first.filter("n_hit > 0").select("row", F.col("cleaned").alias("text")), []
        while True:
            again = materialise(cut(changed, "inner").filter("n_hit > 0").select("row", F.col("cleaned").alias("text")), "decontaminate-again")
            if again.isEmpty():
                break
            later.append(again.select("row", F.lit(len(later)).alias("turn"), F.col("text").alias("again")))
            changed = again
        if later:
            last = functools.reduce(DataFrame.unionByName, later).groupBy("row").agg(F.max_by("again", "turn").alias("again"))
            result = result.join(last, "row", "left").withColumn("cleaned", F.coalesce("again", "cleaned"))
    return result.join(rows.select("row", "doc_id"), "row").select("doc_id", "n_words", "n_hit", "items", *["cleaned"] * clean)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", drop_documents: bool = False) -> DataFrame:
    """docs with hit spans cut out of text, or with ``drop_documents`` those without hits; all columns stay."""
    index = _index(benchmark, text, item_id)
    if index is None:
        numbered = number(docs, doc_id, text)
        found = joined_hits(lean_rows(numbered, text, doc_id).select("row", "text"), benchmark, "text", "row", item_id, clean=True).filter("n_hit > 0")
        if drop_documents:
            return without_rows(numbered, found.select(F.col("doc_id").alias("row"))).select(*docs.columns)
        both = numbered.join(found.select(F.col("doc_id").alias("__row"), F.col("cleaned").alias("__cleaned")), "__row", "left")
        return both.withColumn(text, F.coalesce("__cleaned", text)).select(*docs.columns)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts, out = batch.column(at_text), {}
            for row, _, data, offsets in tx.blocks(texts):
                for d in scan_block(index, data, offsets)[1]:
                    out[row + d] = None if drop_documents else clean_text(index, texts[row + d].as_py())
            if drop_documents:
                yield batch.filter(pa.array([i not in out for i in range(batch.num_rows)], pa.bool_()))
            elif out:
                own = [out.get(i, texts[i].as_py()) for i in range(batch.num_rows)]
                yield batch.set_column(at_text, batch.schema.field(at_text), pa.array(own, texts.type))
            else:
                yield batch

    return docs.mapInArrow(tx.lean(run), fields(docs))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE_SQL = {
    "op7_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
}
