"""Reversible line deduplication.

State of a ``LineIndex``:

* ``refs``, the exact reference counts: how often each document holds each line
  key (shard, key, doc_id, n). Inserting documents appends rows, deleting
  documents takes their rows out again, so every step can be undone exactly.
* ``contested``, from refs: keys that two documents or more hold, with the number
  of documents and the owner, the smallest doc_id.
* ``filters``: one cuckoo filter a shard over the contested keys. Keys that become
  contested are inserted, keys that no longer are get deleted, so the filters
  follow insertions and deletions without being built anew.

To deduplicate, each line is looked up in its shard's filter. Most lines are in
none and stay; the others are checked against the exact table by a join, so a
filter's false positives never decide anything. Filters are broadcast up to
``MAX_FILTER_BYTES`` in all, measured first: then no line shuffles but those that
pass. Beyond that, lines are dealt to their shards' filters, packed (36 bytes a line);
lines of the at most 1024 most frequent keys, known from the exact table, pass on
the spot, so no shard gets a hot key's lines. A shard's filter is built anew when it
fills, and all of them when there are twice as many keys as the shards are made for.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased,
as a 128-bit hash; shorter keys than ``MIN_CHARS`` code points always stay. A
document's lines all stay where it owns their key, repeated ones included.

Defined cases: null and empty texts are one empty line; a null doc_id is smaller
than any other and all such rows are one document; rows that repeat a doc_id are
parts of one document, each with its own result row; texts and lines of any length are
read whole; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import HOT_SHARE, identify, join_counted, lean_rows, materialise, number, small_batches

MIN_CHARS = 10
KEYS_PER_SHARD = 50_000
MAX_FILTER_BYTES = 64 << 20
#: A filter with this share of its slots taken, or so many keys in its stash, is built anew.
MAX_LOAD, MAX_STASH = 0.93, 64
#: Stands for a null doc_id among the owners.
_NO_ID = -(1 << 63)


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, with deletion; the rare keys that find no place go to a stash."""

    SLOTS = 4
    KICKS = 200

    def __init__(self, n_keys: int = 0, table: bytes | None = None, stash: bytes = b"", fixed: bool = False):
        if table is None:
            buckets = 1 << max(4, int(n_keys * 1.3 / self.SLOTS).bit_length())
            self.table = np.zeros((buckets, self.SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS)
            if not fixed:
                self.table = self.table.copy()
        self.stash = set(np.frombuffer(stash, np.uint64).tolist())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (keys & mask).astype(np.int64)
        return prints, first, first ^ (tx.mix(prints.astype(np.uint64)) & mask).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        """Each key once; keys that are in already get a second fingerprint."""
        prints, first, second = self._places(keys)
        left = np.arange(len(keys))
        for where in (first, second):
            for slot in range(self.SLOTS):
                free = left[self.table[where[left], slot] == 0]
                _, one = np.unique(where[free], return_index=True)
                put = free[one]
                self.table[where[put], slot] = prints[put]
                left = np.setdiff1d(left, put, assume_unique=True)
        for i in left.tolist():
            self._kick(int(prints[i]), int(first[i]), int(keys[i]))

    def _kick(self, mark: int, bucket: int, key: int) -> None:
        undo = []
        mask = len(self.table) - 1
        for step in range(self.KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            slot = int(free[0]) if len(free) else step % self.SLOTS
            undo.append((bucket, slot, int(self.table[bucket, slot])))
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            if len(free):
                return
            bucket ^= int(tx.mix(np.array([mark], np.uint64))[0]) & mask
        for bucket, slot, old in reversed(undo):
            self.table[bucket, slot] = old
        self.stash.add(key)

    def delete(self, keys: np.ndarray) -> None:
        """Keys must have been inserted."""
        prints, first, second = self._places(keys)
        for key, mark, a, b in zip(keys.tolist(), prints.tolist(), first.tolist(), second.tolist()):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        found = (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)
        return found | np.isin(keys, np.array(list(self.stash), np.uint64)) if self.stash else found

    def full(self) -> bool:
        return len(self.stash) > MAX_STASH or np.count_nonzero(self.table) > MAX_LOAD * self.table.size

    def row(self, shard: int) -> tuple:
        return shard, self.table.tobytes(), np.array(sorted(self.stash), np.uint64).tobytes(), self.full()


_FILTER = "shard int, buckets binary, stash binary, full boolean"


def _filter_table(shard: int, own: CuckooFilter) -> pa.Table:
    kinds = {"shard": pa.int32(), "buckets": pa.binary(), "stash": pa.binary(), "full": pa.bool_()}
    return pa.table({k: pa.array([v], t) for v, (k, t) in zip(own.row(shard), kinds.items())})


def _built(contested: DataFrame, n_shards: int) -> DataFrame:
    """The filters of contested keys; a shard's keys are bounded, as the number of shards follows theirs."""

    def make(group: pa.Table) -> pa.Table:
        keys = _hash_of(group["key"].to_pylist())
        own = CuckooFilter(len(keys))
        own.insert(keys)
        return _filter_table(group["shard"][0].as_py(), own)

    return contested.select(_shard(n_shards), "key").groupBy("shard").applyInArrow(make, _FILTER)


def _shard(n_shards: int):
    """The key's last four bytes, modulo n_shards, which is a power of two."""
    return F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long").bitwiseAND(F.lit(n_shards - 1)).cast("int").alias("shard")


def _shards_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 16)[:, 12:].copy().view(">u4").ravel().astype(np.int64) & (n_shards - 1)


def block_lines(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Of a block: lines per document, and of eligible lines: document, position in it, two hashes."""
    n_docs, n = len(offsets) - 1, len(data)
    newline = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offsets, newline, "right") - 1
    per_doc = np.bincount(doc_of, minlength=n_docs) + 1
    first = np.concatenate(([0], np.cumsum(per_doc)))
    start = np.empty(first[-1], np.int64)
    doc = np.repeat(np.arange(n_docs), per_doc)
    start[first[:-1]] = offsets[:-1]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    start[inner] = newline + 1
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = offsets[1:]
    solid = np.flatnonzero(tx.NOT_SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = np.flatnonzero(b > a)
    if not len(some):
        return per_doc, some, some, np.zeros((0, 2), np.uint64)
    start, end = solid[a[some]], solid[b[some] - 1] + 1
    chars = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    fit = chars[end] - chars[start] >= min_chars
    some, start, end = some[fit], start[fit], end[fit]
    low = tx.LOWER[data]
    keys = np.empty((len(some), 2), np.uint64)
    for kind in (0, 1):
        keys[:, kind] = tx.mix(tx.range_hash(tx.prefix_sums(low, kind), start, end, kind) + (end - start).astype(np.uint64))
    return per_doc, doc[some], some - first[doc[some]], keys


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """key, doc_id, n of each line key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for row, _, data, offsets in tx.blocks(batch.column(1)):
                _, doc, _, keys = block_lines(data, offsets, min_chars)
                order = np.lexsort((keys[:, 1], keys[:, 0], doc))
                doc, keys = doc[order], keys[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1]).any(1)
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(doc)))
                yield pa.RecordBatch.from_pydict({"key": tx.binary_column(keys[at]), "doc_id": ids[row + doc[at]], "n": pa.array(times.astype(np.int32))})

    return rows.select("doc_id", "text").mapInArrow(tx.lean(run), "key binary, doc_id bigint, n int")


_CANDIDATES = "row bigint, owner_id bigint, key binary, lines array<int>"


def _placed(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, owner, position in the text and key of each line that has a key, block by block of (row, doc_id, text)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        owners = batch.column(1).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for row, _, data, offsets in tx.blocks(batch.column(2)):
            _, doc, at, keys = block_lines(data, offsets, min_chars)
            yield ids[row + doc], owners[row + doc], at, keys


def _grouped(ids: np.ndarray, owners: np.ndarray, at: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Lines of one row and key together."""
    order = np.lexsort((at, keys[:, 1], keys[:, 0], ids))
    ids, owners, at, keys = ids[order], owners[order], at[order], keys[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]).any(1)
    one = np.flatnonzero(new)
    lines = pa.ListArray.from_arrays(pa.array(np.append(one, len(ids)).astype(np.int32)), pa.array(at.astype(np.int32)))
    return pa.RecordBatch.from_pydict({"row": ids[one], "owner_id": owners[one], "key": tx.binary_column(keys[one]), "lines": lines})


def _hash_of(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)[:, 0].copy()


def _contested(refs: DataFrame) -> DataFrame:
    found = refs.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("holders"))
    return found.filter("owner < last").select("key", "owner", "holders")


class LineIndex:
    """See the module's docstring. Each method returns a new index; the old one stays valid."""

    def __init__(self, refs: DataFrame, contested: DataFrame, filters: DataFrame, n_shards: int, min_chars: int, keys_per_shard: int = KEYS_PER_SHARD):
        self.refs, self.contested, self.filters, self.n_shards, self.min_chars, self.keys_per_shard = refs, contested, filters, n_shards, min_chars, keys_per_shard

    @classmethod
    def build(cls, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        refs = materialise(_lines(lean, min_chars), "line-refs")
        contested = materialise(_contested(refs), "line-contested")
        n_shards = cls._shards_for(contested.count(), keys_per_shard)
        return cls(refs, contested, materialise(_built(contested, n_shards), "line-filters"), n_shards, min_chars, keys_per_shard)

    @staticmethod
    def _shards_for(n_keys: int, keys_per_shard: int) -> int:
        return 1 << min(31, (n_keys // keys_per_shard).bit_length())

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The index for new refs, in which only the touched keys may differ."""
        after = materialise(_contested(refs.join(touched, "key", "left_semi")), "line-changed")
        before = self.contested.join(touched, "key", "left_semi")
        delta = after.select("key").exceptAll(before.select("key")).withColumn("up", F.lit(True)).unionByName(before.select("key").exceptAll(after.select("key")).withColumn("up", F.lit(False)))
        delta = delta.select(_shard(self.n_shards), "key", "up")

        def update(key: tuple, old: pa.Table, change: pa.Table) -> pa.Table:
            ups, downs = (_hash_of(change.filter(change["up"] if up else pc.invert(change["up"]))["key"].to_pylist()) for up in (True, False))
            own = CuckooFilter(table=old["buckets"][0].as_py(), stash=old["stash"][0].as_py()) if old.num_rows else CuckooFilter(len(ups))
            own.delete(downs)
            own.insert(ups)
            return _filter_table(key[0].as_py(), own)

        contested = materialise(self.contested.join(touched, "key", "left_anti").unionByName(after), "line-contested")
        n_shards = self._shards_for(contested.count(), self.keys_per_shard)
        if n_shards > 2 * self.n_shards:
            filters = _built(contested, n_shards)
        else:
            n_shards = self.n_shards
            filters = materialise(self.filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInArrow(update, _FILTER), "line-filters")
            full = filters.filter("full").select("shard")
            if not full.isEmpty():
                again = contested.withColumn("__shard", _shard(n_shards)).join(full, F.col("__shard") == F.col("shard"), "left_semi").drop("__shard")
                filters = filters.filter("NOT full").unionByName(_built(again, n_shards))
        return LineIndex(materialise(refs, "line-refs"), contested, materialise(filters, "line-filters"), n_shards, self.min_chars, self.keys_per_shard)

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineIndex:
        lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        new = materialise(_lines(lean, self.min_chars), "line-new")
        return self._changed(self.refs.unionByName(new), new.select("key").distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes the documents named in the first column out again."""
        gone = doc_ids.select(F.coalesce(F.col(doc_ids.columns[0]).cast("long"), F.lit(_NO_ID)).alias("doc_id")).distinct()
        touched = self.refs.join(gone, "doc_id", "left_semi").select("key").distinct()
        return self._changed(self.refs.join(gone, "doc_id", "left_anti").select(*self.refs.columns), touched)

    def candidates(self, rows: DataFrame) -> DataFrame:
        """row, owner_id, key, lines: the lines that pass their shard's filter."""
        size = self.filters.agg(F.sum(F.length("buckets") + F.length("stash"))).first()[0] or 0
        n_shards, min_chars = self.n_shards, self.min_chars
        rows = rows.select("row", "doc_id", "text")
        if size > MAX_FILTER_BYTES:
            return self._dealt(rows)
        shared = rows.sparkSession.sparkContext.broadcast({r["shard"]: (bytes(r["buckets"]), bytes(r["stash"])) for r in self.filters.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter(table=b, stash=s, fixed=True) for k, (b, s) in shared.value.items()}
            for ids, owners, at, keys in _placed(batches, min_chars):
                hit = np.zeros(len(ids), bool)
                shard = _shards_of(keys, n_shards)
                order = np.argsort(shard, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    if len(own) and int(shard[own[0]]) in filters:
                        hit[own] = filters[int(shard[own[0]])].contains(keys[own, 0])
                yield _grouped(ids[hit], owners[hit], at[hit], keys[hit])

        return rows.mapInArrow(tx.lean(run), _CANDIDATES)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The same with lines dealt to their shards' filters, one filter in memory at a time."""
        n_shards, min_chars = self.n_shards, self.min_chars
        floor = max(2, int(self.refs.count() * HOT_SHARE))
        hot = np.sort(np.array(_hash_of([r[0] for r in self.contested.filter(F.col("holders") > floor).select("key").collect()])))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, owners, at, keys in _placed(batches, min_chars):
                out = []
                sure = np.isin(keys[:, 0], hot)
                for kind, some in ((2, np.flatnonzero(sure)), (1, np.flatnonzero(~sure))):
                    # hot keys' lines are spread over all tasks
                    shard = ids[some] & 0xFFFFF if kind == 2 else _shards_of(keys[some], n_shards)
                    order = np.argsort(shard, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                        if len(own):
                            k = some[own]
                            out.append((int(shard[own[0]]), kind, ids[k].tobytes(), owners[k].tobytes(), at[k].astype(np.int32).tobytes(), keys[k].tobytes()))
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("shard", "kind", "a", "b", "c", "d"), zip(*out) if out else [()] * 6, (pa.int32(), pa.int32(), *[pa.binary()] * 4))})

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_shard, own = None, None
            for batch in batches:
                for shard, kind, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns)):
                    if kind == 0:
                        at_shard, own = shard, CuckooFilter(table=a, stash=b, fixed=True)
                        continue
                    ids, owners, at = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, np.int32).astype(np.int64)
                    keys = np.frombuffer(d, np.uint64).reshape(-1, 2)
                    hit = np.full(len(ids), kind == 2)
                    if kind == 1 and shard == at_shard:
                        hit = own.contains(keys[:, 0])
                    yield _grouped(ids[hit], owners[hit], at[hit], keys[hit])

        empty = F.unhex(F.lit(""))
        filters = self.filters.select("shard", F.lit(0).alias("kind"), F.col("buckets").alias("a"), F.col("stash").alias("b"), empty.alias("c"), empty.alias("d"))
        packed = rows.mapInArrow(tx.lean(pack), "shard int, kind int, a binary, b binary, c binary, d binary")
        n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_shards // 64)
        return filters.unionByName(packed).repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(tx.lean(look), _CANDIDATES)

    def deduplicate(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """row, doc_id, n_lines, n_dropped, kept (text): one row per row of docs, which the index must hold."""
        return self.deduplicate_rows(identify(docs, text, doc_id))

    def rewrite(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """docs with the lines dropped from text; the index must hold them."""
        numbered = number(docs, doc_id, text)
        kept = self.deduplicate_rows(lean_rows(numbered, text, doc_id)).select(F.col("row").alias("__row"), F.col("kept").alias("__kept"))
        return numbered.drop(text).join(kept, "__row").withColumn(text, F.col("__kept")).select(*docs.columns)

    def deduplicate_rows(self, rows: DataFrame) -> DataFrame:
        """The same for rows (row, doc_id, text)."""
        small_batches(rows.sparkSession)
        total = self.refs.count()
        checked = join_counted(self.candidates(rows), self.contested, "key", "holders", total, F.col("row"))
        gone = checked.filter("owner IS NOT NULL AND owner <> owner_id").groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("gone"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_lines, n_dropped, kept = [], [], []
                for t, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    lines = (t or "").split("\n")
                    n_lines.append(len(lines))
                    n_dropped.append(len(drop or ()))
                    if drop:
                        out = set(drop)
                        t = "\n".join(x for i, x in enumerate(lines) if i not in out)
                    kept.append(t or "")
                yield pa.RecordBatch.from_pydict({"row": batch.column(0), "doc_id": batch.column(1), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.string())})

        return rows.join(gone, "row", "left").select("row", "doc_id", "text", "gone").mapInArrow(tx.lean(run), "row bigint, doc_id bigint, n_lines bigint, n_dropped bigint, kept string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = LineIndex.build(docs).deduplicate(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line,
         translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), k AS (
  SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM l LEFT JOIN k USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
