"""Near-duplicate detection by SimHash fingerprints and Golay-code fuzzy hashing.

1. A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of a
   text's word shingles, repeats included. Texts with equal fingerprints are one node.
2. A fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that
   differ in at most two bits agree in one segment at least, and in any other one they differ
   in two bits at most (pigeonhole).
3. The binary Golay code of length 23 is perfect: every word of 23 bits is within three
   bits of just one of the 4096 codewords. Two segments at two bits or less have a word in
   between, at most one bit from either; so if a segment's keys are the codewords to which it and all its
   one-bit neighbours decode, at most six, both have that word's codeword among them.
   The join key is a segment as it is, together with one codeword of the segment after it:
   up to 18 keys of 36 bits a fingerprint.
4. Fingerprints that meet in a key are verified by the number of differing bits. Keys of more
   than ``LIST`` fingerprints (many near copies of one text) take another exact way: all
   their fingerprints are dealt to themselves and their 64 one-bit neighbours. Those that
   meet there, 65 at most, are all within two bits of each other, and two fingerprints within two bits
   always meet; so linking each to the smallest keeps every component without making pairs.
5. Connected components follow. Copies stay one node until the end.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and are
linked like any other; texts with fewer words than a shingle are one shingle; rows that repeat
a doc_id are separate rows; null ids are larger than any other, a component of null ids only
has a null component_id; a text of any length is taken whole, in pieces of bounded size; an
empty table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import join_counted, lean_rows, materialise, number, small_batches, without_rows
from .graph import binary, components

#: Seed of XXH64.
SEED = 42
#: First bit and length of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code.
GENERATOR = 0b101011100011
#: Fingerprints of a key that are compared with each other.
LIST = 64
#: Shingles whose bits are counted at once, bytes of a long text that are split at once.
CHUNK, PIECE = 1 << 14, 1 << 19


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte of a word (3 x 256), error of each syndrome (2048)."""

    def syndrome(word: int) -> int:
        for bit in range(23, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << bit - 11
        return word

    of_byte = np.array([[syndrome(b << 8 * i) if b << 8 * i < 1 << 23 else 0 for b in range(256)] for i in range(3)], np.int32)
    error = np.zeros(2048, np.int32)
    one = [1 << i for i in range(23)]
    for a in range(23):
        error[syndrome(one[a])] = one[a]
        for b in range(a):
            error[syndrome(one[a] | one[b])] = one[a] | one[b]
            for c in range(b):
                error[syndrome(one[a] | one[b] | one[c])] = one[a] | one[b] | one[c]
    return of_byte, error


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword next to each word of 23 bits: its upper 12 bits, which tell codewords apart."""
    of_byte, error = golay_tables()
    s = of_byte[0][words & 255] ^ of_byte[1][words >> 8 & 255] ^ of_byte[2][words >> 16]
    return (words ^ error[s]) >> 11


def near_codewords(segments: np.ndarray, bits: int) -> np.ndarray:
    """Codewords of each segment and its one-bit neighbours, ascending; -1 where one repeats."""
    flips = np.concatenate(([0], 1 << np.arange(bits)))
    found = np.sort(decode(segments[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """key, index of the fingerprint, of every key of every fingerprint (unsigned)."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    out, rows = [], []
    for s in range(3):
        after = (s + 1) % 3
        near = near_codewords(parts[after], SEGMENTS[after][1])
        row, col = np.nonzero(near >= 0)
        out.append((s << 34) | (parts[s][row] << 12) | near[row, col])
        rows.append(row)
    return np.concatenate(out), np.concatenate(rows)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of each byte range."""
    body = data.tobytes()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[s:e], SEED) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))


def _votes(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> None:
    """Add to counts (documents x 64) the set bits of each hash; doc ascends."""
    for at in range(0, len(hashes), CHUNK):
        h, d = hashes[at : at + CHUNK], doc[at : at + CHUNK]
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        counts[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)


def _single_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bytes with one space between words, and start, end, document of each word in them."""
    start, end, doc = textops.split_words(data, offsets, textops.NOT_SPACE)
    out = data.copy()
    use = textops.NOT_SPACE[data]
    followed = end[:-1][doc[1:] == doc[:-1]] if len(doc) else end
    out[followed], use[followed] = 0x20, True
    moved = np.concatenate(([0], np.cumsum(use)))[start]
    return out[use], moved, moved + (end - start), doc


def block_prints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each document of a block."""
    n_docs = len(offsets) - 1
    counts, shingles = np.zeros((n_docs, 64), np.int64), np.zeros(n_docs, np.int64)
    data = textops.LOWER[data]
    pieces = textops.pieces(data, PIECE) if n_docs == 1 else [data]
    carried = np.zeros(0, np.uint8)
    for piece in pieces:
        if n_docs == 1:
            piece = np.concatenate((carried, piece))
        body, start, end, doc = _single_spaced(piece, np.array([0, len(piece)]) if n_docs == 1 else offsets)
        whole = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1]) if len(doc) >= size else np.zeros(0, np.int64)
        d = doc[whole]
        _votes(_hashes(body, start[whole], end[whole + size - 1]), d, counts)
        np.add.at(shingles, d, 1)
        if n_docs == 1:  # the last words begin shingles of the next piece
            keep = start[-(size - 1) :] if size > 1 else start[:0]
            carried = np.concatenate((body[keep[0] :], np.array([0x20], np.uint8))) if len(keep) else carried[:0]
            if len(start) < size:
                short = body, start, end, doc
        else:
            short = body, start, end, doc
    if n_docs == 1 and shingles[0] == 0 and len(data) or n_docs > 1:
        body, start, end, doc = short
        few = np.flatnonzero((shingles[doc] == 0) & np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else doc
        last = np.searchsorted(doc, doc[few], "right") - 1
        _votes(_hashes(body, start[few], end[last]), doc[few], counts)
        shingles[doc[few]] = 1
    ones = 2 * counts > shingles[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """row, doc_id, fp (long) of every one of rows (row, doc_id, text)."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_prints(data, offsets, shingle) for _, _, data, offsets in textops.blocks(batch.column(2))]
            if found:
                fp = pa.array(textops.signed(np.concatenate(found)))
                yield pa.record_batch([batch.column(0), batch.column(1), fp], names=["row", "doc_id", "fp"])

    return rows.select("row", "doc_id", "text").mapInArrow(textops.lean(run), "row long, doc_id long, fp long")


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, row = keys(prints)
            yield pa.record_batch([pa.array(key), pa.array(textops.signed(prints[row]))], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(textops.lean(run), "key long, fp long")


def star_links(prints: DataFrame) -> DataFrame:
    """a, b: links that join all fingerprints within two bits, by their common one-bit neighbours."""
    one = F.lit(1).cast("long")
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i))))
    met = prints.select("fp", F.explode(near).alias("at")).groupBy("at").agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter("size(fps) > 1")
    return met.select(F.explode(F.slice("fps", 2, 64)).alias("a"), F.col("fps")[0].alias("b"))


def links(nodes: DataFrame) -> DataFrame:
    """a, b: verified links between fingerprints of nodes (fp, unique) that give all components."""
    keyed = materialise(_keyed(nodes), "simhash-keys")
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "simhash-sizes")
    met = join_counted(keyed.select(binary("key").alias("key"), "fp"), sizes.select(binary("key").alias("key"), "size"), "key", "size", keyed.count(), F.col("fp"))
    met = materialise(met.filter("size IS NOT NULL").select("key", "fp", "size"), "simhash-met")
    few = met.filter(F.col("size") <= LIST)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & close).select("a", "b")
    crowded = met.filter(F.col("size") > LIST).select("fp").distinct()
    return pairs.unionByName(star_links(crowded))


def group(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """row, doc_id, fingerprint (hex), component_id, kept of rows (row, doc_id, text)."""
    prints = materialise(fingerprints(rows, shingle), "simhash-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-nodes")
    labels = components(links(nodes)).select(F.col("node").alias("fp"), binary("label").alias("label"))
    linked = materialise(labels.join(nodes, "fp"), "simhash-linked")
    firsts = linked.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = join_counted(linked.select("fp", "label"), firsts, "label", "members", linked.count(), F.col("fp"))
    # a linked fingerprint without an id of its own takes the component's, one without links its smallest id
    named = nodes.join(named.select("fp", "component_id"), "fp", "left")
    of_print = named.select(binary("fp").alias("key"), "n", F.coalesce("component_id", "first_id").alias("component_id"))
    found = join_counted(prints.select("row", "doc_id", binary("fp").alias("key")), of_print, "key", "n", prints.count(), F.coalesce("doc_id", "row"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("row", "doc_id", F.lower(F.hex("key")).alias("fingerprint"), "component_id", kept.alias("kept"))


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex), component_id, kept."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return group(rows, shingle).drop("row")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their component, with all their columns."""
    numbered = number(docs, doc_id, text)
    found = group(lean_rows(numbered, text, doc_id), shingle)
    return without_rows(numbered, found.filter("NOT kept"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return annotate(docs, shingle=3).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op12_simhash_dedup": op12_simhash_dedup}
#: SQL has no XXH64; tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {}
