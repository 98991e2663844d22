"""SentencePiece encoding with N-best segmentation, and decoding.

A text's pieces form a lattice; a segmentation is a path, its score the sum of
its pieces' scores. Forward Viterbi gives the best score of every prefix. These
are the exact heuristics of an A-star search from the end backwards, which
therefore yields the N best segmentations in order and expands nothing else.

No piece of such models crosses from a word to the next space or over a line
feed (checked when a model is read; a model with such pieces is handled as one
word a text). So a text's lattice is a chain of independent word lattices:

* distinct words are segmented once, many of about one length at a time, by a
  vectorised forward Viterbi pass that keeps the two best scores;
* the N best segmentations of a text differ from the best one only in its N - 1
  words with the least loss to their second best. A-star runs on those words (and
  on words of more than ``MAX_WORD`` bytes), and their lists are combined. That is
  exact: a word's lattice meets its neighbours' at one node.

Text is encoded as it is, with one space put before it: spaces are the pieces'
U+2581, characters without a piece (and U+2581 itself) become byte pieces at a
penalty of 10 below the least score of a piece (runs of spaces aside). Decoding gives back exactly the text.

Defined cases: null and empty texts have no pieces and score 0; texts of any
length are encoded whole, in time in proportion to it; ties keep the segmentation whose last piece is longer;
repeated doc_ids are separate rows; other columns stay as they are, but for
those named like a result; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import fields, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
PENALTY = 10.0
#: Longer words are segmented one by one.
MAX_WORD = 48
#: Words up to each of these lengths are segmented together, padded.
LENGTHS = (0, 5, 8, 11, 14, 18, 24, 48)
MAX_KNOWN = 200_000
#: Words segmented together; bytes of text encoded together.
GROUP, BLOCK = 1 << 13, 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.uint64(0x100000001B3)

#: Result columns: ids of the best segmentation; nbest: score and, against the best,
#: the replaced ranges of ids with what replaces them.
ENCODED = "ids array<int>, score double, nbest array<struct<score:double,edits:array<struct<first:int,length:int,ids:array<int>>>>>"


class Pieces:
    """Vocabulary of a model, with spaces instead of U+2581."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        self.score_of: dict[bytes, float] = {}
        self.id_of: dict[bytes, int] = {}
        for i in range(n):
            name = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                raw = name.replace("▁", " ").encode()
                self.text[i], self.id_of[raw], self.score_of[raw] = raw, i, p.get_score(i)
        self.unknown = min(v for x, v in self.score_of.items() if x.strip(b" ")) - PENALTY
        self.longest = max(map(len, self.id_of))
        self.by_words = not any((b" " in x[1:] and x.strip(b" ")) or b"\n" in x for x in self.id_of)
        keys = np.array([self._hash(x) for x in self.id_of], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        assert (self.keys[1:] != self.keys[:-1]).all()
        self.ids = np.array(list(self.id_of.values()), np.int64)[order]
        self.scores = np.array(list(self.score_of.values()))[order]
        self.bits = np.uint64(64 - 20)
        # a slot has 1 if some piece begins so, 2 more if one is that
        self.table = np.zeros(1 << 20, np.uint8)
        begins = np.array(list({self._hash(x[:k]) for x in self.id_of for k in range(1, len(x) + 1)}), np.uint64)
        self.table[self.slot(begins)] = 1
        self.table[self.slot(self.keys)] = 3
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in self.text])))

    @staticmethod
    def _hash(raw: bytes) -> int:
        h = 0
        for b in raw:
            h = (h * int(_BYTE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h * _MULTIPLIER >> self.bits).astype(np.int64)

    def segment_all(self, words: np.ndarray, size_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best two scores of words (rows of bytes, padded), and the best one's last piece (-1: bytes) and its length at each end."""
        m, size = words.shape
        best = np.full((size + 1, m), -np.inf)
        second = np.full((size + 1, m), -np.inf)
        piece = np.full((size + 1, m), -1, np.int64)
        length = np.zeros((size + 1, m), np.int64)
        best[0] = 0
        wide = words.astype(np.uint64)
        chars = np.where(words < 0x80, 1, np.where(words >= 0xF0, 4, np.where(words >= 0xE0, 3, np.where(words >= 0xC0, 2, 0))))
        chars[np.arange(size)[None, :] >= size_of[:, None]] = 0

        def reach(end: int, who: np.ndarray, start: int, gain, name, n: int) -> None:
            one, two = best[start, who] + gain, second[start, who] + gain
            old, low = best[end, who], second[end, who]
            better = one > old
            best[end, who] = np.where(better, one, old)
            second[end, who] = np.maximum(np.where(better, old, np.maximum(low, one)), np.where(better, two, low))
            piece[end, who] = np.where(better, name, piece[end, who])
            length[end, who] = np.where(better, n, length[end, who])

        for start in range(size):
            own = np.flatnonzero((best[start] > -np.inf) & (chars[:, start] > 0))
            if not len(own):
                continue
            char = chars[own, start]
            single = np.zeros(len(own), bool)
            live, h = np.arange(len(own)), np.zeros(len(own), np.uint64)
            for n in range(1, min(self.longest, size - start) + 1):
                h = h * _BYTE + wide[own[live], start + n - 1] + np.uint64(1)
                kind = self.table[self.slot(h)]
                some = np.flatnonzero(kind & 2)
                if len(some):
                    near = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
                    hit = self.keys[near] == h[some]
                    some, near = some[hit], near[hit]
                    reach(start + n, own[live[some]], start, self.scores[near], self.ids[near], n)
                    single[live[some]] |= char[live[some]] == n
                if n <= 4:
                    lone = np.flatnonzero((char == n) & ~single)
                    if len(lone):
                        reach(start + n, own[lone], start, self.unknown, -1, n)
                keep = kind > 0
                live, h = live[keep], h[keep]
                if not len(live) and n >= 4:
                    break
        at = np.arange(m)
        return best[size_of, at], second[size_of, at], piece, length

    def edges(self, word: bytes) -> list[list[tuple[int, int]]]:
        """By end: (start, id or -1), the lattice of a word."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
        for start in range(len(word)):
            lead = word[start]
            if 0x80 <= lead < 0xC0:
                continue
            for end in range(start + 1, min(len(word), start + self.longest) + 1):
                found = self.id_of.get(word[start:end])
                if found is not None:
                    out[end].append((start, found))
            end = start + (1 if lead < 0x80 else 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2)
            if word[start:end] not in self.id_of:
                out[end].append((start, -1))
        return out

    def expand(self, word: bytes, path: list[tuple[int, int, int]]) -> list[int]:
        """Ids of a path of (start, end, id or -1)."""
        return [i for a, b, k in path for i in ([k] if k >= 0 else self.byte_id[list(word[a:b])].tolist())]

    def nbest(self, word: bytes, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations: backward A-star whose heuristics are the forward Viterbi scores.

        Of equal scores the path that has come further goes on, and no end is taken up more than n times: later ways
        to it are worse than n others. So time is in proportion to the word's length, however many ties it has.
        """
        lattice = self.edges(word)
        gain = lambda a, b, k: self.score_of[word[a:b]] if k >= 0 else self.unknown
        ahead = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start, k in lattice[end]:
                ahead[end] = max(ahead[end], ahead[start] + gain(start, end, k))
        out: list = []
        queue = [(-ahead[len(word)], len(word), 0, 0.0, None)]
        number = 1
        taken = [0] * (len(word) + 1)
        while queue and len(out) < n:
            _, at, _, done, path = heapq.heappop(queue)
            if taken[at] == n:
                continue
            taken[at] += 1
            if at == 0:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                out.append((done, self.expand(word, steps)))
                continue
            for start, k in lattice[at]:
                if taken[start] < n:
                    score = done + gain(start, at, k)
                    heapq.heappush(queue, (-(score + ahead[start]), start, number, score, ((start, at, k), path)))
                    number += 1
        return out


class Words:
    """Segmentations of distinct words, kept from block to block up to MAX_KNOWN words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The index of each of these distinct words, after what is new is segmented."""
        if len(self.index) > MAX_KNOWN:
            self.clear()
        found = np.array([self.index.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            names = [words[k] for k in new.tolist()]
            found[new] = len(self.index) + np.arange(len(new))
            self.index.update(zip(names, found[new].tolist()))
            self._segment(names)
        return found

    def _segment(self, words: list[bytes]) -> None:
        pieces, n = self.pieces, len(words)
        scores, gaps = np.zeros(n), np.full(n, np.inf)
        size = np.fromiter(map(len, words), np.int64, n)
        parts, owner = [], []
        for u in np.flatnonzero(size > MAX_WORD).tolist():
            two = pieces.nbest(words[u], 2)
            scores[u] = two[0][0]
            gaps[u] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
            parts.append(np.array(two[0][1], np.int64))
            owner.append(np.full(len(parts[-1]), u))
        for low, high in zip(LENGTHS[:-1], LENGTHS[1:]):
            every = np.flatnonzero((size > low) & (size <= min(high, MAX_WORD)))
            for group in np.split(every, range(GROUP, len(every), GROUP)):
                if not len(group):
                    continue
                own, m = size[group], len(group)
                w = int(own.max())
                grid = np.frombuffer(b"".join(words[u].ljust(w, b"\0") for u in group.tolist()), np.uint8).reshape(m, w)
                best, second, piece, length = pieces.segment_all(grid, own)
                scores[group], gaps[group] = best, best - second
                ids = np.full((m, w), -1, np.int64)  # by start byte; -1: no piece starts here
                end, live = own.copy(), np.arange(m)
                while len(live):
                    n_bytes, k = length[end[live], live], piece[end[live], live]
                    start = end[live] - n_bytes
                    ids[live, start] = k
                    for raw in np.flatnonzero(k < 0).tolist():
                        u, a = live[raw], start[raw]
                        ids[u, a : a + n_bytes[raw]] = pieces.byte_id[grid[u, a : a + n_bytes[raw]]]
                    end[live] = start
                    live = live[start > 0]
                which, at = np.nonzero(ids >= 0)
                parts.append(ids[which, at])
                owner.append(group[which])
        owner, flat = np.concatenate(owner), np.concatenate(parts)
        count = np.bincount(owner, minlength=n)
        self.ids = np.concatenate((self.ids, flat[np.argsort(owner, kind="stable")].astype(np.int32)))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(count)))
        self.score, self.gap = np.concatenate((self.score, scores)), np.concatenate((self.gap, gaps))


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated slices flat[at[k]:at[k + 1]] for k in which, and the bounds of each."""
    size = at[which + 1] - at[which]
    bounds = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(bounds[-1]) + np.repeat(at[which] - bounds[:-1], size)
    return flat[index], bounds


def encode_block(words: Words, data: np.ndarray, offsets: np.ndarray, n_best: int) -> list[tuple]:
    """(ids, score, nbest) of each text of a block."""
    pieces = words.pieces
    n_docs = len(offsets) - 1
    full = np.diff(offsets) > 0
    put = offsets[:-1][full]
    text = np.insert(data, put, 32)
    offsets = offsets + np.concatenate(([0], np.cumsum(full)))
    if not len(text):
        return [(np.zeros(0, np.int32), 0.0, [(0.0, [])]) for _ in range(n_docs)]
    start = np.zeros(len(text), bool)
    start[offsets[:-1][full]] = True
    if pieces.by_words:
        space, line = text == 32, text == 10
        start |= line
        start[1:] |= line[:-1] | space[1:] & ~space[:-1]
    start = np.flatnonzero(start)
    end = np.append(start[1:], len(text))
    h = tx.mix(tx.range_hash(tx.prefix_sums(text), start, end) + (end - start).astype(np.uint64))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    raw = text.tobytes()
    names = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
    which = words.lookup(names)[which]
    ids, bounds = _gather(words.ids, words.at, which)
    doc_at = np.searchsorted(start, offsets)
    total = np.concatenate(([0.0], np.cumsum(words.score[which])))
    lists: dict[int, list] = {}
    out = []
    for d in range(n_docs):
        a, b = doc_at[d], doc_at[d + 1]
        score = float(words.score[which[a:b]].sum()) if b - a < 64 else float(total[b] - total[a])
        gaps = words.gap[which[a:b]]
        few = min(n_best - 1, b - a)
        chosen = np.argpartition(gaps, few - 1)[:few] if 0 < few < b - a else np.arange(few)
        chosen = a + np.sort(chosen[gaps[chosen] < np.inf])
        combos: list = [(0.0, ())]
        for t in chosen.tolist():
            u = int(which[t])
            if u not in lists:
                lists[u] = pieces.nbest(raw[start[t] : end[t]], n_best)
            options = lists[u]
            combos = sorted(((loss + options[0][0] - s, picks + ((t, r),) if r else picks) for loss, picks in combos for r, (s, _) in enumerate(options)), key=lambda c: c[0])[:n_best]
        base = bounds[a]
        nbest = [(score - loss, [(int(bounds[t] - base), int(bounds[t + 1] - bounds[t]), lists[int(which[t])][r][1]) for t, r in picks]) for loss, picks in combos]
        out.append((ids[base : bounds[b]], score, nbest))
    return out


def decode_ids(pieces: Pieces, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts of lists of ids, each less the space put before it."""
    raw, bounds = _gather(pieces.flat, pieces.at, ids)
    edge = bounds[at]
    full = np.diff(edge) > 0
    keep = np.ones(len(raw), bool)
    keep[edge[:-1][full]] = False
    edge = edge - np.concatenate(([0], np.cumsum(full)))
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(raw[keep].tobytes())])


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The ids of a segmentation in nbest from those of the best."""
    out, at = [], 0
    for e in edits:
        out += ids[at : e["first"]] + list(e["ids"])
        at = e["first"] + e["length"]
    return out + ids[at:]


def _model_bytes(model: str | bytes) -> bytes:
    return model if isinstance(model, bytes) else Path(model).read_bytes()


def encode(docs: DataFrame, text: str = "text", model: str | bytes = MODEL, n_best: int = NBEST) -> DataFrame:
    """docs with ids, score, nbest. The model is read by the driver and broadcast."""
    if n_best < 1:
        raise ValueError("n_best must be 1 or more")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))
    kept = docs.drop("ids", "score", "nbest")
    at_text = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        item = pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))])
        def some(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            for row, end, data, offsets in tx.blocks(table.column(at_text), BLOCK):
                found = encode_block(words, data, offsets, n_best)
                at = np.concatenate(([0], np.cumsum([len(x[0]) for x in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x[0] for x in found])))
                nbest = pa.array([[{"score": s, "edits": [{"first": f, "length": n, "ids": i} for f, n, i in e]} for s, e in x[2]] for x in found], pa.list_(item))
                own = [c.slice(row, end - row).combine_chunks() for c in table.columns]
                own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
                yield pa.RecordBatch.from_arrays([*own, ids, pa.array([x[1] for x in found]), nbest], [*table.schema.names, "ids", "score", "nbest"])
                tx.release()

        words, held, size = Words(pieces), [], 0
        for batch in batches:  # as many as make a block
            held.append(batch)
            size += batch.column(at_text).nbytes
            if size >= BLOCK:
                yield from some(held)
                held, size = [], 0
        if held:
            yield from some(held)

    return kept.mapInArrow(tx.lean(run), f"{fields(kept)}, {ENCODED}")


def decode(encoded: DataFrame, ids: str = "ids", model: str | bytes = MODEL) -> DataFrame:
    """encoded with decoded: the texts of its lists of ids."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(_model_bytes(model))
    kept = encoded.drop("decoded")
    at_ids = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            lists = batch.column(at_ids)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            at = lists.offsets.to_numpy().astype(np.int64)
            texts = decode_ids(pieces, lists.values.to_numpy()[at[0] : at[-1]].astype(np.int64), at - at[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(tx.lean(run), f"{fields(kept)}, decoded string")


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces and score of the best segmentation, scores of the N best, whether decoding gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decode(encode(docs))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), "score",
        F.transform("nbest", lambda x: x["score"]).alias("nbest_scores"), F.xxhash64("nbest").alias("nbest_xxhash64"),
        F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"),
    )


QUERIES = {"op8_piece_codec": op8_piece_codec}
ORACLE_SQL: dict[str, str] = {}
