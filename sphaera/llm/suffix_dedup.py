"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every window of ``WIDTH`` bytes has an *anchor*: the leftmost smallest of the
hashes of the ``GRAM``-byte strings inside. Equal windows have equal anchors, and
one anchor serves a contiguous range of windows, so text is handled a few dozen
windows at a time, wherever it stands.

1. Anchors whose gram occurs once in the corpus cannot have repeated windows.
   Grams are counted by hash, collapsed within each run of a few MB first; what
   travels is some 20 bytes an anchor, no text.
2. For each other anchor, the suffix that starts at it (as far as its windows go)
   and the bytes before it form a unit. Each run of units is sorted by suffix,
   equal units collapse to their first occurrence, and the run is front-coded
   (length of the prefix shared with the unit before, and the rest) and sent to
   the task of its gram.
3. That task merges the runs with a loser tree that keeps, for each waiting
   suffix, the length of the prefix it shares with the last winner: comparisons
   start there, known prefixes are never compared again. The prefixes that
   neighbours share, as the merge gives them, decide what is repeated: a window
   that begins d bytes before its anchor occurs again where the suffixes share
   ``WIDTH - d`` bytes (no smaller shared prefix lies between them) and the d
   bytes before agree. All but the first place in the corpus (smaller doc_id, or
   earlier start) are marked, as ranges of starts.
4. The bytes of marked windows are removed.

Units of one gram meet in one task, so a frequent gram is cut: its unit is divided
into units of ``CUT`` neighbouring windows, or of single ones for the most frequent
grams, each sorted and dealt out by what its windows have in common, which is all
but ``CUT - 1`` bytes of a window. Equal ones collapse within a run as all units do.
A gram counts as frequent from 1000 and 1/4096 of all anchors on, at most from
32768 (and from a 2**21st of the anchors, which bounds the list of frequent grams),
so what a gram brings to a task doesn't grow with the input.

Defined cases: a null text is empty; matches never cross documents; texts of any
length are cut into overlapping chunks for the work; rows that repeat a doc_id are
separate documents in the order of a hash of their text, a null doc_id comes
first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import identify, materialise, small_batches

WIDTH, GRAM = 100, 32
#: Text whose grams, and units, that are collapsed and sorted together.
RUN_BYTES, RUN_UNITS = 4 << 20, 1 << 17
ANCHORS_PER_BUCKET = 1 << 18
#: Windows of a unit of a frequent gram; times as frequent, from which on single windows are dealt.
CUT, SINGLE = 9, 32
_POSITION_BITS = np.uint64(28)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block: position, hash, first and last window start of each anchor, and its document."""
    n, span = len(data), width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none.view(np.uint64), none, none, none
    at = np.arange(n - gram + 1)
    h = tx.mix(tx.range_hash(tx.prefix_sums(data), at, at + gram))
    key = h >> _POSITION_BITS << _POSITION_BITS | at.astype(np.uint64)
    padded = np.full(-(-(len(key) + span) // span) * span, ~np.uint64(0))
    padded[: len(key)] = key
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(key) - span + 1
    low = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    place = (low & (np.uint64(1) << _POSITION_BITS) - np.uint64(1)).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(windows), "right") - 1
    start = np.flatnonzero(np.arange(windows) + width <= offsets[doc + 1])
    if not len(start):
        return none, none.view(np.uint64), none, none, none
    place, doc = place[start], doc[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    p = place[first]
    return p, h[p], start[first], start[last], doc[first]


def chunked_anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of a block; a long text is cut so that each window lies in one chunk."""
    if len(offsets) > 2 or len(data) <= 2 * tx.BLOCK_BYTES:
        yield anchors(data, offsets, width, gram)
        return
    for at in range(0, len(data) - width + 1, tx.BLOCK_BYTES):
        part = data[at : at + tx.BLOCK_BYTES + width - 1]
        p, h, lo, hi, doc = anchors(part, np.array([0, len(part)]), width, gram)
        yield p + at, h, lo + at, hi + at, doc


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches until they hold a run's bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= RUN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


#: kind: 0 grams, 1 units, 3 removed; the rest is packed arrays.
_SCHEMA = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g binary"


def _row(bucket: int, kind: int, *parts: bytes) -> tuple:
    return (bucket, kind, *parts, *[b""] * (7 - len(parts)))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[2:]]], ["bucket", "kind", *"abcdefg"])


def _spread(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    edge = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, edge):
        if len(part):
            yield int(buckets[part[0]]), part


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """bucket, kind and rows of parts, one bucket after the other; rows come sorted by both. Kind 3 comes row by row."""
    key, held = None, []
    for batch in batches:
        for bucket, kind, *parts in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 3:
                yield bucket, kind, [parts]
                continue
            if key != (bucket, kind) and held:
                yield *key, held
                held = []
            key = bucket, kind
            held.append(parts)
    if held:
        yield *key, held


def _gram_rows(n_buckets: int, width: int, gram: int):
    """Each gram of a run once, with its number and its first place; further places of it are known repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, 1):
            parts = []
            for batch in held:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for row, _, data, offsets in tx.blocks(batch.column(1)):
                    for p, h, lo, hi, doc in chunked_anchors(data, offsets, width, gram):
                        place = (p - offsets[doc]) << 16 | (p - lo) << 8 | (p - hi)
                        parts.append((h, ids[row + doc], place))
            h, rows, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            if not len(h):
                continue
            names, first, number = np.unique(h, return_index=True, return_counts=True)
            out = []
            for bucket, at in _spread((names >> np.uint64(32)).astype(np.int64) % n_buckets):
                f = first[at]
                out.append(_row(bucket, 0, _pack(names[at]), _pack(rows[f]), _pack(place[f]), _pack(number[at].astype(np.uint32))))
            again = np.ones(len(h), bool)
            again[first] = False
            if again.any():
                out.append(_row(int(h[0] % np.uint64(n_buckets)), 3, b"", _pack(rows[again]), _pack(place[again]), b""))
            yield _table(out)

    return run


def _repeated_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, place of anchors whose gram occurs again; row null: a frequent gram and its number."""
    for _, kind, blobs in _buckets(batches):
        if kind == 3:
            rows, place = np.frombuffer(blobs[0][1], np.int64), np.frombuffer(blobs[0][2], np.int64)
            yield pa.RecordBatch.from_pydict({"row": rows, "place": place, "number": np.zeros(len(rows), np.int64)})
            continue
        h, rows, place, number = (np.concatenate([np.frombuffer(b[i], t) for b in blobs]) for i, t in enumerate((np.uint64, np.int64, np.int64, np.uint32)))
        names, which = np.unique(h, return_inverse=True)
        total = np.bincount(which, weights=number).astype(np.int64)
        keep = total[which] > 1
        yield pa.RecordBatch.from_pydict({"row": rows[keep], "place": place[keep], "number": np.zeros(int(keep.sum()), np.int64)})
        often = np.flatnonzero(total > 1000)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(often), pa.int64()), pa.array(tx.signed(names[often])), pa.array(total[often])], ["row", "place", "number"])


def _shared_prefix(grid: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before; 0 for the first."""
    out = np.zeros(len(grid), np.int64)
    if len(grid) > 1 and grid.shape[1]:
        differ = grid[1:] != grid[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), grid.shape[1])
    return out


def front_code(suffixes: list[bytes], width: int) -> np.ndarray:
    """Length of the prefix that each sorted suffix shares with the one before."""
    size = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    return _front_code(np.frombuffer(b"".join(s.ljust(width, b"\0") for s in suffixes), np.uint8).reshape(len(suffixes), width), size)


def _front_code(grid: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = _shared_prefix(grid)
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out.astype(np.uint8)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Loser tree over front-coded sorted runs: (run, index, prefix shared with the one before) in sorted order."""
    k = 1
    while k < len(runs):
        k *= 2
    lists = [r[0] for r in runs]
    shared = [r[1] for r in runs]
    at = [0] * k
    common = [0] * k  # of the head of each run with the last winner it lost against
    head: list = [runs[i][0][0] if i < len(runs) and runs[i][0] else None for i in range(k)]
    lost = [-1] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """winner, loser; updates the loser's shared prefix."""
        a, b = head[x], head[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        p, q = common[x], common[y]
        if p != q:  # the longer shared prefix with the same last winner is the smaller
            return (x, y) if p > q else (y, x)
        if a == b:
            w, other = (x, y) if x < y else (y, x)
            common[other] = len(a)
            return w, other
        stop = min(len(a), len(b))
        d = p
        step = 16
        while d < stop and a[d : d + step] == b[d : d + step]:
            d += step
        if d >= stop:
            d = stop
        else:
            while d < stop and a[d] == b[d]:
                d += 1
        if (a[d] < b[d]) if d < stop else len(a) < len(b):
            common[y] = d
            return x, y
        common[x] = d
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser = play(build(2 * node), build(2 * node + 1))
        lost[node] = loser
        return winner

    best = build(1) if k > 1 else 0
    while head[best] is not None:
        i = at[best]
        yield best, i, common[best]
        i += 1
        at[best] = i
        if i < len(lists[best]):
            head[best] = lists[best][i]
            common[best] = shared[best][i]
        else:
            head[best] = None
        node = (best + k) >> 1
        while node:
            best, lost[node] = play(best, lost[node])
            node >>= 1


def joined(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges: those of one row that touch or overlap become one."""
    order = np.lexsort((first, rows))
    rows, first, last = rows[order], first[order], last[order]
    if not len(rows):
        return rows, first, last
    number = np.cumsum(np.append(0, rows[1:] != rows[:-1]))
    far = np.maximum.accumulate(number << 40 | last)
    new = np.ones(len(rows), bool)
    new[1:] = (number << 40 | first)[1:] > far[:-1] + 1
    at = np.flatnonzero(new)
    return rows[at], first[at], far[np.append(at[1:], len(rows)) - 1] & (1 << 40) - 1


def marked(common: np.ndarray, size: np.ndarray, left: np.ndarray, back: np.ndarray, rows: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first, last: ranges of starts of windows that occur earlier.

    Units in the order of their suffixes: the prefix that each shares with the one
    before, its size, the bytes before it (the nearest first, padded) and their
    number, row and position of the anchor.
    """
    none = np.zeros(0, np.int64)
    reach = np.maximum(common, np.append(common[1:], 0))
    some = np.flatnonzero(reach >= width - back)
    if len(some) < 2:
        return none, none, none
    common = np.append(0, np.minimum.reduceat(common[: some[-1] + 1], some[:-1] + 1))
    reach, size, left, back, rows, at = (x[some] for x in (reach, size, left, back, rows, at))
    n, ahead = len(some), width - size
    if left.shape[1]:
        order = np.argsort(np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel(), kind="stable")
        agree = _shared_prefix(left[order])
    else:
        order, agree = np.arange(n), np.zeros(n, np.int64)
    place = np.lexsort((at, rows))
    late = np.zeros((n, int(back.max()) + 3), bool)  # a column free on both sides
    beside = np.empty(n, np.int64)
    for d in range(late.shape[1] - 2):
        here = place[(ahead <= d)[place] & (back >= d)[place] & (reach >= width - d)[place]]
        if len(here) > 1:
            beside[order] = np.cumsum(agree < d)
            same = np.cumsum(common < width - d)[here] * (n + 1) + beside[here]
            again = np.ones(len(here), bool)
            again[np.unique(same, return_index=True)[1]] = False
            late[here[again], d + 1] = True
    step = np.diff(late.astype(np.int8), axis=1)
    who, low = np.nonzero(step == 1)
    high = np.nonzero(step == -1)[1] - 1
    return joined(rows[who], at[who] - high, at[who] - low)


def _gram_hash(grid: np.ndarray, size: int) -> np.ndarray:
    """As anchors() hashes the first bytes of each row."""
    base, power, out = 1, np.uint64(1), np.zeros(len(grid), np.uint64)
    step = tx.BASE
    for k in range(size):
        out += (grid[:, k].astype(np.uint64) + np.uint64(1)) * power
        base = base * step & 0xFFFFFFFFFFFFFFFF
        power = np.uint64(base)
    return tx.mix(out)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """size bytes from start on (with step -1: before it), padded with zeros to width."""
    k = np.arange(width)
    index = start[:, None] + k if step > 0 else start[:, None] - 1 - k
    return np.where(k < size[:, None], data[np.clip(index, 0, len(data) - 1)], np.uint8(0))


def _unit_rows(n_buckets: int, hot: tuple[np.ndarray, np.ndarray], width: int, gram: int):
    """Sorted, front-coded runs of units; what a run itself shows to be repeated."""
    span = width - gram + 1

    def cut(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, row: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """key, row, position, suffix, its size, bytes before, their number of the units of some places."""
        p, back, ahead = place >> 16, place >> 8 & 255, place & 255
        windows = np.full(len(p), span)
        names, cuts = hot
        if len(names):
            base = offsets[row] + p
            h = _gram_hash(_gather(data, base, np.full(len(p), gram), gram), gram)
            near = np.minimum(np.searchsorted(names, h), len(names) - 1)
            windows = np.where(names[near] == h, np.minimum(cuts[near], span), span)
        for w in np.unique(windows).tolist():
            own = np.flatnonzero(windows == w)
            for low in range(0, span, w):
                high = min(low + w, span) - 1
                k = own[(ahead[own] <= high) & (back[own] >= low)]
                for k in np.split(k, range(RUN_UNITS, len(k), RUN_UNITS)):
                    if not len(k):
                        continue
                    at = p[k] - low
                    size = width + low - np.maximum(ahead[k], low)
                    before = np.minimum(back[k], high) - low
                    base = offsets[row[k]] + at
                    suffix = _gather(data, base, size, width)
                    yield _gram_hash(suffix, width - high + low), ids[row[k]], at, suffix, size, _gather(data, base, before, span - 1, -1), before

    def coded(parts: list[tuple]) -> pa.RecordBatch:
        key, rows, at, suffix, size, left, before = (np.concatenate(x) for x in zip(*parts))
        text = lambda grid: np.ascontiguousarray(grid).view(f"S{grid.shape[1]}").ravel() if grid.shape[1] else np.zeros(len(grid), np.int8)
        order = np.lexsort((at, rows, before, text(left), size, text(suffix)))
        key, rows, at, suffix, size, left, before = (x[order] for x in (key, rows, at, suffix, size, left, before))
        new = np.ones(len(key), bool)
        new[1:] = (size[1:] != size[:-1]) | (before[1:] != before[:-1]) | (suffix[1:] != suffix[:-1]).any(1) | (left[1:] != left[:-1]).any(1)
        out, old = [], ~new
        if old.any():
            gone = joined(rows[old], (at - before)[old], (at + size - width)[old])
            out.append(_row(int(tx.mix(gone[0][:1].view(np.uint64))[0] % np.uint64(n_buckets)), 3, *map(_pack, gone)))
        for k, own in _spread((key[new] >> np.uint64(32)).astype(np.int64) % n_buckets):
            own = np.flatnonzero(new)[own]
            grid, n = suffix[own], size[own]
            shared = _front_code(grid, n)
            columns = np.arange(width)
            tails = grid[(columns >= shared[:, None]) & (columns < n[:, None])]
            sides = left[own][np.arange(span - 1) < before[own][:, None]]
            out.append(_row(k, 1, _pack(shared), _pack(n.astype(np.uint8)), tails.tobytes(), _pack(before[own].astype(np.uint8)), sides.tobytes(), _pack(rows[own]), _pack(at[own])))
        return _table(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, places = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            bounds = places.offsets.to_numpy()
            flat, row = places.values.to_numpy()[bounds[0] : bounds[-1]], np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            for first, _, data, offsets in tx.blocks(batch.column(1), 1 << 40):  # one block
                for low in range(0, len(flat), RUN_UNITS):
                    own = slice(low, low + RUN_UNITS)
                    for part in cut(data, offsets, ids, row[own] - first, flat[own]):
                        parts.append(part)
                        held += len(part[0])
                        if held >= RUN_UNITS:
                            yield coded(parts)
                            parts, held = [], 0
        if parts:
            yield coded(parts)

    return run


def _decode(shared: bytes, size: bytes, tails: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for c, n in zip(shared, size):
        before = before[:c] + tails[at : at + n - c]
        at += n - c
        out.append(before)
    return out


def _removed(width: int, gram: int):
    """row, first and last start of repeated windows."""
    span = width - gram + 1

    def merged(blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = [(_decode(b[0], b[1], b[2]), list(b[0])) for b in blobs]
        first = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs])))
        order, common = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        for k, (r, i, shared) in enumerate(merge_runs(runs)):
            order[k], common[k] = first[r] + i, shared
        del runs
        whole = lambda i, kind: np.frombuffer(b"".join(b[i] for b in blobs), kind)
        size, back, rows, at = (whole(i, t)[order] for i, t in ((1, np.uint8), (3, np.uint8), (5, np.int64), (6, np.int64)))
        sides, count = whole(4, np.uint8), whole(3, np.uint8).astype(np.int64)
        left = np.zeros((len(order), span - 1), np.uint8)
        left[np.arange(span - 1) < count[:, None]] = sides
        return marked(common, size.astype(np.int64), left[order], back.astype(np.int64), rows, at, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, blobs in _buckets(batches):
            rows, first, last = (np.frombuffer(x, np.int64) for x in blobs[0][:3]) if kind == 3 else merged(blobs)
            yield pa.RecordBatch.from_pydict({"row": rows, "first": first, "last": last})

    return run


def _frequent(places: DataFrame, n_anchors: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent grams, sorted, and the number of windows to which their units are cut; at most 2**21."""
    floor = max(1000, min(1 << 15, n_anchors >> 12), n_anchors >> 21)
    found = places.filter(f"row IS NULL AND number > {floor}").select("place", "number").toArrow()
    names, number = found.column("place").to_numpy().view(np.uint64), found.column("number").to_numpy()
    order = np.argsort(names)
    return names[order], np.where(number > SINGLE * floor, 1, CUT)[order]


def repeated_windows(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """row, first, last: ranges of starts of windows that occur earlier; rows (row, text) ordered by row."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_anchors = max(1, 2 * size // (width - gram + 2))
    n_buckets = max(12, n_anchors // ANCHORS_PER_BUCKET + 1)
    texts = rows.select("row", "text")
    dealt = lambda df: df.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
    grams = dealt(texts.mapInArrow(tx.lean(_gram_rows(n_buckets, width, gram)), _SCHEMA))
    places = materialise(grams.mapInArrow(tx.lean(_repeated_grams), "row bigint, place bigint, number bigint"), "suffix-anchors")
    hot = _frequent(places, n_anchors)
    wanted = places.filter("row IS NOT NULL").groupBy("row").agg(F.collect_list("place").alias("places"))
    chosen = texts.join(wanted, "row").select("row", "text", "places")
    units = dealt(chosen.mapInArrow(tx.lean(_unit_rows(n_buckets, hot, width, gram)), _SCHEMA))
    return units.mapInArrow(tx.lean(_removed(width, gram)), "row bigint, first bigint, last bigint")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay), one row per row of docs."""
    if not 16 <= gram <= width < gram + 256:
        raise ValueError("gram must have 16 bytes or more, and width at most 255 more than that")
    small_batches(docs.sparkSession)
    rows = identify(docs, text, doc_id, ordered=True)
    found = repeated_windows(rows, width, gram)
    ranges = materialise(found.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "suffix-ranges")
    both = rows.join(ranges.hint("merge"), "row", "left").select("row", "doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for text, own in zip(batch.column(2), batch.column(3)):
                data = (text.as_py() or "").encode()
                count, n_spans = 0, 0
                if own.is_valid:
                    parts, at, end = [], 0, -1
                    for r in sorted((x["first"], x["last"]) for x in own.as_py()):
                        if r[0] > end:  # a gap of unremoved bytes, or none: touching runs are one
                            n_spans += 1
                            parts.append(data[at : r[0]])
                        end = max(end, r[1] + width)
                        at = end
                    parts.append(data[at:])
                    n, data = len(data), b"".join(parts)
                    count = n - len(data)
                size.append(len(data) + count)
                removed.append(count)
                spans.append(n_spans)
                kept.append(data)
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "doc_id": batch.column(1), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return both.mapInArrow(tx.lean(run), "row bigint, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL = {
    "op10_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS g
  FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 100)) AS s FROM d WHERE len(h) >= 200)
), f AS (
  SELECT g, min(doc_id * 4294967296 + s) AS first FROM w GROUP BY g HAVING count(*) > 1
), r AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new
  FROM w JOIN f USING (g) WHERE doc_id * 4294967296 + s > first
), i AS (
  SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM r
), p AS (
  SELECT doc_id, island, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, island
), k AS (
  SELECT p.doc_id, p.island, a, b, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS part
  FROM p JOIN d USING (doc_id) WINDOW o AS (PARTITION BY p.doc_id ORDER BY a)
), t AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(part, '' ORDER BY a) AS parts, max(b) AS last FROM k GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(parts, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
}
