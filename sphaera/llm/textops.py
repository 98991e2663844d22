"""Vectorised word splitting and hashing over Arrow text columns.

All functions work on the UTF-8 bytes of a block of whole documents, in NumPy.
Splitting by bytes is exact for the character classes used here, as they name
ASCII characters only: bytes from 0x80 belong to words or to separators as one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Blocks of whole documents have about this many bytes; one longer document is
#: a block of its own. Bounds the memory of a Python worker.
BLOCK_BYTES = 1 << 19

#: Odd bases of the two independent polynomial hashes; that of the first.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = 0xD6E8FEB86659FD93
BASE = _BASES[0]
_libc = ctypes.CDLL(None)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _power_tables(n: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if kind not in _powers or len(_powers[kind][0]) < n + 1:
        size = max(n + 1, BLOCK_BYTES * 2)
        both = (_BASES[kind], pow(_BASES[kind], -1, 1 << 64))
        _powers[kind] = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, b, np.uint64)))) for b in both)
    return _powers[kind]


def release() -> None:
    """Give memory that is not in use back to the system; workers live longer than tasks."""
    for kind in [k for k, (a, _) in _powers.items() if len(a) > 4 * BLOCK_BYTES]:
        del _powers[kind]
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """The function for mapInArrow, with release() after each task."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return own


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray, kind: int = 0) -> np.ndarray:
    """For range_hash."""
    power = _power_tables(len(data), kind)[0]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hash of the bytes in [start, end), wherever they lie; not mixed."""
    return (sums[end] - sums[start]) * _power_tables(len(sums), kind)[1][start]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, end row, bytes, offsets (rows + 1) of each block; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, body = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and document of each word; words never cross documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Stretches of a text that end behind a separator; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data):
            gap = np.flatnonzero(~NOT_SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end += size
        yield data[at:end]
        at = end


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Mixed hash of each run of n word hashes, by its first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    factor = 1
    for j in range(n):
        out += words[j : len(words) - n + 1 + j] * np.uint64(factor)
        factor = factor * _STEP & 0xFFFFFFFFFFFFFFFF
    return mix(out + np.uint64(n))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def binary_column(rows: np.ndarray) -> pa.Array:
    """Each row of a contiguous 2-d array as one binary value."""
    width = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
