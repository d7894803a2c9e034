"""Words and shingles of Arrow text columns as 64-bit hashes, with no Python loop over words.

A word is a maximal run of word bytes in the UTF-8 text. Its hash is a
polynomial over random values of its bytes, taken for all words of a buffer at
once from one running sum. Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32

#: What tables map bytes between words to: no byte of UTF-8 text has this value.
BREAK = 0xFF
#: Words are what stands between ASCII white space; A-Z are lower-cased.
SPACED = _FOLD.copy()
SPACED[[0x20, *range(0x09, 0x0E)]] = BREAK
#: Words are ASCII letters, digits and everything beyond ASCII; A-Z are lower-cased.
PLAIN = _FOLD.copy()
PLAIN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = BREAK

_RANDOM = np.random.Generator(np.random.PCG64(20240521))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_RUN = 1 << 19


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHED: dict[str, np.ndarray] = {}


def _tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    if count > _RUN:  # one word longer than the run
        return _powers(_BASE, count), _powers(_BASE_INVERSE, count)
    if not _CACHED:
        _CACHED["up"], _CACHED["down"] = _powers(_BASE, _RUN), _powers(_BASE_INVERSE, _RUN)
    return _CACHED["up"][:count], _CACHED["down"][:count]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of the input."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offset of each row; NULL counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, first byte of each word, byte after each word, number of words before each row)."""
    folded = table[data]
    inside = folded != BREAK
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return folded, starts, ends, np.searchsorted(starts, offsets)


def hash_words(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each row) of a text column."""
    folded, starts, ends, rows = word_spans(*text_bytes(column), table)
    return hash_spans(folded, starts, ends), rows


def hash_spans(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans are in order and do not overlap."""
    return hash_prefixes(folded, starts, ends, ())[0]


def hash_prefixes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of each span, and below them of its first characters for each of ``sizes``; spans as above."""
    letters = np.append(np.flatnonzero((folded & 0xC0) != 0x80), len(folded)) if sizes else starts
    first = np.searchsorted(letters, starts) if sizes else starts
    cuts = [ends, *[np.minimum(ends, letters[np.minimum(first + size, len(letters) - 1)]) for size in sizes]]
    out = np.empty((len(cuts), len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _RUN, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _tables(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[folded[low:high]] * up, out=total[1:])
        first = starts[i:j] - low
        for k, cut in enumerate(cuts):
            out[k, i:j] = (total[cut[i:j] - low] - total[first]) * down[first]
        i = j
    for k, cut in enumerate(cuts):
        out[k] += (cut - starts).astype(np.uint64) * _STEP
    return mix(out)


def byte_values(data: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit value per byte."""
    return _BYTE[data]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values of a flat array, in order."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, size):
        out *= _STEP
        out += hashes[k : k + count]
    return mix(out)


def hash_runs(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run ``starts`` to ``ends`` of values of a flat array; runs may overlap."""
    up, down = _tables(len(hashes) + 1)  # an empty run may start after the last value
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def row_shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``size`` words.

    A row with fewer words, but not none, has its whole sequence as the one shingle.
    """
    flat = windows(hashes, size)
    for start, end in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if end - start >= size:
            yield np.unique(flat[start : end - size + 1])
        elif end > start:
            yield windows(hashes[start:end], end - start) ^ np.uint64(end - start)
        else:
            yield np.zeros(0, np.uint64)


def packed(arrays: list[np.ndarray], kind=np.uint64) -> pa.Array:
    """One binary value per array: its numbers, little-endian."""
    flat = np.concatenate([np.zeros(0, kind), *arrays]).astype(kind, copy=False)
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([a.size * flat.itemsize for a in arrays], out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def unpacked(value: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(value, kind)


def batches(rows: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))
