"""Text columns as flat NumPy arrays: slices, words, lines, hashes.

Each operator that works through Arrow cuts its batches into slices of a few
megabytes, so that the temporary arrays stay small however long the batch is.
A null text counts as empty throughout.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Slice:
    """Some rows of a batch; ``data`` holds their texts end to end, text i at [off[i], off[i + 1])."""

    rows: pa.RecordBatch
    data: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def raw(self) -> bytes:
        return self.data.tobytes()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of a string column."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]] if len(column) else np.empty(0, np.uint8)
    return data, off - off[0]


def tidy(run: Callable) -> Callable:
    """A worker's function that gives freed memory back to the system, as the worker lives on with other tasks' functions."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Rows of about ``limit`` bytes at a time; only the slice is copied."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, side="right")) - 1)
            some = batch.slice(lo, hi - lo)
            yield Slice(some, *flat(some.column(batch.schema.get_field_index(column))))
            lo = hi


def word_bounds(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and first[i]: the first word of text i."""
    inside = np.zeros(len(s.data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[s.data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cuts = s.off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(s.data))]
    begins[cuts] = inside[1:-1][cuts]
    stops[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, s.off)


def line_bounds(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between ``\\n``, and first[i]: the first line of text i. An empty text is one empty line."""
    breaks = np.flatnonzero(s.data == 10)
    starts = np.concatenate([s.off[:-1], breaks + 1])
    # a text's own start sorts before a line that begins at the same place in the text before it
    owner = np.concatenate([np.arange(len(s)), np.searchsorted(s.off, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(s) + 1))
    ends = np.empty_like(starts)
    if len(starts):
        ends[:-1] = starts[1:] - 1
        ends[first[1:] - 1] = s.off[1:]
    return starts, ends, first


def _dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Ranges (in order and not overlapping) and the gaps between them, as indices into distinct values; and these."""
    off = np.empty(2 * len(starts), dtype=np.int64)
    off[0::2], off[1::2] = starts, ends
    pieces = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    found = pieces.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64), found.dictionary


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers for equal byte ranges (in order and not overlapping), by exact comparison; and a bound on them."""
    if not len(starts):
        return np.empty(0, np.int64), 0
    code, values = _dictionary(data, starts, ends)
    return code, len(values)


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The byte ranges as numbers into a list of distinct ones."""
    if not len(starts):
        return np.empty(0, np.int64), []
    code, values = _dictionary(data, starts, ends)
    used = np.zeros(len(values), dtype=bool)  # some values are gaps alone
    used[code] = True
    return (np.cumsum(used) - 1)[code], values.filter(pa.array(used)).to_pylist()


_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_B, _INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, which depends on its bytes alone."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(seed + 1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
