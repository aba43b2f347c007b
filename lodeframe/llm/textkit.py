"""Vectorised reading of Arrow text batches: words, rolling hashes and sliding minima in numpy.

All functions work on UTF-8 bytes. A word is a run of bytes other than 0x20 and 0x09 to 0x0D, as the
contracts define it. Work goes in slices of a few megabytes, so memory follows the slice (or the one
longest text), not the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SYMBOL = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of width consecutive 64-bit values; its order matters."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=prefix[1:])
    return mix((prefix[width:] - prefix[:n]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of width values, in time that doesn't depend on the width."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Slice:
    """Some consecutive rows of a text column, as one byte buffer with row bounds."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.rows = len(bounds) - 1

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)


class Words:
    """The words of a slice: byte positions, the row of each, and where each row's words begin."""

    def __init__(self, part: Slice, lower: bool):
        data, bounds = part.data, part.bounds
        text = ~_SPACE[data]
        begins, ends = text.copy(), text.copy()
        begins[1:] &= ~text[:-1]
        ends[:-1] &= ~text[1:]
        inner = bounds[1:-1]
        inner = inner[inner < len(data)]
        begins[inner] = text[inner]
        inner = inner[inner > 0]
        ends[inner - 1] = text[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)  # of each row, and the total
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(part.rows), self.count)
        self._data = LOWER[data] if lower else data

    def hashes(self) -> np.ndarray:
        up, down = powers(max(1, len(self._data)))
        prefix = np.zeros(len(self._data) + 1, np.uint64)
        np.cumsum(_SYMBOL[self._data] * up[: len(self._data)], out=prefix[1:])
        return mix((prefix[self.end] - prefix[self.start]) * down[self.start])

    def windows(self, width: int) -> np.ndarray:
        """Positions of the first words of all windows of width words within one row."""
        n = len(self.row) - width + 1
        return np.flatnonzero(self.row[:n] == self.row[width - 1 :]) if n > 0 else np.empty(0, np.int64)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a string column in slices of about limit bytes; a null is an empty text."""
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Slice(first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def int64_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of a flat array as one binary value for each count."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=offsets[1:])
    raw = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), raw])


def unpacked(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The flat array and the counts that packed() took; column holds no nulls."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = data.slice(int(bounds[0]), int(bounds[-1] - bounds[0])) if data is not None else b""
    return np.frombuffer(raw, dtype), np.diff(bounds) // np.dtype(dtype).itemsize
