"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

Texts of a batch are cut into blocks of half a MB, so that a task's arrays stay
small however many or long its rows are.  A text over the block size is a block of
its own; no text is shortened.

Hashes mix after every step, so no two strings of a simple pattern (as those that a polynomial
modulo a power of two confuses) fall together by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 19
#: Bytes of a range up to which its hash is folded in arrays.
SHORT = 64
STEP = 1 << 14
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range [start, end).

    Up to ``SHORT`` bytes are folded 8 at a time, all ranges at once; longer ones go through XXH64 one by one.
    """
    length = end - start
    out = mix(length.astype(np.uint64) + _U(1))
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(9, np.uint8)]), 0, (1,)) if len(data) else np.zeros(1, np.uint64)
    open_ = np.flatnonzero((length > 0) & (length <= SHORT))
    at = 0
    while len(open_):
        left = np.minimum(length[open_] - at, 8)
        value = eights[start[open_] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left.astype(np.uint64)))
        out[open_] = mix(out[open_] * _U(3) + value)
        at += 8
        open_ = open_[length[open_] > at]
    raw = data.data
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]], 42)
    return out


def sequence_hashes(items: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of items[i : i + length] for each i that has so many: hashes of 1, 2, 4, .. items, each mixed from two halves, and two of them that cover the range."""
    items = np.asarray(items)
    if len(items) < length:
        return np.zeros(0, dtype=np.uint64)
    # in steps whose arrays fit a processor's cache
    out = np.empty(len(items) - length + 1, dtype=np.uint64)
    for lo in range(0, len(out), STEP):
        out[lo : lo + STEP] = _sequence_hashes(items[lo : lo + STEP + length - 1], length)
    return out


def _sequence_hashes(items: np.ndarray, length: int) -> np.ndarray:
    size = 1
    items = _BYTES[items] if items.dtype == np.uint8 else mix(items + _U(0x9E3779B97F4A7C15))
    while 2 * size <= length:
        pair = items[:-size] * _U(0xD1342543DE82EF95)
        pair += items[size:]
        pair ^= pair >> _U(31)
        pair *= _U(0xD6E8FEB86659FD93)
        items = pair
        size *= 2
    rest = length - size
    return mix(items[: len(items) - rest] * _U(0xD1342543DE82EF95) + items[rest:] + _U(length))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over x[i : i + width] for each i that has a full window."""
    n = len(x)
    if n < width:
        return x[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over a string column; null is the empty text."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    if not len(column):
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and the first word of each text.

    A word never crosses a text's border.
    """
    inside = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)
