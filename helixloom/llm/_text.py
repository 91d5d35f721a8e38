"""Numpy views of Arrow text columns, and hashing over them.

Every function here works on the bytes of a whole Arrow batch at once, in chunks of
bounded size, so tasks hold a few tens of MB however many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20

_pow: dict[str, np.ndarray] = {}


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``most`` bytes of text, or one row: (slice, bytes, offsets)."""
    raw, offsets = column_bytes(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, min(at + rows, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
        yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _pow or len(_pow["up"]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for key, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _pow[key] = np.cumprod(steps)
    return _pow["up"][:n], _pow["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, each from its bytes alone."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SPREAD[raw] * up[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and where each row's words begin."""
    n = len(raw)
    ink = np.zeros(n + 2, bool)
    ink[1:-1] = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink[1:] & (~ink[:-1] | edge))
    ends = np.flatnonzero(ink[:-1] & (~ink[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between ``\\n`` and where each row's lines begin; an empty row has one empty line."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    order_s = np.lexsort((starts, row))
    order_e = np.lexsort((ends, row))
    counts = np.bincount(row, minlength=len(offsets) - 1)
    return starts[order_s], ends[order_e], np.concatenate([[0], np.cumsum(counts)])


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between the bounds in ``first``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def grams(token: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams inside rows, and the places of their first words."""
    at = np.flatnonzero(np.repeat(first[1:], np.diff(first)) - np.arange(len(token)) >= n)
    total = np.zeros(len(at), np.uint64)
    for i in range(n):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + token[at + i])
    return total, at
