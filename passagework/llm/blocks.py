"""Helpers for operators that work on Arrow batches of texts with numpy.

A batch of texts is one byte array and the bounds of its rows; words, windows and
hashes are computed for all rows of a slice at once. Slices hold a few megabytes of
text, or one longer row, so a task's memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 512 << 10
#: Base of the word hash; odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def counted_hashes(n: int, seed: int) -> np.ndarray:
    """n repeatable pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=_U64) + _U64(seed << 32)) * _U64(BASE))


@cache
def _letters() -> np.ndarray:
    return counted_hashes(256, 11)


class _Powers:
    """Powers of BASE and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=_U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(size, base, dtype=_U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U64))
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the bounds of each row; null is the empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each; every row is whole."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows, start + 20_000)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of many texts: `starts`, `ends` in bytes, `bounds` of each row's words, `hashes`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        inside = word_bytes[data]
        n = len(data)
        edges = offsets[:-1][offsets[:-1] < n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edges] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every span."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U64)
    np.cumsum(_letters()[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k consecutive values; the result is k - 1 shorter."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U64)
    total = np.zeros(n, dtype=_U64)
    for j in range(k):
        total = total * _U64(BASE) + hashes[j : j + n]
    return mix(total)


@cache
def lowered() -> np.ndarray:
    """Byte table that lower-cases A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@cache
def spaced() -> np.ndarray:
    """Which bytes belong to words that are parted by ASCII white space."""
    table = np.ones(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


@cache
def alphanumeric() -> np.ndarray:
    """Which bytes are digits, ASCII letters or part of a non-ASCII character."""
    table = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = True
    return table


def narrowed(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns of a table; names that clash with an operator's own are gone."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def binary(parts: list[np.ndarray] | list[bytes]) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], pa.binary())
