"""Texts of an Arrow batch as flat byte arrays, and hashes of their words.

The operators of this package that run Python see a batch of documents as one
array of UTF-8 bytes with document offsets, and work on it with numpy. Blocks
bound what is held at a time; a single longer document is a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Block(NamedTuple):
    """Documents `lo` to `hi` of a batch: their bytes and n + 1 offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def small_batches(spark: SparkSession) -> None:
    """Send rows with whole texts to Python in batches of 1,000, so that what a
    task holds at a time doesn't depend on many texts being long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """`run` for mapInArrow, with memory released at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """`run` for applyInArrow, with memory released after large groups."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > 1 << 20:
            del table
            release()
        return out

    return wrapped


def text_array(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()) if column.type != pa.large_string() else column


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Cut a text column (null: empty text) in blocks of about `limit` bytes at document ends."""
    column = text_array(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Document of each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def word_bounds(block: Block, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no ASCII white space, or not in `outside`)."""
    inside = ~outside[block.data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none
    cut = np.zeros(n + 1, bool)
    cut[block.offsets] = True
    start = inside & cut[:n]
    start[0] |= inside[0]
    start[1:] |= inside[1:] & ~inside[:-1]
    end = inside & cut[1:]
    end[-1] |= inside[-1]
    end[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    found = _powers.get(base)
    if found is None or len(found) <= n:
        found = np.full(max(n, BLOCK) + 1, base, np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if len(found) <= 2 * BLOCK + 1:
            _powers[base] = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one running polynomial, so
    that the cost doesn't depend on how long spans are or whether they overlap."""
    n = len(data)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)[:n], out=run[1:])
    raw = (run[ends] - run[starts]) * powers(_INVERSE, n)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` word hashes (those across documents included)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n])
    return out
