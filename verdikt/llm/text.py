"""Vectorised helpers over the UTF-8 bytes of an Arrow text column.

Used inside Arrow batches only: Spark partitions and shuffles the rows, these
functions look at the bytes of a bounded chunk of them at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: A random 64-bit value per byte, the same in every process.
BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``MULTIPLIER ** i`` and its inverse modulo 2**64, for i from 0 to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 2)
        for name, base in (("up", MULTIPLIER), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def release() -> None:
    """Give memory that a task no longer uses back to the system.

    Workers serve one task after another, of other stages as well, and what the
    allocators keep counts against the executor.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and n + 1 offsets.

    Null counts as empty.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, first = np.cumsum(sizes, dtype=np.int64), 0
        while first < len(sizes):
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """``out[i]`` is the polynomial hash of the first i bytes, modulo 2**64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits (one-to-one)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal texts have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(MULTIPLIER))


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and n + 1 offsets of each text's words.

    ``in_word`` says for each byte value whether it belongs to a word.
    """
    inside = in_word[data]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Table over byte values: True inside one of the ranges, ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of everything but blanks and line breaks.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
