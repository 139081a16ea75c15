"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The same class as a Java or RE2 pattern and as a string for ``translate``.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Text bytes that a worker handles at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings ``[start, end)``, which rise and don't overlap, as one column."""
    size = end - start
    step = np.zeros(len(data) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    flat = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(flat)])


def digests(values: list[bytes]) -> np.ndarray:
    """128-bit BLAKE2 digests of byte strings, as two 64-bit words each."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in values), "<u8").reshape(-1, 2)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of every string; each distinct one is hashed once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    own = pieces(data, start, end).dictionary_encode()
    return digests(own.dictionary.to_pylist())[:, 0][own.indices.to_numpy()]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column on end, and each row's limits; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, at - at[0]


def give_back() -> None:
    """Returns a worker's freed memory to the system, as Spark keeps the worker for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES, trim: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches between rows, so that a block's texts have about ``limit`` bytes: (rows, bytes, row limits); at the end freed memory goes back, unless ``trim`` is false."""
    for batch in batches:
        flat, at = string_bytes(batch.column(batch.schema.get_field_index(text)))
        row, n = 0, batch.num_rows
        while row < n:
            end = max(row + 1, min(row + 4096, int(np.searchsorted(at, at[row] + limit, "right")) - 1))
            yield batch.slice(row, end - row), flat[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
        del batch, flat, at
    if trim:
        give_back()


def words(data: np.ndarray, at: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts, runs of bytes that aren't ``outside``: starts, ends, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~outside[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = at[:-1][(at[:-1] < at[1:])]
    begins[edge] |= inside[edge]
    last = at[1:][(at[:-1] < at[1:])] - 1
    ends[last] |= inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


#: Stands for a null id inside operators that order ids: after all others.
NO_ID = (1 << 63) - 1


def ordered_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def own_id(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID))
