"""Word shingle sets and their MinHash signatures, many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

import pyarrow as pa

from lexmill.llm.textkit import LOWER, mix, pieces, word_hashes, words

_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)


def shingle_hashes(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's shingles in order, and each text's limits.

    A-Z counts as a-z. A text of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    low = LOWER[data]
    start, end, first = words(low, at)
    word = word_hashes(low, start, end)
    count = np.diff(first)
    n = len(word) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(width if n > 0 else 0):
        out += mix(word[k : k + n] ^ np.uint64(_STEP[k % 8])) * np.uint64(2 * k + 1)
    out = mix(out)
    number = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    limit = np.concatenate([[0], np.cumsum(number)])
    place = np.repeat(first[:-1] - limit[:-1], number) + np.arange(limit[-1])
    result = np.zeros(limit[-1], np.uint64)
    whole = np.repeat(count >= width, number)
    result[whole] = out[place[whole]]
    for i in np.flatnonzero((count > 0) & (count < width)):
        h = np.uint64(count[i])
        for w in word[first[i] : first[i + 1]]:
            h = mix(np.array([h ^ w]))[0]
        result[limit[i]] = h
    return result, limit


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's shingles as a sorted set."""
    h, limit = shingle_hashes(data, at, width)
    return [np.unique(h[a:b]) for a, b in zip(limit[:-1], limit[1:], strict=True)]


def signature(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of minima for each set that isn't empty."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])])[:-1]
    seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(_STEP[0])) | np.uint64(1)
    return np.stack([np.minimum.reduceat(mix_light(flat * s), begin) for s in seeds], 1) if len(sets) else np.zeros((0, coordinates), np.uint64)


def mix_light(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def text_key(text: bytes) -> bytes:
    """A 128-bit name of a text's words in order, A-Z as a-z."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def numbered(values: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers below their count, unequal ones unequal numbers."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def exact_sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted numbers: two are equal just if their words are, compared byte by byte."""
    low = LOWER[data]
    start, end, first = words(low, at)
    if not len(start):
        return [np.zeros(0, np.int64) for _ in at[1:]]
    word = pieces(low, start, end).dictionary_encode().indices.to_numpy().astype(np.int64)
    most, gram = int(word.max()) + 1, word
    for k in range(1, width):
        gram = numbered(gram[: len(word) - k] * most + word[k:]) if len(word) > k else gram[:0]
    out, short = [], {}
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(gram[a : b - width + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(word[a:b].tolist()), len(short))] if b > a else [], np.int64))
    return out
