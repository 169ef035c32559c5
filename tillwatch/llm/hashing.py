"""Vectorised hashes of words and word sequences over Arrow text columns.

Words are maximal runs without blanks (20, 09-0D). A word's hash is a fixed random linear form of its
bytes, finished with a mixer; a sequence's hash is a fixed linear form of its words' hashes, mixed again.
Texts are handled in blocks of about ``BLOCK`` bytes (one text at least), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
_SPAN = 4096
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_WEIGHTS = _RANDOM.integers(1, 1 << 63, _SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in the bytes) of blocks of texts; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    array = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block, and where each text's words begin (one more entry than texts)."""
    solid = ~blank[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    begins = np.flatnonzero(solid & ~before)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    where = np.flatnonzero(solid)
    first = np.searchsorted(where, begins)
    lengths = np.diff(np.append(first, len(where)))
    inside = where - np.repeat(begins, lengths)
    value = data[where]
    value = (_FOLD[value] if fold else value).astype(np.uint64) + np.uint64(1)
    if len(inside) and inside.max() >= _SPAN:
        value *= (inside // _SPAN).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)
    value *= _WEIGHTS[inside % _SPAN]
    h = np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h), np.searchsorted(begins, offsets)


def sequences(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, (k * 0x9E3779B97F4A7C15 + salt * 0xC2B2AE3D27D4EB4F) % (1 << 64), np.uint64)
    for j in range(k):
        h += words[j : j + n] * _MULTIPLIERS[(j + 17 * salt) % 64]
        if k > 64 and j % 64 == 63:
            h = mixed(h)
    return mixed(h)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
