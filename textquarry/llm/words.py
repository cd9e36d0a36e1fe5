"""Byte-level word splitting for the operators that run in Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z on UTF-8 bytes.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Also every ASCII byte that is neither digit nor letter to a space; bytes from 0x80 belong to words.
ITEM_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else (b + 32 if 65 <= b <= 90 else 32) for b in range(256))


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, kept between documents; emptied when it holds too many words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words; a shorter text is one run, no word none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    v = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        v = v * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - width + 1 + j]
        v ^= v >> np.uint64(32)
    return np.unique(mix(v))
