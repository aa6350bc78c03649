"""Words of whole texts inside Arrow functions.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D), which is what `bytes.split` cuts at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Entries of a word cache before it is emptied; a bound on a worker's memory only.
CACHE_WORDS = 150_000


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) > 64:  # long words are hashed anew each time
            return xxhash.xxh3_64_intdigest(word)
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


_MULT = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 % 2**64 | 1) for k in range(64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_MULT_2 = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(h: np.ndarray, n: int, mult=_MULT) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * mult[k]
    return mix(out)


def second_gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Another one, by factors of its own, of words that are scrambled first: 128 bits in all."""
    return gram_hashes(mix(h ^ _MULT_2[63]), n, _MULT_2)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def integers(batch: pa.RecordBatch, column: str = "doc_id") -> list[int | None]:
    return batch.column(column).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python copies of long texts stay few."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
