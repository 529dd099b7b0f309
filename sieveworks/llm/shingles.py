"""Word shingles as 64-bit digests, computed batch by batch.

Words are the runs of bytes other than ASCII white space in the UTF-8 text, with A-Z
lower-cased. A document's set holds its distinct shingles of five words; a document with
fewer words has the one shingle of all its words; one without words has none. A shingle is
a 64-bit digest of its words' 64-bit digests and its length; two different shingles of a pair
of documents share a digest about once in 2**64 / (n * m) pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1) for i in range(WIDTH)]
_EMPTY = np.empty(0, np.uint64)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (shift, multiply, three times)."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


class WordDigests(dict):
    """word -> 64-bit digest, for the words seen lately; cleared when it holds too many."""

    limit = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingle_list(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The digests of all shingles in order, repeats included, from the words' digests."""
    n = len(words)
    if not n:
        return _EMPTY
    k = min(n, width)
    s = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        s += mix(words[j : n - k + 1 + j] + _ODD[j])  * _ODD[j]
    return mix(s)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    s = np.sort(values)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def shingle_set(text: bytes | None, digests: WordDigests, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle digests of a text."""
    return distinct(shingle_list(digests.of(words_of(text)), width))


def minhash(sets: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each coordinate the least 32-bit hash over a set, in slices of bounded size."""
    out = np.full(len(mult), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(sets), 2048):
        h = (sets[i : i + 2048, None] * mult + add) >> np.uint64(32)
        np.minimum(out, h.min(0), out=out)
    return out.astype(np.uint32)


def coordinates(k: int, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mult, rng.integers(0, 2**63, k, dtype=np.uint64)
