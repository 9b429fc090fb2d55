"""SuperMinHash signatures of word-shingle sets (numpy, runs inside tasks).

A SuperMinHash signature has ``m`` slots.  Every set element draws one random
permutation of the slots; the element's value in the slot that comes j-th in
that permutation is ``j + u`` with ``u`` uniform in [0, 1), and a slot keeps the
least value any element gave it.  Slots of one element are therefore spread
evenly instead of being drawn independently, which lowers the variance of the
similarity estimate, and generation can stop at the first rank j that is not
below every slot's current value.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words are maximal runs of anything but space and the characters 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_U = np.uint64
_CACHE_WORDS = 150_000


def lower_az(text: str) -> str:
    """Lower-case A to Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct word n-grams of a text as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self._seen: dict[str, int] = {}

    def word_hashes(self, words: list[str]) -> np.ndarray:
        seen = self._seen
        if len(seen) > _CACHE_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(seen.__getitem__, words), _U, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall(lower_az(text)) if text else []
        if not words:
            return np.empty(0, _U)
        h = self.word_hashes(words)
        n = min(self.size, len(words))  # a shorter text is one shingle
        out = mix(h[: len(h) - n + 1] + _U(n))
        for k in range(1, n):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def signature(items: np.ndarray, m: int, block: int = 2048) -> np.ndarray:
    """SuperMinHash of a non-empty set of 64-bit hashes: ``m`` values, the
    integer part of each is the rank at which the slot was last improved.

    The elements are handled in blocks, so memory is ``block * m`` small
    integers whatever the size of the set."""
    best = np.full(m, np.inf)
    for lo in range(0, len(items), block):
        x = items[lo : lo + block]
        rows = np.arange(len(x))
        perm = np.tile(np.arange(m, dtype=np.int32), (len(x), 1))
        top = best.max()
        for j in range(m):
            if j >= top:  # no element of rank j or later can improve a slot
                break
            r = mix(x + _U(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            k = j + ((r >> _U(40)) % _U(m - j)).astype(np.int64)
            slot = perm[rows, k]
            perm[rows, k] = perm[:, j]
            np.minimum.at(best, slot, j + (r & _U(0xFFFFFFFF)) / 4294967296.0)
            top = best.max()
    return best
