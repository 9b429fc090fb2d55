"""Noisy-channel restoration of disguised words.

A disguised stretch of text (leetspeak, letters set apart, letters repeated)
is a lattice: every character may stand for itself, for the letters it is
commonly written for, or, if it is neither letter nor digit, for a gap or for
nothing.  In a stretch of several words every mark may stand for nothing or a
gap, spaces too, and a gap may be missing between letters.  Viterbi search
finds the path with the best sum of channel costs and the log-probabilities of
a character language model over the two characters before.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

#: Letters that digits and marks commonly stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
#: log10 costs of the channel.
KEEP, SWAP, DROP, REPEAT, INSERT = 0.0, -0.7, -0.9, -0.25, -0.9
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
#: Character classes of the language model: 0 ends a word, the last is any
#: other character.
SIZE = 64
_CLASS = {c: i + 1 for i, c in enumerate(ALPHABET)}
OTHER = SIZE - 1
_LUT = np.full(0x250, OTHER, np.int64)
for _c, _i in _CLASS.items():
    _LUT[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < len(_LUT):
        _LUT[ord(_c.upper())] = _i
_LUT[list(b" \t\n\x0b\x0c\r")] = 0

#: Single characters set apart by one kind of gap, three or more of them.
APART = re.compile(r"(?<![^\s])[^\W_]([ .\-_*])[^\W_](?:\1[^\W_])+(?![^\s.,;:!?])")
#: Characters that can only be a gap or nothing.
GAP = re.compile("(?:[^\\w%s]|_)+" % re.escape("".join(LEET)))
_THRICE = re.compile(r"([^\W\d_])\1\1")
_THRICE_MORE = re.compile(r"([^\W\d_])\1\1\1+")
_MIXED = re.compile(r"[^\W_].*[^\w\s'’\-.,;:]|[^\w\s'’\-.,;:].*[^\W_]|\d.*[^\W\d_]|[^\W\d_].*\d")


def codes(text: str) -> np.ndarray:
    """Character classes of a text, with a word end before and after it."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate(([0], _LUT[np.minimum(raw, len(_LUT) - 1)], [0]))


def together(run: str) -> list[str]:
    """What a match of APART may spell: all its characters, or all but the
    first or last, which may be a word of one letter beside it."""
    whole = run[::2]
    return [whole] + ([whole[1:], whole[:-1]] if len(whole) > 3 else [])


def trigram_counts(text: str) -> np.ndarray:
    c = codes(text)
    return c[:-2] * (SIZE * SIZE) + c[1:-1] * SIZE + c[2:] if len(c) > 2 else np.empty(0, np.int64)


class CharModel:
    """log10 p(c | a, b) from trigram counts, interpolated with lower orders."""

    def __init__(self, counts: np.ndarray, weight: float = 8.0):
        c3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SIZE)
        p2 = (c2 + weight * p1) / (c2.sum(axis=1, keepdims=True) + weight)
        p3 = (c3 + weight * p2) / (c3.sum(axis=2, keepdims=True) + weight)
        self.log = np.log10(p3).astype(np.float32)
        self.table = self.log.tolist()
        self.key = hashlib.blake2b(self.log.tobytes(), digest_size=16).hexdigest()


def suspicious(word: str) -> bool:
    """Could a word (lower case, without white space) be disguised?"""
    return bool(_THRICE.search(word) or not word.isalpha() and _MIXED.search(word))


def squeezed(text: str) -> str:
    """``text`` with runs of a letter cut to three: the lattice reads longer ones alike."""
    return _THRICE_MORE.sub(r"\1\1\1", text)


def _edges(text: str, k: int, stretch: bool = False) -> list[tuple[int, str, float]]:
    """Edges of the lattice at character k: (next k, output, cost).  In a
    stretch of words a mark that may be a letter may also be a gap or nothing,
    and a gap may be missing before a letter."""
    c = text[k]
    if c.isalpha():
        end = k + 1
        while end < len(text) and text[end] == c:
            end += 1
        if end - k >= 3:  # a run may stand for one letter or two
            out = [(end, c, REPEAT), (end, c + c, REPEAT)]
        else:
            out = [(k + 1, c, KEEP)]
        if stretch and k and text[k - 1].isalpha():
            out += [(to, " " + x, cost + INSERT) for to, x, cost in out]
        return out
    nothing = [(k + 1, "", DROP), (k + 1, " ", KEEP)]
    if c in LEET:
        return [(k + 1, c, KEEP), *((k + 1, x, SWAP) for x in LEET[c]), *(nothing if stretch and not c.isdigit() else ())]
    return nothing


def decode(text: str, model: CharModel, stretch: bool = False) -> str:
    """The most likely original of a disguised stretch in lower case.  Equal
    scores go to the output that sorts first."""
    table = model.table
    # layers[k]: (last two classes) -> (score, output)
    layers: list[dict[tuple[int, int], tuple[float, str]]] = [{} for _ in range(len(text) + 1)]
    layers[0][0, 0] = (0.0, "")
    for k in range(len(text)):
        layer, layers[k] = layers[k], {}
        if not layer:
            continue
        for to, out, cost in _edges(text, k, stretch):
            target = layers[to]
            for (a, b), (score, before) in layer.items():
                x, y, s = a, b, score + cost
                for c in out:
                    i = 0 if c == " " else _CLASS.get(c, OTHER)
                    s += table[x][y][i]
                    x, y = y, i
                new = (s, before + out)
                old = target.get((x, y))
                if old is None or new[0] > old[0] or (new[0] == old[0] and new[1] < old[1]):
                    target[x, y] = new
    ends = [(s + table[a][b][0], out) for (a, b), (s, out) in layers[-1].items()]
    return min(ends, key=lambda e: (-e[0], e[1]))[1] if ends else ""


class _Letters(dict):
    """For str.translate: letters that one character may stand for are one
    letter, all else is left out."""

    def __init__(self, marks: bool):
        super().__init__()
        for c, letters in LEET.items():
            if len(letters) < 3 and (marks or c not in "!|+(#"):
                self[ord(c)] = "i" if "l" in letters else letters[0]
        self[ord("l")] = "i"

    def __missing__(self, c: int):
        self[c] = chr(c) if chr(c).isalpha() else None
        return self[c]

    def places(self, text: str) -> np.ndarray:
        """Where the characters stand that are not left out."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        each, at = np.unique(raw, return_inverse=True)
        return np.flatnonzero(np.array([self[int(c)] is not None for c in each])[at])


_PLAIN, _MARKS = _Letters(False), _Letters(True)
_REACH = 32


class Spotter:
    """Stretches of a text whose letters, gaps and marks left out, hold one of
    some words: what the lattice could restore to one of them."""

    def __init__(self, words):
        self.words = sorted({w.translate(_PLAIN) for w in words if w.isalpha()})

    def stretches(self, low: str) -> set[str]:
        found, seen = set(), None
        for letters in (_PLAIN, _MARKS):
            bare = low.translate(letters)
            if bare == seen:
                break
            seen, at = bare, None
            for w in self.words:
                p = bare.find(w)
                while p >= 0:
                    if at is None:
                        at = letters.places(low)
                    found.add(self._around(low, at[p], at[p + len(w) - 1] + 1))
                    p = bare.find(w, p + 1)
        return found

    @staticmethod
    def _around(low: str, start: int, end: int) -> str:
        """``low[start:end]`` and the rest of the words that it cuts, gaps as single spaces."""
        inside = GAP.sub(" ", low[start:end])
        before = re.search(r"\S*\Z", low[max(0, start - _REACH) : start])[0]
        after = re.match(r"\S*", low[end : end + _REACH])[0]
        return squeezed(GAP.sub(" ", before + inside + after)).strip()
