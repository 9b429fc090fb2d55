"""Minimal acyclic transducer from words to id sequences.

The words form a minimal deterministic automaton (equal endings share states).
Every arc carries the number of words that sort before those it leads to, so
following a word adds up its rank, and the rank selects the word's ids.  The
automaton is one flat block of bytes that tasks memory-map.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile

import numpy as np


def _minimal_states(words: list[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """States (final?, arcs) of the minimal automaton of sorted distinct words,
    and the start state.  A state is frozen, and looked up among equal ones, as
    soon as no later word can add to it."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        state = (final, tuple(arcs))
        if state not in known:
            known[state] = len(states)
            states.append(state)
        return known[state]

    open_path: list[list] = [[False, [], None]]  # final?, arcs, label towards the next
    last = b""
    for w in [*words, None]:
        common = 0
        if w is not None:
            common = len(os.path.commonprefix([last, w]))
        while len(open_path) > common + 1:
            final, arcs, _ = open_path.pop()
            open_path[-1][1].append((open_path[-1][2], freeze(final, arcs)))
        if w is not None:
            for c in w[common:]:
                open_path[-1][2] = c
                open_path.append([False, [], None])
            open_path[-1][0] = True
            last = w
    return states, freeze(open_path[0][0], open_path[0][1])


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The flat block of a lexicon from words to ids."""
    words = sorted(entries)
    states, start = _minimal_states(words)
    below = np.zeros(len(states), np.int64)  # words readable from a state
    first, labels, targets, skips = [0], bytearray(), [], []
    for s, (final, arcs) in enumerate(states):  # targets come before sources
        n = int(final)
        for c, t in arcs:
            labels.append(c)
            targets.append(t)
            skips.append(n)
            n += int(below[t])
        below[s] = n
        first.append(len(labels))
    ids = [entries[w] for w in words]
    ends = np.cumsum([0, *map(len, ids)])
    parts = [
        np.array([start, len(states), len(labels), len(words)], "<i4"),
        np.array(first, "<i4"), np.array(targets, "<i4"), np.array(skips, "<i4"), ends.astype("<i4"),
        np.array([i for x in ids for i in x], "<u4"), np.array([f for f, _ in states], "u1"),
    ]
    return b"".join(p.tobytes() for p in parts) + bytes(labels)


class Lexicon:
    """Read side of a block, over any buffer (a memory map in tasks)."""

    def __init__(self, block):
        head = np.frombuffer(block, "<i4", 4)
        self.start, n, arcs, words = (int(x) for x in head)
        at = 16

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(block, kind, count, at)
            at += x.nbytes
            return memoryview(x)

        self.first, self.target, self.skip = take("<i4", n + 1), take("<i4", arcs), take("<i4", arcs)
        self.ends = take("<i4", words + 1)
        self.ids_at = at
        at += 4 * self.ends[words]
        self.final = take("u1", n)
        self.labels_at, self.block, self.words = at, block, words
        self.heads: dict[bytes, tuple[int, int] | None] = {}

    def _walk(self, word: bytes, state: int, rank: int) -> tuple[int, int] | None:
        """State and rank after the bytes of a word; None if they lead nowhere."""
        find, base = self.block.find, self.labels_at
        first, skip, target = self.first, self.skip, self.target
        for c in word:
            arc = find(_BYTES[c], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            rank += skip[arc]
            state = target[arc]
        return state, rank

    def get(self, word: bytes) -> bytes | None:
        """Ids of a word as little-endian unsigned 32-bit integers."""
        head = word[:_HEAD]
        if head not in self.heads:  # where the first bytes lead is remembered
            if len(self.heads) > _HEADS:
                self.heads.clear()
            self.heads[head] = self._walk(head, self.start, 0)
        at = self.heads[head]
        if at is not None and len(word) > _HEAD:
            at = self._walk(word[_HEAD:], *at)
        if at is None or not self.final[at[0]]:
            return None
        return self.block[self.ids_at + 4 * self.ends[at[1]] : self.ids_at + 4 * self.ends[at[1] + 1]]


_HEAD, _HEADS = 5, 50_000
_BYTES = [bytes([c]) for c in range(256)]
_open: dict[bytes, Lexicon] = {}


def mapped(block: bytes) -> Lexicon:
    """The lexicon over a memory map of the block, once per process.  The file
    is in the process's own temp folder and already unlinked: the pages are
    clean file pages that the system may drop and read again."""
    name = hashlib.blake2b(block, digest_size=16).digest()
    if name not in _open:
        _open.clear()
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            _open[name] = Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _open[name]
