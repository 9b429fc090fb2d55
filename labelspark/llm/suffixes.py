"""Exact removal of repeated byte strings by blockwise suffix sorting over a
difference cover.

All texts together are one string of UTF-8 bytes; a suffix is due for removal
if its first ``min_bytes`` bytes (within its document) also start elsewhere.

1. *Cover.*  D is a perfect difference set modulo v = q*q + q + 1.  For any two
   positions i, j some offset below v takes both into the sample (positions
   whose value modulo v is in D).  So if the ``min_bytes`` bytes at i and j are
   equal, a sample of each, at the same offset, starts equal strings of
   ``min_bytes - v + 1`` bytes.  The samples are sorted cell by cell; those
   that share their rank with another one are *tied*.
2. *Blocks.*  Only suffixes with a tied sample within v bytes can repeat.  They
   are dealt into cells by the fingerprint of their first ``min_bytes`` bytes
   and sorted one cell at a time; equal neighbours repeat.  Only equality of
   that prefix matters here, so the order within a cell is the order of the
   fingerprints (72 bits between batches) rather than that of the bytes.

Equal whole texts are found first: they repeat as a whole, and only one of them
goes on as evidence for others.  The text is shuffled once, into batches; all
other exchanges are packed keys (see ``exchange``).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import exchange
from labelspark.llm.superminhash import mix

_U = np.uint64
#: Positions hashed at once: what a block needs stays in a core's cache.
BLOCK = 1 << 16
#: Bytes of text in a batch; a task that holds its suffixes needs fifty times that.
BATCH_BYTES = 2 << 20
#: Low bits of a hash that are not sent: of a cover sample, where a false tie
#: only costs work, and of a suffix, which 16 bits of a second hash confirm.
SAMPLE_DROP, SUFFIX_DROP = 12, 8
#: Odd multipliers of the two rolling hashes (any odd numbers do).
RADIX = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@lru_cache(None)
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """Singer's perfect difference set for a prime q: (v, q + 1 residues).

    Powers of a generator x of GF(q**3) run over v points of the projective
    plane; those on one line form the set.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):  # x**3 = a*x*x + b*x + c
                found, p = [], (0, 0, 1)
                for i in range(v):
                    if p[0] == 0:
                        found.append(i)
                    p = ((p[1] + a * p[0]) % q, (p[2] + b * p[0]) % q, c * p[0] % q)
                if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
                    return v, tuple(found)
    raise ValueError(f"no difference set: {q} is not a prime")


def cover_for(min_bytes: int) -> tuple[int, tuple[int, ...]]:
    """The cover with the largest modulus up to four fifths of ``min_bytes``."""
    primes = [q for q in range(2, 100) if all(q % r for r in range(2, q))]
    fitting = [q for q in primes if q * q + q + 1 <= 0.8 * min_bytes]
    if not fitting:
        raise ValueError("min_bytes must be at least 9")
    return difference_cover(fitting[-1])


@lru_cache(4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = RADIX[which]
    up = np.cumprod(np.concatenate((np.ones(1, _U), np.full(n, r, _U))), dtype=_U)
    down = np.cumprod(np.concatenate((np.ones(1, _U), np.full(n, pow(r, -1, 1 << 64), _U))), dtype=_U)
    letters = mix(np.arange(1, 257, dtype=_U) * _U(r))
    return up, down, letters


def window_hashes(body: np.ndarray, size: int, which: int = 0, at: np.ndarray | None = None):
    """Yields (start, hashes) of the ``size``-byte strings at start, start + 1,
    ..., in blocks: memory does not grow with the text.  With ``at`` (ascending
    positions), only the hashes of the strings there."""
    n = len(body) - size + 1
    up, down, letters = _powers(which, BLOCK + size)
    for lo in range(0, n, BLOCK):
        k = min(BLOCK, n - lo)
        if at is None:
            i = np.arange(k)
        else:
            i = at[slice(*np.searchsorted(at, (lo, lo + k)))] - lo
            if not len(i):
                continue
        part = letters[body[lo : lo + k + size - 1]]
        total = np.concatenate((np.zeros(1, _U), np.cumsum(part * up[: len(part)], dtype=_U)))
        yield lo, mix((total[i + size] - total[i]) * down[i])


class _Batch:
    """Keys of a batch of texts, recomputed alike in every phase.  The texts
    stand one after another in ``body``; positions are places in it."""

    def __init__(self, texts: list[str], min_bytes: int, cells: int):
        self.n, self.cells = min_bytes, cells
        self.v, self.cover = cover_for(min_bytes)
        bodies = [t.encode("utf-8", "surrogatepass") for t in texts]
        digests = [hashlib.blake2b(b, digest_size=10).digest() for b in bodies]
        self.key = np.array([int.from_bytes(d[:8], "little") for d in digests], _U)
        self.check = np.array([int.from_bytes(d[8:], "little") for d in digests], np.uint16)
        self.size = np.array([len(b) for b in bodies], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.body = np.frombuffer(b"".join(bodies), np.uint8)

    def bodies(self) -> list[np.ndarray]:
        return np.split(self.body, self.end[:-1])

    def texts(self):
        """Phase 0: distinct texts (sorted keys, check, several here?)."""
        keys, first, count = np.unique(self.key, return_index=True, return_counts=True)
        return keys, self.check[first], count > 1

    def read_texts(self, replies) -> None:
        keys, _, several = self.texts()
        flags = _flags(replies, keys, self.cells, 2)
        at = np.searchsorted(keys, self.key)
        self.copied = (flags[0] | several)[at]
        mine = np.zeros(len(self.key), bool)  # one of each text that this batch stands for
        mine[np.unique(self.key, return_index=True)[1]] = True
        self.evidence = mine & flags[1][at]

    def _hashes(self, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """Hashes of the ``size``-byte strings at ascending positions."""
        return np.concatenate([np.empty(0, _U), *(h for _, h in window_hashes(self.body, size, which, at))])

    def _sampled(self, size: int) -> np.ndarray:
        """Positions of the cover samples of the evidence, counted in each text from its start."""
        long = np.nonzero(self.evidence & (self.size >= self.n))[0]
        most = self.size[long].max(initial=0)
        marks = np.add.outer(np.arange(0, most, self.v), self.cover).ravel()
        to = np.searchsorted(marks, self.size[long] - size + 1)
        return np.concatenate([np.empty(0, np.int64), *(marks[:k] + lo for k, lo in zip(to, self.start[long]))])

    def samples(self):
        """Phase 1: hashes of the cover samples, sorted, and which occur twice."""
        size = self.n - self.v + 1
        self.sampled = self._sampled(size)
        keys, self.sample, count = np.unique(self._hashes(self.sampled, size), return_inverse=True, return_counts=True)
        return keys, count > 1

    def read_samples(self, replies) -> None:
        keys, several = self.samples()
        tied = _flags(replies, keys, self.cells, 1)[0] | several
        self.tied = self.sampled[tied[self.sample]]

    def candidates(self) -> np.ndarray:
        """Positions whose string may repeat: a tied sample starts within v bytes."""
        of = self._text_of(self.tied)
        lo, hi = _unions(np.maximum(self.tied - self.v + 1, self.start[of]), np.minimum(self.tied, self.end[of] - self.n) + 1)
        each = hi - lo
        return np.arange(each.sum()) + np.repeat(lo - np.cumsum(each) + each, each)

    def _text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, "right")

    def suffixes(self):
        """Phase 2: fingerprints of the candidate suffixes, sorted, and which occur twice."""
        self.at = self.candidates()
        keys, self.suffix, count = np.unique(self._hashes(self.at, self.n), return_inverse=True, return_counts=True)
        return keys, count > 1

    def checks(self, keys: np.ndarray) -> np.ndarray:
        """16 bits of a second hash for the ``suffixes``."""
        out = np.zeros(len(keys), np.uint16)
        out[self.suffix] = (self._hashes(self.at, self.n, 1) >> _U(48)).astype(np.uint16)
        return out

    def removed(self, replies) -> list[np.ndarray]:
        """For each text the removed runs as rows (from, to).  A text without
        copies is evidence, so all its candidates are among the suffixes."""
        keys, several = self.suffixes()
        repeats = _flags(replies, keys, self.cells, 1)[0] | several
        at = self.at[repeats[self.suffix]]
        lo, hi = _unions(at, at + self.n, np.diff(self._text_of(at)) > 0)
        of = self._text_of(lo)
        runs = np.stack((lo, hi), axis=1) - self.start[of][:, None]
        out = np.split(runs, np.searchsorted(of, np.arange(1, len(self.size))))
        for b in np.nonzero(self.copied & (self.size >= self.n))[0]:
            out[b] = np.array([[0, self.size[b]]])
        return out


def _unions(lo: np.ndarray, hi: np.ndarray, apart: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Unions of the ranges [lo, hi) that meet, both ends ascending; neighbours
    that are ``apart`` stay so."""
    cut = np.nonzero((lo[1:] > hi[:-1]) | apart)[0]
    return lo[np.concatenate(([0], cut + 1))[: len(lo)]], hi[np.concatenate((cut, [len(lo) - 1]))[: len(lo)]]


def _flags(replies, keys: np.ndarray, cells: int, planes: int) -> np.ndarray:
    """Bit planes answered for sorted keys."""
    at, out = exchange.slices(keys, cells), np.zeros((planes, len(keys)), bool)
    for cell, data in replies:
        lo, hi = at[cell], at[cell + 1]
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(planes, -1)[:, : hi - lo]
        out[:, lo:hi] = bits.astype(bool)
    return out


def _sort_cell(phase: int):
    """Sorts one cell.  Answers for every key: does another batch hold it, and
    in phase 0 also: is this the lowest batch that does?"""

    def run(table: pa.Table) -> pa.Table:
        batches, lengths, keys, check = exchange.gather(table, np.uint16)
        owner = np.repeat(np.array(batches), lengths)
        order = np.argsort(keys) if phase else np.lexsort((owner, check, keys))
        k, c = keys[order], check[order]
        if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # rare: then the checks are sorted, too
            order = np.lexsort((owner, check, keys))
            k, c = keys[order], check[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        edge = np.zeros(1, bool)
        planes = [np.concatenate((edge, same)) | np.concatenate((same, edge))]
        if phase == 0:
            planes.append(~np.concatenate((edge, same)))
        back = []
        for p in planes:
            x = np.empty(len(p), bool)
            x[order] = p
            back.append(np.split(x, np.cumsum(lengths)[:-1]))
        data = []
        for one in zip(*back):
            width = -(-len(one[0]) // 8) * 8  # planes start at whole bytes
            data.append(np.packbits(np.stack([np.pad(x, (0, width - len(x))) for x in one])).tobytes())
        return exchange.answer(phase, table["cell"][0].as_py(), batches, data)

    return run


def _phase(phase: int, min_bytes: int, cells: int):
    def batch_of(left: pa.Table, right: pa.Table) -> _Batch:
        x = _Batch(left["text"].to_pylist(), min_bytes, cells)
        if phase > 0:
            x.read_texts(exchange.answers(right, 0))
        if phase > 1:
            x.read_samples(exchange.answers(right, 1))
        return x

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return exchange.send(0, np.empty(0, _U), np.empty(0, np.uint16), cells)
        x, number = batch_of(left, right), left["batch"][0].as_py()
        if phase == 1:
            keys, _ = x.samples()
            return exchange.send(number, keys, np.zeros(len(keys), np.uint16), cells, drop=SAMPLE_DROP)
        keys, _ = x.suffixes()
        return exchange.send(number, keys, x.checks(keys), cells, drop=SUFFIX_DROP)

    def first(left: pa.Table) -> pa.Table:
        keys, check, _ = _Batch(left["text"].to_pylist(), min_bytes, cells).texts()
        return exchange.send(left["batch"][0].as_py(), keys, check, cells)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        x = batch_of(left, right) if left.num_rows else None
        runs = x.removed(exchange.answers(right, 2)) if x else []
        return _report(left, x.bodies() if x else [], runs)

    return {0: first, 3: last}.get(phase, run)


def _report(left: pa.Table, bodies, runs) -> pa.Table:
    kept, removed, spans = [], [], []
    for body, r in zip(bodies, runs):
        keep, at = [], 0
        for lo, hi in r.tolist():
            keep.append(body[at:lo].tobytes())
            at = hi
        kept.append(b"".join([*keep, body[at:].tobytes()]))
        spans.append([{"start": lo, "end": hi} for lo, hi in r.tolist()])
        removed.append(int((r[:, 1] - r[:, 0]).sum()))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    more = {}
    if "rest" in left.column_names:
        more = {"rest": left["rest"], "left": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())}
    return pa.table({
        "id": left["id"], "n_bytes": pa.array([len(b) for b in bodies], pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span),
        "kept": pa.array(kept, pa.binary()), **more})


def _repeats(docs: DataFrame, min_bytes: int, doc_id: str, text: str, rest: Column | None = None) -> DataFrame:
    rows, cells = exchange.batched(docs, doc_id, text, BATCH_BYTES, rest)

    def sort(sent: DataFrame, phase: int) -> DataFrame:
        return sent.groupBy("cell").applyInArrow(_sort_cell(phase), exchange.ANSWER)

    def with_answers(got: DataFrame, phase: int, schema) -> DataFrame:
        return (rows.groupBy("batch").cogroup(got.groupBy("batch"))
                .applyInArrow(_phase(phase, min_bytes, cells), schema))

    got = sort(rows.groupBy("batch").applyInArrow(_phase(0, min_bytes, cells), exchange.SENT), 0)
    for phase in (1, 2):
        got = got.unionAll(sort(with_answers(got, phase, exchange.SENT), phase))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(
        "n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")])
    if rest is not None:
        schema = schema.add(rows.schema["rest"]).add("left", "string")
    return with_answers(got, 3, schema)


def repeats(docs: DataFrame, min_bytes: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte covered by a ``min_bytes``-byte string that also
    starts elsewhere, in the same or another row.

    One row per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``spans``
    (maximal removed runs as byte offsets) and ``kept`` (the remaining bytes;
    a run may cut a character).  Null texts are empty; repeated rows are copies
    of each other, so both lose their text if it is long enough; null ids are
    ids like any other; other columns are not read; an empty table gives none.
    """
    return _repeats(docs, min_bytes, doc_id, text).withColumnRenamed("id", doc_id)


def deduplicate(docs: DataFrame, min_bytes: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, columns as they are, with the texts that remain: a text that
    loses nothing stays as it is, a character that a removed run cuts goes as a
    whole, and a text that loses everything is empty."""
    other = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != text}
    rest = F.struct(F.col(text).isNull().alias("none"), *[F.col(c).alias(x) for c, x in other.items()])
    out = _repeats(docs, min_bytes, doc_id, text, rest)
    left = F.when(~F.col("rest.none"), F.col("left"))
    return out.select(*[left.alias(c) if c == text else F.col(f"rest.{other[c]}").alias(c) for c in docs.columns])
