"""BPE encoding and decoding with a transducer lexicon of frequent words.

The words of the whole corpus are counted; the most frequent ones are encoded
once and compiled into a minimal acyclic transducer (see ``lexicon``) that
every task memory-maps.  A word that is not in it is normalised, cut and merged
pair by pair, exactly as its rank-ordered merges say.  A word is what stands
between white space: no piece of the tokenizer reaches across.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm import lexicon
from labelspark.llm.shared import keep, worker_cache

#: White space as Unicode defines it (Python's split() would also
#: cut at the four information separators).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters, numbers and capitals (first, last, distance of the
#: small letter) that Unicode has gained since the version of this Python.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]
#: Size of the lexicon and the longest word in it; others are merged.
FREQUENT_WORDS, LONGEST = 131_072, 64
_CACHE_WORDS, _CACHE_PIECES = 500_000, 150_000
_COUNTED_WORDS = 100_000
_SHIFT = 32
_TOKEN, _NEVER = (1 << _SHIFT) - 1, 1 << 63
_LAST = (1 << 63) - 1
#: Pieces of more bytes are merged one by one, with a heap.
_LONG_PIECE = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable and not
    a space, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


def letter_class(major: str, new: list[tuple[int, int]]) -> str:
    """Inside of a character class: the general categories that start with
    ``major``, by this Python's Unicode tables and ``new``."""
    fresh = {c for lo, hi in new for c in range(lo, hi + 1)}
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == major or c in fresh:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in out)


class Tokenizer:
    """Tokenizer file with rank-ordered merges over byte letters, an end-of-word
    suffix, NFC and lower case."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | added).items()}
        # rank and merged token of a pair in one integer, so the least is the next
        self.pairs = {(vocab[a], vocab[b]): rank << _SHIFT | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        pairs = np.array([(a << _SHIFT | b, v) for (a, b), v in self.pairs.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        # the last entry is beyond every pair
        self.pair_keys, self.pair_values = np.append(pairs[:, 0], _LAST), np.append(pairs[:, 1], _LAST)
        self.byte_ids = np.array([self.inner, self.final], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        rule = split["pattern"]["Regex"].replace(r"\s", SPACE)
        for major, new in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
            rule = rule.replace(rf"\p{{{major}}}", letter_class(major, new))
        self.piece = re.compile(rule)
        self.small = {c: chr(c + d) for lo, hi, d in NEW_CAPITALS for c in range(lo, hi + 1)
                      if unicodedata.category(chr(c)) == "Cn"}
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.space = re.compile(f"[{SPACE}]+")
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def words(self, text: str) -> list[str]:
        """Words in order, with the added tokens as words of their own."""
        if not self.special.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.split(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split(text[at:])

    def split(self, text: str) -> list[str]:
        if SEPARATORS.search(text):
            return [w for w in self.space.split(text) if w]
        return text.split()

    def _cut(self, word: str) -> list[str]:
        """The pieces of a word, normalised."""
        word = unicodedata.normalize("NFC", word)
        # letter by letter: no special final form of sigma
        word = word.replace("Σ", "σ").lower()
        if not word.isascii():
            word = word.translate(self.small)
        return self.piece.findall(word)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, merged together; pieces are remembered."""
        if len(self.pieces) > _CACHE_PIECES:
            self.pieces.clear()
        pieces = self.pieces
        cut = [None if w in self.added else self._cut(w) for w in words]
        new = list({p for c in cut if c for p in c}.difference(pieces))
        coded = [p.encode("utf-8", "surrogatepass") for p in new]
        short = [i for i, p in enumerate(coded) if len(p) <= _LONG_PIECE]
        for i, ids in zip(short, self.merge_all([coded[i] for i in short])):
            pieces[new[i]] = ids
        for i, p in enumerate(coded):
            if len(p) > _LONG_PIECE:
                pieces[new[i]] = self.merge(p)
        return [[self.added[w]] if c is None else [i for p in c for i in pieces[p]] for w, c in zip(words, cut)]

    def encode_word(self, word: str) -> list[int]:
        return self.encode_words([word])[0]

    def merge_all(self, parts: list[bytes]) -> list[list[int]]:
        """What ``merge`` gives for each of many pieces: every round merges one
        pair in each piece that still has one."""
        out: list[list[int]] = [[]] * len(parts)
        if not parts:
            return out
        sizes = np.array([len(p) for p in parts])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        last = np.zeros(len(raw), np.int64)
        last[np.cumsum(sizes) - 1] = 1
        ids = self.byte_ids[last, raw]
        owner = np.repeat(np.arange(len(parts)), sizes)
        rank = np.full(len(ids), _LAST)
        rank[:-1] = self._ranks(ids[:-1], ids[1:], owner[:-1] == owner[1:])
        while len(ids):
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(start, append=len(ids))
            best = np.minimum.reduceat(rank, start)
            done = best == _LAST
            if done.any():
                for k, s, n in zip(owner[start[done]].tolist(), start[done].tolist(), size[done].tolist()):
                    out[k] = ids[s : s + n].tolist()
                rest = np.repeat(~done, size)
                ids, owner, rank = ids[rest], owner[rest], rank[rest]
                best, size = best[~done], size[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.diff(owner[at], prepend=-1) != 0]  # the leftmost of equal ones
            ids[at] = best & _TOKEN
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            at -= np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(ids)]
                rank[left] = self._ranks(ids[left], ids[left + 1], owner[left] == owner[left + 1])
            rank[-1] = _LAST
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Rank and merged token of pairs; _LAST where there is none."""
        keys = a << _SHIFT | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(together & (self.pair_keys[at] == keys), self.pair_values[at], _LAST)

    def merge(self, piece: bytes) -> list[int]:
        """Always the pair of the lowest rank, the leftmost of equal ones."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.final[piece[-1]]]
        if len(ids) > _LONG_PIECE:
            return self._merge_long(ids)
        get = self.pairs.get
        next_ = [get(p, _NEVER) for p in zip(ids, ids[1:])]
        while next_:
            best = min(next_)
            if best == _NEVER:
                break
            k, new = next_.index(best), best & _TOKEN
            ids[k : k + 2] = [new]
            del next_[k]
            if k < len(next_):
                next_[k] = get((new, ids[k + 1]), _NEVER)
            if k:
                next_[k - 1] = get((ids[k - 1], new), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for very long pieces."""
        n, pairs = len(ids), self.pairs
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                found = pairs.get((ids[k], ids[after[k]]))
                if found is not None:
                    heapq.heappush(heap, (found, k, ids[k], ids[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            found, k, a, b = heapq.heappop(heap)
            if ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], ids[gone] = found & _TOKEN, -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [i for i in ids if i >= 0]

    def encode(self, text: str, known: lexicon.Lexicon | None) -> bytes:
        return self.encode_all([text], known)[0]

    def encode_all(self, texts: list[str], known: lexicon.Lexicon | None) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        cache, words = self.cache, [self.words(t) for t in texts]
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        new, unseen = set().union(*words).difference(cache), []
        for w in new:
            ids = known.get(w.encode("utf-8", "surrogatepass")) if known else None
            if ids is None:
                unseen.append(w)
            else:
                cache[w] = ids
        for w, ids in zip(unseen, self.encode_words(unseen)):
            cache[w] = struct.pack(f"<{len(ids)}I", *ids)
        return [b"".join(map(cache.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> str:
        """Tokens with a space between each two, special ones included."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _tokenizer(spec: str) -> Tokenizer:
    known, key = worker_cache("bpe"), hash(spec)
    if key not in known:
        known.clear()
        known[key] = Tokenizer(spec)
    return known[key]


def _counter(spec):
    def run(batches):
        counts: Counter[str] = Counter()

        def flush():
            n = pa.array(list(counts.values()), pa.int64())
            words = pa.array([w.encode("utf-8", "surrogatepass") for w in counts], pa.binary())
            counts.clear()
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        words = _tokenizer(spec.value).words
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                for t in batch.column(0).slice(lo, _ROWS).to_pylist():
                    counts.update(words(t or ""))
                    if len(counts) > _COUNTED_WORDS:
                        yield flush()
        yield flush()

    return run


def frequent_words(docs: DataFrame, spec, size: int = FREQUENT_WORDS, text: str = "text") -> list[bytes]:
    """The most frequent words of the corpus of up to LONGEST bytes, counted
    over all rows: as many whole classes of counts (sixteen to an octave), from
    the top, as hold at most ``size`` words.  Only these reach the driver."""
    counted = docs.select(text).mapInArrow(_counter(spec), "word binary, n bigint")
    total = counted.where(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    total = keep(total.where("n > 1").withColumn("class", F.floor(F.log2("n") * 16).cast("int")))
    taken, least = 0, None
    for r in total.groupBy("class").count().orderBy(F.desc("class")).collect():  # under a thousand rows
        taken += r["count"]
        if taken > size:
            break
        least = r["class"]
    return [] if least is None else [bytes(r["word"]) for r in total.where(F.col("class") >= least).select("word").collect()]


_ROWS, _PART_BYTES = 64, 1 << 22


def _in_parts(batch: pa.RecordBatch, fields: list[tuple[str, pa.DataType]], function):
    """The batch with its last column replaced by what ``function`` makes of
    some values, a tuple with one value for each of ``fields``.  A few rows are
    read at a time and parts of a few MB are passed on, so memory does not grow
    with the batch."""
    at, out, weight = 0, [], 0
    for lo in range(0, batch.num_rows, _ROWS):
        made = function(batch.column(batch.num_columns - 1).slice(lo, _ROWS).to_pylist())
        out += made
        weight += sum(len(v) for one in made for v in one if isinstance(v, (bytes, str)))
        if weight >= _PART_BYTES or lo + _ROWS >= batch.num_rows:
            part = batch.slice(at, len(out)).select(range(batch.num_columns - 1))
            made = [pa.array([v[k] for v in out], kind) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(n for n, _ in fields)])
            at, out, weight = at + len(out), [], 0


def load(docs: DataFrame, path: str):
    """The tokenizer file, read by the driver and broadcast (a vocabulary file:
    a few MB whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def compiled(docs: DataFrame, spec, words: int, text: str):
    """The lexicon of the corpus's frequent words, broadcast (bounded by
    ``words`` entries of up to LONGEST bytes)."""
    tokenizer = Tokenizer(spec.value)
    frequent = frequent_words(docs, spec, words, text)
    entries: dict[bytes, list[int]] = {}
    for lo in range(0, len(frequent), 4096):
        part = frequent[lo : lo + 4096]
        entries.update(zip(part, tokenizer.encode_words([w.decode("utf-8", "surrogatepass") for w in part])))
    return docs.sparkSession.sparkContext.broadcast(lexicon.compile_lexicon(entries))


def _mapped(rows: DataFrame, source: str, fields: list[tuple[str, pa.DataType, object]], function_of) -> DataFrame:
    """``rows`` with column ``source`` replaced by ``fields`` (last), whose
    values ``function_of()`` makes in the tasks; columns named like one of the
    fields are replaced."""
    made = [(n, kind) for n, kind, _ in fields]
    rest = [c for c in rows.columns if c != source and c not in {n for n, _ in made}]
    rows = rows.select(*rest, source)

    def run(batches):
        function = function_of()
        for batch in batches:
            yield from _in_parts(batch, made, function)

    return rows.mapInArrow(run, rows.select(*rest, *[F.lit(x).alias(n) for n, _, x in fields]).schema)


def encode(docs: DataFrame, path: str, words: int = FREQUENT_WORDS, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the text column replaced by its ids (column ``out``, last),
    as little-endian unsigned 32-bit integers.  Special tokens that stand in a
    text are encoded as such, none are added.  Null and empty texts have no
    ids; other columns pass through (one named ``out`` is replaced); an empty
    table stays empty."""
    spec = load(docs, path)
    block = compiled(docs, spec, words, text)

    def function_of():
        t, known = _tokenizer(spec.value), lexicon.mapped(block.value)
        return lambda xs: [(ids,) for ids in t.encode_all([x or "" for x in xs], known)]

    return _mapped(docs, text, [(out, pa.binary(), b"")], function_of)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the ids replaced by the decoded text (column ``out``, last)."""
    spec = load(rows, path)

    def function_of():
        t = _tokenizer(spec.value)
        return lambda xs: [(t.decode(x or b""),) for x in xs]

    return _mapped(rows, ids, [(out, pa.string(), "")], function_of)


def round_trip(docs: DataFrame, path: str, words: int = FREQUENT_WORDS, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``n_tokens``, ``ids`` and ``decoded``:
    encoding and decoding in one pass over the texts."""
    spec = load(docs, path)
    block = compiled(docs, spec, words, text)

    def function_of():
        t, known = _tokenizer(spec.value), lexicon.mapped(block.value)

        def both(xs):
            return [(len(ids) // 4, ids, t.decode(ids)) for ids in t.encode_all([x or "" for x in xs], known)]

        return both

    fields = [("n_tokens", pa.int64(), F.lit(0).cast("long")), ("ids", pa.binary(), b""), ("decoded", pa.string(), "")]
    return _mapped(docs, text, fields, function_of)
