"""Toxicity: restore disguised words through a noisy channel, then score the
restored text with terms learned from labels.

The channel's character language model is counted over all documents.  Terms
are words and word beginnings.  A term is believed if it occurs in toxic
documents so much more often than their share that chance is ruled out; its
occurrences there are counted by distinct word before it, so that copies of one
text count once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm import channel
from labelspark.llm.shared import bounded_sample, fold, keep, values, worker_cache
from labelspark.llm.superminhash import WORD

#: Bound of the labelled rows that terms are learned from.
MAX_LABELLED = 16_384
SHORTEST, LONGEST_START = 3, 8
CHANCE = 0.05
#: Score from which a row is predicted toxic.
TOXIC = 0.7
_CACHE_WORDS = 200_000
#: Pieces of long words, and by how much they overlap (longer than the words looked for).
_PIECE, _OVERLAP = 64, 32
_OUTER = " .,;:!?()[]{}<>\"'`*_#%&|/\\+=~^-–—‘’“”…«»"


def bare(raw: str) -> str:
    """A word or stretch without outer marks."""
    return raw.rstrip(_OUTER + "$@").lstrip(_OUTER)


class Restorer:
    """Words of a text after restoration; remembers words it has seen."""

    def __init__(self, model: channel.CharModel):
        self.model, self.cache = model, worker_cache(f"toxicity {model.key}")

    def word(self, raw: str) -> list[str]:
        """What a word (lower case) stands for: usually itself without outer marks."""
        core = bare(raw)
        if not core or not channel.suspicious(core):
            return [core] if core else []
        return [core, *self._pieces(channel.squeezed(core))]

    def _pieces(self, core: str, stretch: bool = False) -> list[str]:
        # pieces bound the search; a disguised word lies within one of them
        starts = range(0, max(1, len(core) - _OVERLAP), _PIECE - _OVERLAP)
        return " ".join(channel.decode(core[k : k + _PIECE], self.model, stretch) for k in starts).split()

    def stretch(self, text: str) -> list[str]:
        """The words that a stretch of text (lower case) stands for."""
        key = " " + text  # no word starts with a space
        if key not in self.cache:
            if len(self.cache) > _CACHE_WORDS:
                self.cache.clear()
            self.cache[key] = self._pieces(text, True)
            parts = text.split()
            if len(parts) > 2 and max(map(len, parts)) == 1:  # letters set apart: no gap stands for itself
                self.cache[key] += self._pieces(channel.squeezed("".join(parts)), True)
        return self.cache[key]

    def learned(self, raw: set[str]) -> dict[str, list[str]]:
        """The memory, with what each of some words (lower case) stands for."""
        cache = self.cache
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        for w in raw.difference(cache):
            cache[w] = self.word(w)
        return cache

    def apart(self, low: str) -> list[list[str]]:
        """What letters that were set apart stand for."""
        return [self.word(w) for m in channel.APART.finditer(low) for w in channel.together(m[0])]

    def words(self, text: str | None) -> list[list[str]]:
        """For every word of the text, in order, what it stands for; then what
        letters that were set apart stand for."""
        low = (text or "").lower()
        raw = WORD.findall(low)
        known = self.learned(set(raw))
        return [known[w] for w in raw] + self.apart(low)

    def text(self, text: str | None) -> str:
        """The restored text, words parted by single spaces."""
        return " ".join(" ".join(w[1:] or w) for w in self.words(text) if w)


def terms(word: str) -> list[str]:
    """A word of three letters or more, and its beginnings (marked by ^)."""
    if len(word) < 3:
        return []
    return [word, *(word[:k] + "^" for k in range(SHORTEST, min(len(word), LONGEST_START + 1)))]


def char_model(docs: DataFrame, text: str = "text") -> channel.CharModel:
    """Trigrams of character classes over all rows: a table of fixed size."""
    size = channel.SIZE**3

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for t in values(batch.column(0)):
                if t:
                    at, n = np.unique(channel.trigram_counts(t), return_counts=True)
                    total[at] += n
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    counts = np.zeros(size)
    rows = docs.select(text).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        counts[r["i"]] = r["n"]
    return channel.CharModel(counts)


class Judge:
    """Evidence of believed terms in texts; remembers the words it has seen."""

    def __init__(self, model: channel.CharModel, believed: dict[str, float]):
        self.restorer, self.believed = Restorer(model), believed
        self.spot = channel.Spotter(x for x in believed if not x.endswith("^"))
        self.starts = {x[:SHORTEST] for x in believed}
        self.odds: dict[str, float] = {}  # of restored words that tell
        self.silent: set[str] = set()  # words as written without a telling one
        self.telling: dict[str, list[str]] = {}  # the others

    def _tells(self, word: str) -> bool:
        if word[:SHORTEST] not in self.starts:
            return False
        if word not in self.odds:
            p = max((self.believed.get(x, 0.0) for x in terms(word)), default=0.0)
            if not p:
                return False
            self.odds[word] = math.log(p / (1 - p))
        return True

    def evidence(self, text: str | None) -> tuple[list[str], float]:
        """Distinct restored words with a believed term (sorted), and the sum of
        their log-odds.  Words that are split up or joined are restored where
        the letters of a believed one stand."""
        low = (text or "").lower()
        raw = set(WORD.findall(low))
        known = self.restorer.learned(raw)
        if len(self.silent) + len(self.telling) > _CACHE_WORDS:
            self.silent.clear()
            self.telling.clear()
        for w in (raw - self.silent).difference(self.telling):
            found = [x for x in known[w] if self._tells(x)]
            if found:
                self.telling[w] = found
            else:
                self.silent.add(w)
        hits = {x for w in raw.intersection(self.telling) for x in self.telling[w]}
        apart = {x for ws in self.restorer.apart(low) for x in ws}
        hits.update(filter(self._tells, apart))
        parts = {bare(x) for x in self.spot.stretches(low)}
        if parts:
            parts -= apart.union(*map(known.__getitem__, raw))
            hits.update(x for part in parts for x in self.restorer.stretch(part) if self._tells(x))
        return sorted(hits), sum(self.odds[w] for w in sorted(hits))


class Calibration:
    """Chance of label 1 by evidence: shares in the labelled sample, made to
    rise with the evidence by pooling neighbours that fall."""

    LAST = 12

    def __init__(self, counts: dict[tuple[int, int], int], prior: float):
        pools: list[list[float]] = []  # weight, weighted share, number of bins
        for b in range(self.LAST + 1):
            n, t = counts.get((b, 0), 0) + counts.get((b, 1), 0), counts.get((b, 1), 0)
            guess = prior / 10 if b == 0 else 1 - 1 / (1 + b)
            pools.append([n + 1.0, t + guess, 1])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] > pools[-1][1] * pools[-2][0]:
                w, s, k = pools.pop()
                pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2] + k]
        self.share = [s / w for w, s, k in pools for _ in range(k)]

    @classmethod
    def bin(cls, total: float) -> int:
        return min(cls.LAST, math.ceil(total))

    def __call__(self, total: float) -> float:
        """Rises a little within a bin too, so that more evidence ranks higher."""
        p = self.share[self.bin(total)]
        return p + (1 - p) * 1e-3 * (1 - math.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, model, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
          max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], Calibration]:
    """Believed terms with the chance that a document holding one is toxic, and
    the chance of a document by the evidence in it."""
    known = (labels.where(F.col(label).isin(0, 1) & (fold(F.col(doc_id), 3) != 1))
             .select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")))
    known = bounded_sample(known, "id", max_labelled)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    sample = keep(sample.select("y", "text").distinct())  # copies count once, wherever they are
    texts = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    total = sum(texts.values())
    prior = texts.get(1, 0) / total if total else 0.5

    def in_toxic(batches):
        """(term, word before it): distinct ones of the toxic texts."""
        r = Restorer(model.value)
        for batch in batches:
            found = set()
            for y, t in zip(values(batch.column("y")), values(batch.column("text"))):
                if y == 1:
                    before = ""
                    for ws in r.words(t):
                        found.update((x, before) for w in ws for x in terms(w))
                        before = ws[0] if ws else before
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["term", "before"])

    toxic = sample.where("y = 1").mapInArrow(in_toxic, "term string, before string").distinct()
    support = toxic.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    proof = math.log(max(1, support.count()) / CHANCE)
    # a term of less support can't be believed, were it in no clean text at all
    least = max(3, math.ceil(proof / -math.log(prior) - 1e-9)) if 0 < prior < 1 else 1 << 62
    support = support.where(F.col("n") >= least)
    wanted = docs.sparkSession.sparkContext.broadcast({r["term"]: r["n"] for r in support.collect()})

    def in_all(batches):
        r, counts = Restorer(model.value), Counter()
        for batch in batches:
            for y, t in zip(values(batch.column("y")), values(batch.column("text"))):
                counts.update((x, y) for x in {x for ws in r.words(t) for w in ws for x in terms(w)} & wanted.value.keys())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()),
                                          pa.array(list(counts.values()), pa.int64())], names=["term", "y", "n"])

    counted = sample.mapInArrow(in_all, "term string, y int, n bigint").groupBy("term", "y").agg(F.sum("n").alias("n"))
    docs_in = {(r["term"], r["y"]): r["n"] for r in counted.collect()}
    believed = {}
    for x, s in wanted.value.items():
        s, c = min(s, docs_in.get((x, 1), 0)), docs_in.get((x, 0), 0)
        share = s / (s + c) if s else 0.0
        if share > 0.8:
            gain = s * math.log(share / prior) + (c * math.log((1 - share) / (1 - prior)) if c else 0.0)
            if gain >= proof:
                believed[x] = (s + 0.5) / (s + c + 1)
    terms_known = docs.sparkSession.sparkContext.broadcast(believed)

    def in_bins(batches):
        judge, counts = Judge(model.value, terms_known.value), Counter()
        for batch in batches:
            for y, t in zip(values(batch.column("y")), values(batch.column("text"))):
                counts[Calibration.bin(judge.evidence(t)[1]), y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in counts], pa.int32()), pa.array([y for _, y in counts], pa.int32()),
                                          pa.array(list(counts.values()), pa.int64())], names=["bin", "y", "n"])

    binned = sample.mapInArrow(in_bins, "bin int, y int, n bigint").groupBy("bin", "y").agg(F.sum("n").alias("n")).collect()
    return believed, Calibration({(r["bin"], r["y"]): r["n"] for r in binned}, prior)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
          max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, ``held_out`` (crc32 of the id modulo 3 is 1), ``score`` (0 to 1),
    ``predicted`` (score of 0.7 and more) and ``found`` (the restored words
    that speak for it, sorted) for every row of ``docs``.

    Terms are learned from at most ``max_labelled`` labels (least hash of the
    id) outside the held-out third; labels other than 0 and 1 are not used.
    The score is the share of toxic rows among labelled ones with as much
    evidence (log-odds of the believed terms).  Null and empty texts score as
    texts without evidence; rows that share an id are scored each; a null id
    counts as the empty text for the fold and has no label; without labels no
    term is believed; other columns are not read; an empty table gives none.
    """
    model, lexicon = _trained(docs, labels, label, doc_id, text, max_labelled)

    def run(batches):
        judge = _judge(model, lexicon)
        for batch in batches:
            found = [judge(t) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([p for _, p in found], pa.float64()),
                 pa.array([h for h, _ in found], pa.list_(pa.string()))], names=["id", "score", "found"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double, found array<string>")
    return out.select(F.col("id").alias(doc_id), (fold(F.col("id"), 3) == 1).alias("held_out"), "score",
                      (F.col("score") >= TOXIC).cast("int").alias("predicted"), "found")


def _trained(docs, labels, label, doc_id, text, max_labelled):
    """The character model and the terms, broadcast (both of bounded size)."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(char_model(docs, text))
    return model, sc.broadcast(learn(docs, labels, model, label, doc_id, text, max_labelled))


def _judge(model, lexicon):
    """Function from a text to its telling words and its score, in a task."""
    believed, chance = lexicon.value
    evidence = Judge(model.value, believed).evidence

    def judge(text):
        hits, total = evidence(text)
        return hits, chance(total)

    return judge


def filtered(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs``, columns as they are, without the rows whose score is 0.7 and
    more (see ``score``).  Every row is judged where it is: nothing is shuffled."""
    model, lexicon = _trained(docs, labels, label, doc_id, text, max_labelled)
    at = docs.columns.index(text)

    def run(batches):
        judge = _judge(model, lexicon)
        for batch in batches:
            yield batch.filter(pa.array([judge(t)[1] < TOXIC for t in values(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
