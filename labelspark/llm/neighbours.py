"""Quality classifier: similarity-weighted votes of labelled neighbours in a
latent-semantic space.

Terms are word shapes (letters, capitals, digits and marks with runs squeezed),
pairs of adjoining shapes, and a term for a word that repeats the one before
it, hashed into a fixed number of bins.  Document frequencies are counted over
all rows.  The space is spanned by the leading singular vectors of a bounded
labelled sample; its vectors and labels are broadcast, and every document is
compared with all of them by exact cosine in blocks of rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.shared import bounded_sample, fold, keep, values
from labelspark.llm.superminhash import WORD, mix

BINS, RANK, NEIGHBOURS, SHARPNESS = 1024, 64, 25, 8
#: Bound of the labelled rows that vote.
MAX_LABELLED = 8_192
BLOCK = 512
_CACHE_WORDS = 100_000
_RUN = re.compile(r"(.)\1{2,}")
_KINDS = str.maketrans(
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "x" * 26 + "X" * 26 + "0" * 10)
_shapes: dict[str, int] = {}


def shape(word: str) -> str:
    """The word with letters as x, capitals as X, digits as 0, runs of three
    and more squeezed to two."""
    if not word.isascii():
        word = "".join(("X" if c.isupper() else "x") if c.isalpha() else c for c in word)
    return _RUN.sub(r"\1\1", word.translate(_KINDS))


def terms(text: str | None, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a text's terms (sorted, distinct) and how often each occurs."""
    words = WORD.findall(text) if text else []
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    if len(_shapes) > _CACHE_WORDS:
        _shapes.clear()
    for w in set(words).difference(_shapes):
        _shapes[w] = xxhash.xxh64_intdigest(shape(w).encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(_shapes.__getitem__, words), np.uint64, len(words))
    again = np.fromiter(map(str.__eq__, words[1:], words), bool, len(words) - 1)
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    # the last bin is that of repeated words
    found = np.concatenate((h, pairs)) % np.uint64(bins - 1)
    found = np.concatenate((found.astype(np.int64), np.full(int(again.sum()), bins - 1)))
    count = np.bincount(found, minlength=bins)
    at = np.nonzero(count)[0]
    return at.astype(np.int32), count[at].astype(np.int32)


def _extract(bins: int):
    def run(batches):
        for batch in batches:
            found = [terms(t, bins) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([a for a, _ in found], pa.list_(pa.int32())),
                 pa.array([c for _, c in found], pa.list_(pa.int32()))], names=["id", "bin", "tf"])

    return run


def _dense(bin_lists, tf_lists, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length (zero for texts without terms)."""
    sizes = np.array([len(b) for b in bin_lists], np.int64)
    out = np.zeros((len(sizes), len(idf)), np.float32)
    if sizes.sum():
        rows = np.repeat(np.arange(len(sizes)), sizes)
        at = np.concatenate([np.asarray(b, np.int64) for b in bin_lists])
        tf = np.concatenate([np.asarray(c, np.float64) for c in tf_lists])
        out[rows, at] = np.log1p(tf) * idf[at]
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class Space:
    """Latent axes, and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, idf: np.ndarray, rank: int = RANK):
        self.idf, self.y = idf, y.astype(np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5
        values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = axes[:, ::-1][:, :rank].astype(np.float32)
        self.vectors = _unit(x @ self.axes)

    def vote(self, x: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
        """Scores of unit rows: labels of the nearest labelled vectors, weighted
        by a power of their cosine; the share of label 1 without a neighbour."""
        out = np.full(len(x), self.prior)
        k = min(neighbours, len(self.y))
        for lo in range(0, len(x) if k else 0, BLOCK):
            cosine = _unit(x[lo : lo + BLOCK] @ self.axes) @ self.vectors.T
            near = np.argpartition(cosine, len(self.y) - k, axis=1)[:, len(self.y) - k :]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** sharpness
            total = weight.sum(axis=1)
            seen = total > 1e-9
            votes = (weight * self.y[near]).sum(axis=1)
            out[lo : lo + BLOCK][seen] = votes[seen] / total[seen]
        return np.clip(out, 0, 1)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
             bins: int = BINS, rank: int = RANK, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, ``held_out`` (crc32 of the id modulo 3 is 1), ``score`` (0 to 1,
    higher: label 1 likelier) and ``predicted`` (score of 0.5 and more) for
    every row of ``docs``.

    At most ``max_labelled`` labelled rows vote: those with the least hash of
    the id outside the held-out third; labels other than 0 and 1 are not used.
    Null and empty texts have no neighbour and score the share of label 1 among
    the voters, 0.5 without any.  Rows that share an id are scored each; a null
    id counts as the empty text for the fold and has no label; other columns
    are not read; an empty table gives none.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = keep(rows.mapInArrow(_extract(bins), f"id {dict(rows.dtypes)['id']}, bin array<int>, tf array<int>"))
    counted = found.select(F.explode("bin").alias("b")).groupBy("b").count().collect()  # at most ``bins`` rows
    df = np.zeros(bins)
    for r in counted:
        df[r["b"]] = r["count"]
    idf = np.log((1 + found.count()) / (1 + df)) + 1
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).alias("y"))
    sample = bounded_sample(found.join(known, "id").where(fold(F.col("id"), 3) != 1), "id", max_labelled).collect()
    space = Space(_dense([r["bin"] for r in sample], [r["tf"] for r in sample], idf), np.array([r["y"] for r in sample]), idf, rank)
    shared = docs.sparkSession.sparkContext.broadcast(space)  # max_labelled * rank floats

    def run(batches):
        for batch in batches:
            scores = [np.empty(0)]
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = _dense(part.column("bin").to_pylist(), part.column("tf").to_pylist(), shared.value.idf)
                scores.append(shared.value.vote(x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(scores))], names=["id", "score"])

    scored = found.mapInArrow(run, found.select("id", F.lit(0.0).alias("score")).schema)
    return scored.select(F.col("id").alias(doc_id), (fold(F.col("id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
