"""Quality rules: fixed rules on document statistics, then boosted trees.

The statistics of every whole text are computed in one pass.  Trees are fitted
on a bounded sample of labelled rows and scored on the statistics of all rows
as flat node arrays.  The score may only fall with the share of symbols,
repeated words, repeated lines, capitals and exclamation marks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.gbt import Forest, train
from labelspark.llm.shared import bounded_sample, fold, keep, values
from labelspark.llm.superminhash import WORD

SYMBOLS = b"#*$%&|<>"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 5
#: Bound of the labelled rows that the trees are fitted on.
MAX_LABELLED = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature of the trees and how the score may move with it.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "exclaim_share": -1, "bar_share": -1, "digit_share": 0, "stop_share": 0,
    "distinct_share": 0, "top_word_share": -1, "stutter_share": -1, "bare_share": 0, "other_share": 0,
}


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more.  Windows are told apart
    exactly: n-grams are renumbered as they grow."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    gram, size, width = ids, int(ids.max()) + 1, 1
    while width < window:
        step = min(width, window - width)  # doubling, then the rest by overlap
        k = len(gram) - step
        _, gram = np.unique(gram[:k] * np.int64(size) + gram[step : step + k], return_inverse=True)
        size, width = int(gram.max()) + 1, width + step
    often = np.bincount(gram)[gram] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.nonzero(often)[0]
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of one text (null: empty)."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = sum(map(len, words))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    symbols = int(raw[list(SYMBOLS)].sum())
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(ids)
    c, w = max(1, chars), max(1, n)
    top = int(np.bincount(ids).max()) if n else 0
    letters_end = sum(1 for x in words if x[-1].isalnum())
    features = [
        np.log1p(n), chars / w, symbols / c, dup / max(1, len(lines)), repeat / w,
        raw[65:91].sum() / c, raw[33] / c, raw[124] / c, raw[48:58].sum() / c, (raw[46] + raw[44]) / c,
        len(number) / w, top / w if n >= 20 else 0.0, float((ids[1:] == ids[:-1]).sum()) / w if n else 0.0,
        letters_end / w, raw[128:].sum() / c,
    ]
    return [n, chars, symbols, dup, repeat], [float(f) for f in features]


def _measure(batches):
    for batch in batches:
        found = [statistics(t) for t in values(batch.column("text"))]
        counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS)).T
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c) for c in counts], pa.array([f for _, f in found], pa.list_(pa.float64()))],
            names=["id", *COUNTS, "features"])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the five counts and ``features`` of every row."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, {', '.join(f'{c} bigint' for c in COUNTS)}, features array<double>"
    return rows.mapInArrow(_measure, schema)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
        max_labelled: int = MAX_LABELLED) -> Forest:
    """Trees from at most ``max_labelled`` labelled rows (those with the least
    hash of the id) outside the held-out third (crc32 of the id modulo 3 is 1);
    rows without a label of 0 or 1 are not used."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"))
    labelled = stats.select("id", "features").join(known, "id").where(fold(F.col("id"), 3) != 1)
    rows = bounded_sample(labelled, "id", max_labelled).collect()
    x = np.array([r["features"] for r in rows]).reshape(-1, len(FEATURES))
    return train(x, np.array([r["y"] for r in rows]), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, the five counts, ``base_failed``, ``score`` (chance of label 1) and
    ``kept`` for every row of ``docs``.

    ``base_failed``: fewer than ten words, or more than a fifth of the words in
    repeated windows.  Null and empty texts have zero counts and fail.  Rows
    that share an id are judged each; a null id has no label; without labelled
    rows every score is 0.5 and the fixed rules decide.  Other columns are not
    read; an empty table gives none.
    """
    stats = keep(measured(docs, doc_id, text))
    forest = fit(stats, labels, doc_id=doc_id, max_labelled=max_labelled)
    rest = ["id", *COUNTS]

    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = forest.predict(x) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(score, pa.float64())], names=[*rest, "score"])

    schema = stats.select(*rest, F.lit(0.0).alias("score")).schema
    out = stats.mapInArrow(run, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(F.col("id").alias(doc_id), *COUNTS, failed.alias("base_failed"),
                      "score", (~failed & (F.col("score") >= 0.5)).alias("kept"))
