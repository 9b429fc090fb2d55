"""Metric bundles (E-16) and the evaluation grid (E-24)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.activation import sigmoid
from .classification import metrics_from_counts, sample_summary
from .curve import collapse_scores, counts_from_collapsed, curve_from_collapsed, macro_curve
from .ranking import ranking_summary

# Public metric names, which are the output columns.
BINARY = ("accuracy", "precision", "recall", "f1", "jaccard", "hamming_loss",
          "matthews_corrcoef")


def _join(a: DataFrame, b: DataFrame, keys: list) -> DataFrame:
    return a.join(b, on=keys, how="inner") if keys else a.crossJoin(b)


def metric_bundle(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
                  activated: bool = True, mode: str = "flat", sample: str = "sample_id",
                  label: str = "label_id", score: str = "score",
                  truth: str = "truth") -> DataFrame:
    """E-16: one row of metrics per key.

    ``mode='flat'`` reproduces the reference's effective behaviour (every
    (sample, label) cell is one binary decision).  ``mode='auto'`` follows the
    documented intent: it detects the problem type per key and fills the
    binary, one-hot or multi-label columns, leaving the others NULL.
    Diagnostics are added when ``activated``; otherwise scores are passed
    through a sigmoid first.
    """
    keys = list(keys)
    if not activated:
        pred = pred.withColumn(score, sigmoid(score))
    coll = collapse_scores(pred, keys, score, truth)  # the single pass over pred
    counts = counts_from_collapsed(coll, threshold, keys, score)
    flat = metrics_from_counts(counts, keys, BINARY)
    out = _join(flat, curve_from_collapsed(coll, keys, score), keys)
    if activated:
        diag = counts.select(*keys, "support", F.lit(float(threshold)).alias("threshold"),
                             "num_positive", "avg_probability")
        out = _join(out, diag, keys)
    if mode == "flat":
        return out
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    summ = sample_summary(pred, threshold, keys, sample, label, score, truth)
    ranks = ranking_summary(pred, keys, sample, score, truth)
    out = _join(_join(_join(out, summ, keys), ranks, keys),
                macro_curve(pred, keys, label, score, truth), keys)
    multi = F.col("problem_type") == "multilabel"
    onehot = F.col("problem_type") == "multiclass"
    binary = F.col("problem_type") == "binary"
    cols = [F.col(k) for k in keys] + [F.col("problem_type")]
    cols.append(F.when(multi | onehot, F.col("subset_accuracy"))
                .otherwise(F.col("accuracy")).alias("accuracy"))
    cols += [F.col(c) for c in ("precision", "recall", "f1")]
    for c in ("jaccard", "hamming_loss", "matthews_corrcoef", "roc_auc", "avg_precision"):
        cols.append(F.when(binary, F.col(c)).alias(c))
    cols.append(F.when(onehot, F.col("match_accuracy")).alias("match_accuracy"))
    for c in ("hamming_score", "jaccard_samples", "coverage_error",
              "label_ranking_avg_precision", "roc_auc_macro", "avg_precision_macro"):
        cols.append(F.when(multi, F.col(c)).alias(c))
    cols.append(F.when(multi, F.col("jaccard")).alias("jaccard_micro"))
    cols.append(F.when(multi, F.col("hamming_loss")).alias("hamming_loss_multilabel"))
    if activated:
        cols += [F.col(c) for c in ("support", "threshold", "num_positive", "avg_probability")]
    return out.select(*cols)


def evaluation_grid(pred: DataFrame, model: str = "model", dataset: str = "dataset",
                    threshold: float = 0.5, score: str = "score",
                    truth: str = "truth") -> DataFrame:
    """E-24 re-aimed: every (model, dataset) cell plus per-model and overall
    totals in one job via ROLLUP (grouping sets ((m, d), (m), ()))."""
    p = F.col(score) > F.lit(float(threshold))
    y = F.col(truth) == 1
    agg = pred.rollup(model, dataset).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"),
        F.avg(F.col(score).cast("double")).alias("avg_probability"),
        F.countDistinct("sample_id").alias("n_samples"))
    m = metrics_from_counts(agg, [model, dataset, "avg_probability", "n_samples", "tp", "fp",
                                  "fn", "tn"])
    return m.select(model, dataset, "n_samples",
                    (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("support"),
                    (F.col("tp") + F.col("fn")).alias("num_positive"),
                    "avg_probability", "accuracy", "precision", "recall", "f1")
