"""Threshold classification metrics on the long ``pred`` table.

``pred`` rows are ``(keys..., sample_id, label_id, truth INT 0/1, score DOUBLE)``;
every function takes optional group ``keys`` and is a ``groupBy(keys).agg``
with partial (map-side) aggregation, so a hot key is pre-combined before the
shuffle.  A prediction is positive when ``score > threshold`` (strict, as the
reference's binariser).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_div(n, d) -> Column:
    """n / d as DOUBLE, 0.0 when d == 0 (zero_division=0)."""
    n = F.col(n) if isinstance(n, str) else n
    d = F.col(d) if isinstance(d, str) else d
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def _is_pos(score: str, threshold: float) -> Column:
    return F.col(score) > F.lit(float(threshold))


def confusion_counts(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
                     score: str = "score", truth: str = "truth") -> DataFrame:
    """E-1: TP / FP / FN / TN (BIGINT) per key group."""
    p = _is_pos(score, threshold)
    y = F.col(truth) == 1
    return pred.groupBy(*keys).agg(
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"),
        F.count_if(~p & ~y).alias("tn"),
    )


def metrics_from_counts(counts: DataFrame, keys: Sequence[str] = (),
                        which: Sequence[str] = ("accuracy", "precision", "recall", "f1"),
                        ) -> DataFrame:
    """Derive ratio metrics from a tp/fp/fn/tn table."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    den = ((tp + fp).cast("double") * (tp + fn).cast("double")
           * (tn + fp).cast("double") * (tn + fn).cast("double"))
    exprs = {
        "accuracy": safe_div(tp + tn, n),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "jaccard": safe_div(tp, tp + fp + fn),
        "hamming_loss": safe_div(fp + fn, n),
        "matthews_corrcoef": F.when(den == 0, F.lit(0.0)).otherwise(
            (tp.cast("double") * tn.cast("double") - fp.cast("double") * fn.cast("double"))
            / F.sqrt(den)),
    }
    return counts.select(*keys, *[exprs[w].alias(w) for w in which])


def basic_metrics(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
                  score: str = "score", truth: str = "truth") -> DataFrame:
    """E-2: accuracy, precision, recall, F1 (binary / micro over all cells)."""
    return metrics_from_counts(confusion_counts(pred, threshold, keys, score, truth), keys)


def jaccard(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
            score: str = "score", truth: str = "truth") -> DataFrame:
    """E-4 binary / micro Jaccard: TP / (TP + FP + FN)."""
    return metrics_from_counts(confusion_counts(pred, threshold, keys, score, truth),
                               keys, ("jaccard",))


def hamming_loss(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
                 score: str = "score", truth: str = "truth") -> DataFrame:
    """E-5: fraction of wrong cells."""
    p = _is_pos(score, threshold).cast("int")
    return pred.groupBy(*keys).agg(
        F.avg((p != F.col(truth)).cast("double")).alias("hamming_loss"))


def matthews(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
             score: str = "score", truth: str = "truth") -> DataFrame:
    """E-6: Matthews correlation in DOUBLE, 0 when undefined."""
    return metrics_from_counts(confusion_counts(pred, threshold, keys, score, truth),
                               keys, ("matthews_corrcoef",))


def diagnostic_stats(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
                     score: str = "score", truth: str = "truth") -> DataFrame:
    """E-14: support, threshold, number of positives, mean probability."""
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support"),
        F.lit(float(threshold)).alias("threshold"),
        F.sum(F.col(truth).cast("long")).alias("num_positive"),
        F.avg(F.col(score).cast("double")).alias("avg_probability"),
    )


def argmax_label(label: str, value: str) -> Column:
    """Label with the largest value, the smallest label on ties (np.argmax)."""
    return F.max_by(F.col(label), F.struct(F.col(value), -F.col(label)))


def sample_argmax(pred: DataFrame, keys: Sequence[str] = (), sample: str = "sample_id",
                  label: str = "label_id", score: str = "score",
                  truth: str = "truth") -> DataFrame:
    """Per sample: argmax of truth (the true class) and argmax of score."""
    return pred.groupBy(*keys, sample).agg(
        argmax_label(label, truth).alias("true_class"),
        argmax_label(label, score).alias("pred_class"),
    )


def match_accuracy(pred: DataFrame, keys: Sequence[str] = (), sample: str = "sample_id",
                   label: str = "label_id", score: str = "score",
                   truth: str = "truth") -> DataFrame:
    """E-13: share of samples whose argmax score hits the argmax truth."""
    s = sample_argmax(pred, keys, sample, label, score, truth)
    return s.groupBy(*keys).agg(
        F.avg((F.col("true_class") == F.col("pred_class")).cast("double"))
        .alias("match_accuracy"))


def per_class_counts(samples: DataFrame, keys: Sequence[str] = (),
                     true_col: str = "true_class", pred_col: str = "pred_class") -> DataFrame:
    """Per class: support (#true), n_pred (#predicted) and tp, in one pass
    (each sample is emitted once as its true class and once as its guess)."""
    hit = (F.col(true_col) == F.col(pred_col)).cast("long")
    both = F.array(
        F.struct(F.col(true_col).cast("string").alias("class"), F.lit(1).cast("long").alias("t"),
                 F.lit(0).cast("long").alias("p"), hit.alias("h")),
        F.struct(F.col(pred_col).cast("string").alias("class"), F.lit(0).cast("long").alias("t"),
                 F.lit(1).cast("long").alias("p"), F.lit(0).cast("long").alias("h")),
    )
    rows = samples.select(*keys, F.inline(both))
    return rows.groupBy(*keys, "class").agg(
        F.sum("t").alias("support"), F.sum("p").alias("n_pred"), F.sum("h").alias("tp"))


def classification_report(samples: DataFrame, keys: Sequence[str] = (),
                          true_col: str = "true_class",
                          pred_col: str = "pred_class") -> DataFrame:
    """E-3: per-class precision / recall / F1 / support plus 'macro avg' and
    'weighted avg' rows (weights = support; classes seen in truth or guess)."""
    c = per_class_counts(samples, keys, true_col, pred_col)
    per = c.select(
        *keys, "class",
        safe_div("tp", "n_pred").alias("precision"),
        safe_div("tp", "support").alias("recall"),
        safe_div(2 * F.col("tp"), F.col("support") + F.col("n_pred")).alias("f1"),
        F.col("support"),
    )
    tot = F.sum("support")
    macro = per.groupBy(*keys).agg(
        F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    weighted = per.groupBy(*keys).agg(
        F.lit("weighted avg").alias("class"),
        safe_div(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
        safe_div(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
        safe_div(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"),
        tot.alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def weighted_metrics(samples: DataFrame, keys: Sequence[str] = (),
                     true_col: str = "true_class", pred_col: str = "pred_class") -> DataFrame:
    """Multi-class accuracy and support-weighted precision / recall / F1."""
    rep = classification_report(samples, keys, true_col, pred_col)
    w = rep.filter(F.col("class") == "weighted avg").select(
        *keys, "precision", "recall", "f1")
    acc = samples.groupBy(*keys).agg(
        F.avg((F.col(true_col) == F.col(pred_col)).cast("double")).alias("accuracy"))
    return acc.join(w, on=list(keys), how="inner") if keys else acc.crossJoin(w)


def sample_set_metrics(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
                       sample: str = "sample_id", score: str = "score",
                       truth: str = "truth") -> DataFrame:
    """E-4 (samples) and E-7: per-sample intersection / union of the predicted
    and true label sets, averaged.  ``hamming_score`` counts both-empty
    samples as 1.0, ``jaccard_samples`` as 0.0 (zero_division=0);
    ``subset_accuracy`` is the exact row match (micro accuracy on 2-D)."""
    p = _is_pos(score, threshold)
    y = F.col(truth) == 1
    per = pred.groupBy(*keys, sample).agg(
        F.count_if(p & y).alias("inter"), F.count_if(p | y).alias("uni"),
        F.count_if(p != y).alias("wrong"))
    ratio = safe_div("inter", "uni")
    return per.groupBy(*keys).agg(
        F.avg(F.when(F.col("uni") == 0, F.lit(1.0)).otherwise(ratio)).alias("hamming_score"),
        F.avg(ratio).alias("jaccard_samples"),
        F.avg((F.col("wrong") == 0).cast("double")).alias("subset_accuracy"),
    )


def problem_type(pred: DataFrame, keys: Sequence[str] = (), sample: str = "sample_id",
                 truth: str = "truth") -> DataFrame:
    """E-15: multilabel when samples carry more than one label column;
    one-hot multiclass when additionally the largest truth row-sum is 1."""
    per = pred.groupBy(*keys, sample).agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum(F.col(truth).cast("long")).alias("row_truth"))
    agg = per.groupBy(*keys).agg(
        F.max("n_labels").alias("max_labels"), F.max("row_truth").alias("max_row_truth"))
    multi = F.col("max_labels") > 1
    onehot = multi & (F.col("max_row_truth") == 1)
    return agg.select(
        *keys, "max_labels", "max_row_truth", multi.alias("is_multilabel"),
        onehot.alias("is_onehot"),
        F.when(onehot, F.lit("multiclass")).when(multi, F.lit("multilabel"))
        .otherwise(F.lit("binary")).alias("problem_type"))


def sample_summary(pred: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
                   sample: str = "sample_id", label: str = "label_id", score: str = "score",
                   truth: str = "truth") -> DataFrame:
    """E-4 (samples), E-7, E-13 and E-15 from ONE per-sample aggregation:
    problem type, hamming score, samples Jaccard, subset accuracy and match
    accuracy per key."""
    p = _is_pos(score, threshold)
    y = F.col(truth) == 1
    per = pred.groupBy(*keys, sample).agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum(F.col(truth).cast("long")).alias("row_truth"),
        F.count_if(p & y).alias("inter"), F.count_if(p | y).alias("uni"),
        F.count_if(p != y).alias("wrong"),
        argmax_label(label, truth).alias("true_class"), argmax_label(label, score).alias("pred_class"))
    ratio = safe_div("inter", "uni")
    agg = per.groupBy(*keys).agg(
        F.max("n_labels").alias("max_labels"), F.max("row_truth").alias("max_row_truth"),
        F.avg(F.when(F.col("uni") == 0, F.lit(1.0)).otherwise(ratio)).alias("hamming_score"),
        F.avg(ratio).alias("jaccard_samples"),
        F.avg((F.col("wrong") == 0).cast("double")).alias("subset_accuracy"),
        F.avg((F.col("true_class") == F.col("pred_class")).cast("double")).alias("match_accuracy"))
    multi = F.col("max_labels") > 1
    onehot = multi & (F.col("max_row_truth") == 1)
    return agg.withColumn("problem_type", F.when(onehot, F.lit("multiclass"))
                          .when(multi, F.lit("multilabel")).otherwise(F.lit("binary")))
