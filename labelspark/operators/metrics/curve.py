"""Score-curve metrics (E-8 .. E-10, G-5): ROC-AUC and average precision.

Rows are first collapsed to one row per distinct ``(keys, score)`` with the
positive / negative counts (partial aggregation), then a distributed prefix
sum (:func:`labelspark.operators.prefix.running_sums`) gives the cumulative
counts.  Tied scores share one row, which is exactly mid-rank AUC and the
"distinct thresholds" definition of AP.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..prefix import materialize, running_sums


def collapse_scores(pred: DataFrame, keys: Sequence[str] = (), score: str = "score",
                    truth: str = "truth", materialized: bool = True) -> DataFrame:
    """One row per distinct ``(keys, score)`` with the positive / negative
    counts (partial aggregation).  Everything score-based (confusion counts,
    diagnostics, curves, threshold search) can be derived from this table, so
    an evaluation reads ``pred`` once; it is written to the shared folder so later passes do
    not recompute ``pred``."""
    y = (F.col(truth) == 1).cast("long")
    c = pred.groupBy(*keys, score).agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    return materialize(c) if materialized else c


def curve_from_collapsed(coll: DataFrame, keys: Sequence[str] = (), score: str = "score",
                         n_buckets: int | None = None) -> DataFrame:
    """ROC-AUC and AP from a collapsed score table."""
    keys = list(keys)
    run = running_sums(coll, keys, [(score, True)],
                       {"pos_below": F.col("pos"), "neg_below": F.col("neg")},
                       inclusive=False, n_buckets=n_buckets)
    totals = coll.groupBy(*keys).agg(F.sum("pos").alias("tot_pos"),
                                     F.sum("neg").alias("tot_neg"))
    run = (run.join(totals, on=keys, how="inner") if keys
           else run.crossJoin(F.broadcast(totals)))
    # descending inclusive counts at this score = totals minus the rows below
    tp_at = F.col("tot_pos") - F.col("pos_below")
    all_at = F.col("tot_pos") + F.col("tot_neg") - F.col("pos_below") - F.col("neg_below")
    per = run.select(
        *keys,
        (F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))).alias("auc_part"),
        (F.col("pos") * (tp_at.cast("double") / all_at.cast("double"))).alias("ap_part"),
        "tot_pos", "tot_neg")
    agg = per.groupBy(*keys).agg(
        F.sum("auc_part").alias("auc_sum"), F.sum("ap_part").alias("ap_sum"),
        F.first("tot_pos").alias("tot_pos"), F.first("tot_neg").alias("tot_neg"))
    defined = (F.col("tot_pos") > 0) & (F.col("tot_neg") > 0)
    return agg.select(
        *keys,
        F.when(defined, F.col("auc_sum")
               / (F.col("tot_pos").cast("double") * F.col("tot_neg").cast("double")))
        .alias("roc_auc"),
        F.when(F.col("tot_pos") > 0, F.col("ap_sum") / F.col("tot_pos"))
        .otherwise(F.lit(0.0)).alias("avg_precision"))


def curve_stats(pred: DataFrame, keys: Sequence[str] = (), score: str = "score",
                truth: str = "truth", n_buckets: int | None = None) -> DataFrame:
    """Per key: roc_auc (NULL when one class is missing) and avg_precision
    (0 when there is no positive)."""
    return curve_from_collapsed(collapse_scores(pred, keys, score, truth), keys, score,
                                n_buckets)


def counts_from_collapsed(coll: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
                          score: str = "score") -> DataFrame:
    """E-1 / E-14 from a collapsed table: tp / fp / fn / tn at ``score >
    threshold`` plus support, positives and the mean score."""
    p = F.col(score) > F.lit(float(threshold))
    n = F.col("pos") + F.col("neg")
    return coll.groupBy(*keys).agg(
        F.sum(F.when(p, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(p, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(p, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(p, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(n).alias("support"), F.sum("pos").alias("num_positive"),
        (F.sum(F.col(score).cast("double") * n) / F.sum(n)).alias("avg_probability"))


def roc_auc(pred: DataFrame, keys: Sequence[str] = (), score: str = "score",
            truth: str = "truth") -> DataFrame:
    """E-8: binary ROC-AUC with mid-rank ties."""
    return curve_stats(pred, keys, score, truth).select(*keys, "roc_auc")


def average_precision(pred: DataFrame, keys: Sequence[str] = (), score: str = "score",
                      truth: str = "truth") -> DataFrame:
    """E-10: step-wise average precision over distinct scores."""
    return curve_stats(pred, keys, score, truth).select(*keys, "avg_precision")


def macro_curve(pred: DataFrame, keys: Sequence[str] = (), label: str = "label_id",
                score: str = "score", truth: str = "truth") -> DataFrame:
    """E-9 / E-10 macro: per label column, then the plain mean over labels."""
    per = curve_stats(pred, list(keys) + [label], score, truth)
    return per.groupBy(*keys).agg(F.avg("roc_auc").alias("roc_auc_macro"),
                                  F.avg("avg_precision").alias("avg_precision_macro"))
