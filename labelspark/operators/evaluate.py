"""Evaluation of scored pairs (J-11, E-24): one scoring pass, all metrics, and
the detail and summary records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics.classification import basic_metrics
from .metrics.curve import curve_stats
from .metrics.ranking import topk_metrics
from .prefix import materialize


def _join(a: DataFrame, b: DataFrame, keys: list) -> DataFrame:
    if not keys:
        return a.crossJoin(b)
    renamed = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:  # a key may be NULL
        same = same & a[k].eqNullSafe(renamed[f"_r_{k}"])
    return a.join(renamed, same).drop(*[f"_r_{k}" for k in keys])


def evaluate(pred: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5, ks: Sequence[int] = (1, 3, 5, 10),
             mrr_mode: str = "standard", path: str | None = None, sample: str = "sample_id",
             label: str = "label_id", score: str = "score", truth: str = "truth") -> DataFrame:
    """Metrics of ``pred`` (sample, label, truth, score), one row per value of
    ``keys`` (a (model, dataset) grid, or one row without keys): accuracy,
    precision, recall, F1, ROC AUC, average precision, and HR / MRR / P / NDCG
    at every k, with the numbers of samples and of pairs.

    The scores are written once, to ``path``/detail if a path is given, else to
    the shared folder, and every metric reads them from there, so a model
    behind ``pred`` runs once.  With a path the metrics are written to
    ``path``/metrics as well."""
    keys = list(keys)
    if path is not None:
        pred.write.mode("overwrite").parquet(f"{path}/detail")
        pred = pred.sparkSession.read.parquet(f"{path}/detail")
    else:
        pred = materialize(pred)
    out = pred.groupBy(*keys).agg(F.countDistinct(sample).alias("n_samples"), F.count(F.lit(1)).alias("n_pairs"))
    out = _join(out, basic_metrics(pred, threshold, keys, score, truth), keys)
    out = _join(out, curve_stats(pred, keys, score, truth), keys)
    out = _join(out, topk_metrics(pred, ks, keys, mrr_mode, sample, label, score, truth), keys)
    if path is not None:
        out.write.mode("overwrite").json(f"{path}/metrics")
        out = pred.sparkSession.read.schema(out.schema).json(f"{path}/metrics")
    return out
