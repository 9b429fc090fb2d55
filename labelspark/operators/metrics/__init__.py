"""Classification, curve, ranking and threshold metrics on the long ``pred`` table."""

from .bundle import evaluation_grid, metric_bundle
from .classification import (basic_metrics, classification_report, confusion_counts,
                             diagnostic_stats, hamming_loss, jaccard, match_accuracy,
                             matthews, metrics_from_counts, problem_type, sample_argmax,
                             sample_set_metrics, weighted_metrics)
from .curve import average_precision, curve_stats, macro_curve, roc_auc
from .ranking import (coverage_error, hit_rate_at_k, label_ranking_ap, mrr_at_k,
                      ndcg_at_k, precision_at_k, rank_labels, topk_metrics, topk_suite)
from .user import METRICS, register_metric, user_metrics
from .threshold import best_metrics, best_threshold, threshold_grid, threshold_table
from .totals import evaluation_totals

__all__ = [
    "METRICS", "average_precision", "basic_metrics", "best_metrics", "best_threshold",
    "classification_report", "confusion_counts", "coverage_error", "curve_stats",
    "diagnostic_stats", "evaluation_grid", "evaluation_totals", "hamming_loss", "hit_rate_at_k", "jaccard",
    "label_ranking_ap", "macro_curve", "match_accuracy", "matthews", "metric_bundle",
    "metrics_from_counts", "mrr_at_k", "ndcg_at_k", "precision_at_k", "problem_type",
    "rank_labels", "register_metric", "roc_auc", "sample_argmax", "sample_set_metrics", "threshold_grid",
    "threshold_table", "topk_metrics", "topk_suite", "user_metrics", "weighted_metrics",
]
