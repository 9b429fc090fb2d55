"""Generated by scripts/gen_rounding.py: DOUBLE / ARRAY<DOUBLE> output
columns per query, rounded to 6 places in the oracle SQL."""

ROUND_COLUMNS: dict[str, tuple[list[str], list[str]]] = {
    'avg_precision': (['avg_precision'], []),
    'avg_precision_macro': (['avg_precision_macro'], []),
    'basic_binary': (['accuracy', 'precision', 'recall', 'f1'], []),
    'bce_loss': (['bce_loss'], []),
    'best_metrics': (['threshold', 'accuracy', 'precision', 'recall', 'f1'], []),
    'best_metrics_multi': (['accuracy', 'precision', 'recall', 'f1'], []),
    'best_threshold_accuracy': (['best_threshold', 'best_score'], []),
    'best_threshold_f1': (['best_threshold', 'best_score'], []),
    'best_threshold_precision': (['best_threshold', 'best_score'], []),
    'best_threshold_recall': (['best_threshold', 'best_score'], []),
    'camel_clean_strings': (['draw'], []),
    'classify_with_threshold': (['top_score'], []),
    'coverage_error': (['coverage_error'], []),
    'diag_stats': (['threshold', 'avg_probability'], []),
    'eval_grid': (['avg_probability', 'accuracy', 'precision', 'recall', 'f1'], []),
    'eval_grid_full': (['accuracy', 'precision', 'recall', 'f1', 'roc_auc', 'avg_precision', 'hr_at_1', 'mrr_at_1', 'precision_at_1', 'ndcg_at_1', 'hr_at_3', 'mrr_at_3', 'precision_at_3', 'ndcg_at_3'], []),
    'eval_totals': (['success_rate', 'avg_probability', 'accuracy', 'precision', 'recall', 'f1', 'roc_auc', 'avg_precision', 'best_threshold', 'best_f1'], []),
    'evaluate_dataset': (['accuracy', 'precision', 'recall', 'f1', 'roc_auc', 'avg_precision', 'hr_at_1', 'hr_at_3', 'mrr_at_3', 'ndcg_at_3'], []),
    'external_scorer': (['score'], []),
    'hamming_loss': (['hamming_loss'], []),
    'hamming_score': (['hamming_score', 'subset_accuracy'], []),
    'hr_at_k': (['hr_at_3'], []),
    'jaccard': (['jaccard'], []),
    'jaccard_samples': (['jaccard_samples'], []),
    'l2_normalize': (['x'], []),
    'lrap': (['label_ranking_avg_precision'], []),
    'match_accuracy': (['match_accuracy'], []),
    'mcc': (['matthews_corrcoef'], []),
    'metric_bundle': (['accuracy', 'precision', 'recall', 'f1', 'jaccard', 'hamming_loss', 'matthews_corrcoef', 'roc_auc', 'avg_precision', 'threshold', 'avg_probability'], []),
    'metric_bundle_auto': (['accuracy', 'precision', 'recall', 'f1', 'match_accuracy', 'threshold', 'avg_probability'], []),
    'metric_bundle_binary': (['accuracy', 'precision', 'recall', 'f1', 'jaccard', 'hamming_loss', 'matthews_corrcoef', 'roc_auc', 'avg_precision', 'match_accuracy', 'hamming_score', 'jaccard_samples', 'coverage_error', 'label_ranking_avg_precision', 'roc_auc_macro', 'avg_precision_macro', 'jaccard_micro', 'hamming_loss_multilabel', 'threshold', 'avg_probability'], []),
    'metric_bundle_multilabel': (['accuracy', 'precision', 'recall', 'f1', 'jaccard', 'hamming_loss', 'matthews_corrcoef', 'roc_auc', 'avg_precision', 'match_accuracy', 'hamming_score', 'jaccard_samples', 'coverage_error', 'label_ranking_avg_precision', 'roc_auc_macro', 'avg_precision_macro', 'jaccard_micro', 'hamming_loss_multilabel', 'threshold', 'avg_probability'], []),
    'mrr_at_k': (['mrr_at_3'], []),
    'mrr_at_k_reference': (['mrr_at_3'], []),
    'ndcg_at_k': (['ndcg_at_3'], []),
    'nli_regrouped': ([], ['scores']),
    'nli_sigmoid': (['score'], []),
    'nli_softmax': (['score'], []),
    'pool_mean': (['x'], []),
    'pool_sep_token': (['x'], []),
    'precision_at_k': (['precision_at_3'], []),
    'repulsion_loss': (['repulsion_loss'], []),
    'results_document': (['score'], []),
    'results_roundtrip': (['accuracy', 'precision', 'recall', 'f1', 'roc_auc'], []),
    'roc_auc': (['roc_auc'], []),
    'roc_auc_macro': (['roc_auc_macro'], []),
    'score_own_labels': (['score'], []),
    'score_truth_join': (['score'], []),
    'sim_bilinear': (['score'], []),
    'sim_dot': (['score'], []),
    'suggest_labels': (['score'], []),
    'suggest_pruned': (['score'], []),
    'supcon_loss': (['supcon_loss'], []),
    'threshold_grid': (['threshold'], []),
    'topk_pruned': (['score'], []),
    'topk_suite': (['hr_at_k', 'mrr_at_k', 'precision_at_k', 'ndcg_at_k'], []),
    'total_loss': (['supcon_loss', 'repulsion_loss', 'bce_loss', 'total_loss'], []),
    'user_metrics': (['brier', 'log_loss', 'ece'], []),
    'weighted_report': (['precision', 'recall', 'f1'], []),
    'zs_flagship_scores': (['score'], []),
    'zs_softmax': (['score'], []),
    'zs_threshold_sorted': (['score'], []),
    'zs_top1': (['top_score'], []),
    'zs_topk3': (['score'], []),
}
