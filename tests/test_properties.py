"""Property tests: random small pred tables, Spark metrics vs brute force,
and invariance under re-partitioning."""

import numpy as np
import pytest
from helpers import pred_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from test_metrics import auc_brute, coverage_brute, lrap_brute, ndcg_brute

from labelspark.operators import metrics as M

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@st.composite
def tables(draw):
    n = draw(st.integers(2, 12))
    m = draw(st.integers(2, 6))
    levels = draw(st.integers(2, 10))
    seed = draw(st.integers(0, 10_000))
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 2, (n, m))
    t[0, 0], t[0, 1] = 1, 0  # both classes present
    s = rng.integers(0, levels, (n, m)) / levels
    return t.tolist(), s.tolist()


@SETTINGS
@given(tables(), st.integers(1, 7))
def test_metrics_match_brute_force(spark, tbl, parts):
    T, S = tbl
    p = pred_df(spark, T, S, partitions=parts)
    flat_t = [a for r in T for a in r]
    flat_s = [b for r in S for b in r]
    c = M.curve_stats(p).collect()[0]
    assert c["roc_auc"] == pytest.approx(auc_brute(flat_t, flat_s))
    k = min(3, len(T[0]))
    tk = M.topk_metrics(p, (k,)).collect()[0]
    assert tk[f"ndcg_at_{k}"] == pytest.approx(ndcg_brute(T, S, k))
    assert M.label_ranking_ap(p).collect()[0][0] == pytest.approx(lrap_brute(T, S))
    assert M.coverage_error(p).collect()[0][0] == pytest.approx(coverage_brute(T, S))
    cnt = M.confusion_counts(p, 0.5).collect()[0]
    tp = sum(1 for a, b in zip(flat_t, flat_s) if a == 1 and b > 0.5)
    assert cnt["tp"] == tp


@SETTINGS
@given(tables())
def test_best_threshold_is_grid_optimum(spark, tbl):
    T, S = tbl
    p = pred_df(spark, T, S)
    y = np.array([a for r in T for a in r])
    s = np.array([b for r in S for b in r], dtype=float)
    grid = np.linspace(s.min(), s.max(), 100)
    best, best_t = 0.0, 0.5
    for t in grid:
        pr = (s > t).astype(int)
        tp = int(((pr == 1) & (y == 1)).sum())
        den = 2 * tp + int(((pr == 1) & (y == 0)).sum()) + int(((pr == 0) & (y == 1)).sum())
        f1 = 2 * tp / den if den else 0.0
        if f1 > best:
            best, best_t = f1, t
    r = M.best_threshold(p, "f1").collect()[0]
    assert r["best_score"] == pytest.approx(best)
    assert r["best_threshold"] == pytest.approx(best_t)
