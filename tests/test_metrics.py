"""Hand-computed metric cases and brute-force cross-checks of the tie-sensitive metrics."""

import math

import numpy as np
import pytest
from helpers import pred_df

from labelspark.operators import metrics as M


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_sample_sets(spark):
    # predicted {0,2}, {1,2}, {} against {0,1}, {1,2,3}, {0}: 1/3, 2/3 and 0
    p = pred_df(spark, [[1, 1, 0, 0], [0, 1, 1, 1], [1, 0, 0, 0]],
                [[.9, .2, .6, .1], [.1, .7, .8, .3], [.2, .1, .1, .4]])
    r = one(M.sample_set_metrics(p, 0.5))
    assert r["hamming_score"] == pytest.approx(1 / 3)
    assert r["jaccard_samples"] == pytest.approx(1 / 3)


def test_sample_sets_both_empty(spark):
    # the first sample is a match for one score and nothing for the other
    p = pred_df(spark, [[0, 0], [1, 1], [0, 1]], [[.2, .1], [.9, .4], [.6, .3]])
    r = one(M.sample_set_metrics(p, 0.5))
    assert r["hamming_score"] == pytest.approx((1 + 1 / 2 + 0) / 3)
    assert r["jaccard_samples"] == pytest.approx((0 + 1 / 2 + 0) / 3)


def test_hit_rate_top1(spark):
    p = pred_df(spark, [[0, 0, 1], [1, 0, 0], [0, 1, 0]], [[.3, .5, .7], [.4, .6, .1], [.2, .9, .8]])
    assert one(M.hit_rate_at_k(p, 1))["hr_at_1"] == pytest.approx(2 / 3)


def test_precision_at_k_no_truth(spark):
    p = pred_df(spark, [[0, 0, 0], [0, 0, 0]], [[.6, .5, .9], [.3, .2, .7]])
    assert one(M.precision_at_k(p, 2))["precision_at_2"] == 0.0


def test_diagnostic_stats(spark):
    p = pred_df(spark, [[1, 0, 1], [0, 0, 1]], [[.9, .3, .6], [.2, .4, .5]])
    r = one(M.diagnostic_stats(p, 0.35))
    assert (r["support"], r["num_positive"], r["threshold"]) == (6, 3, 0.35)
    assert r["avg_probability"] == pytest.approx(2.9 / 6)


def test_threshold_search_f1(spark):
    p = pred_df(spark, [[1], [1], [0], [0], [1], [0]], [[.75], [.55], [.45], [.15], [.65], [.35]])
    r = one(M.best_threshold(p, "f1"))
    assert r["best_score"] == pytest.approx(1.0)
    assert 0.45 <= r["best_threshold"] <= 0.55


def test_threshold_search_one_error(spark):
    # the 0 at .7 lies above the 1 at .6: one of five is wrong at any threshold
    p = pred_df(spark, [[1], [0], [1], [0], [0]], [[.9], [.7], [.6], [.4], [.1]])
    assert one(M.best_threshold(p, "accuracy"))["best_score"] == pytest.approx(0.8)


def test_threshold_default_when_nothing_scores(spark):
    p = pred_df(spark, [[0], [0], [0]], [[.4], [.3], [.15]])
    r = one(M.best_threshold(p, "f1"))
    assert (r["best_threshold"], r["best_score"]) == (0.5, 0.0)


def test_random_bounds(spark):
    rng = np.random.default_rng(42)
    t = rng.integers(0, 2, (10, 3))
    s = rng.random((10, 3))
    p = pred_df(spark, t.tolist(), s.tolist())
    r = one(M.metric_bundle(p, 0.5))
    for k, v in r.items():
        if k in ("support", "num_positive", "threshold") or v is None:
            continue
        if k == "matthews_corrcoef":
            assert -1.0 <= v <= 1.0
        else:
            assert 0.0 <= v <= 1.0, k


def test_threshold_monotonic(spark):
    rng = np.random.default_rng(1)
    p = pred_df(spark, rng.integers(0, 2, (20, 4)).tolist(), rng.random((20, 4)).tolist())
    pos = [one(M.confusion_counts(p, t)) for t in (0.2, 0.5, 0.8)]
    n = [r["tp"] + r["fp"] for r in pos]
    assert n[0] >= n[1] >= n[2]


def test_mrr_reference_mode_is_inverted(spark):
    # truth at rank 1 / 2 / 3 with k = 3
    for rank, want in ((1, 1 / 3), (2, 1 / 2), (3, 1.0)):
        scores = [.9, .8, .7, .1]
        truth = [0, 0, 0, 0]
        truth[rank - 1] = 1
        p = pred_df(spark, [truth], [scores])
        assert one(M.mrr_at_k(p, 3, mode="reference"))["mrr_at_3"] == pytest.approx(want)
        assert one(M.mrr_at_k(p, 3))["mrr_at_3"] == pytest.approx(1 / rank)


# ---------------------------------------------------------------- brute force
def auc_brute(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def ap_brute(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for thr in order:
        tp = sum(1 for a, b in zip(y, s) if b >= thr and a == 1)
        n = sum(1 for b in s if b >= thr)
        r = tp / P
        ap += (r - prev_r) * tp / n
        prev_r = r
    return ap


def ndcg_brute(T, S, k):
    out = []
    disc = [1 / math.log2(i + 2) if i < k else 0.0 for i in range(len(T[0]))]
    for t, s in zip(T, S):
        vals = sorted(set(s), reverse=True)
        pos, dcg = 0, 0.0
        for v in vals:
            grp = [a for a, b in zip(t, s) if b == v]
            dcg += (sum(grp) / len(grp)) * sum(disc[pos:pos + len(grp)])
            pos += len(grp)
        ideal = sum(d * g for d, g in zip(disc, sorted(t, reverse=True)))
        out.append(dcg / ideal if ideal > 0 else 0.0)
    return float(np.mean(out))


def lrap_brute(T, S):
    out = []
    for t, s in zip(T, S):
        rel = [i for i, a in enumerate(t) if a == 1]
        if not rel or len(rel) == len(t):
            out.append(1.0)
            continue
        acc = 0.0
        for j in rel:
            above = [i for i in range(len(t)) if s[i] >= s[j]]
            acc += sum(t[i] for i in above) / len(above)
        out.append(acc / len(rel))
    return float(np.mean(out))


def coverage_brute(T, S):
    out = []
    for t, s in zip(T, S):
        tr = [b for a, b in zip(t, s) if a == 1]
        out.append(0 if not tr else sum(1 for b in s if b >= min(tr)))
    return float(np.mean(out))


@pytest.mark.parametrize("seed", [3, 4])
def test_curve_and_ranking_vs_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    T = rng.integers(0, 2, (30, 6)).tolist()
    S = (rng.integers(0, 8, (30, 6)) / 8.0).tolist()  # many ties
    p = pred_df(spark, T, S, partitions=5)
    flat_t = [a for r in T for a in r]
    flat_s = [b for r in S for b in r]
    c = one(M.curve_stats(p))
    assert c["roc_auc"] == pytest.approx(auc_brute(flat_t, flat_s))
    assert c["avg_precision"] == pytest.approx(ap_brute(flat_t, flat_s))
    tk = one(M.topk_metrics(p, (1, 3, 5)))
    for k in (1, 3, 5):
        assert tk[f"ndcg_at_{k}"] == pytest.approx(ndcg_brute(T, S, k))
    assert one(M.label_ranking_ap(p))["label_ranking_avg_precision"] == pytest.approx(lrap_brute(T, S))
    assert one(M.coverage_error(p))["coverage_error"] == pytest.approx(coverage_brute(T, S))


def test_weighted_report(spark):
    # true classes 1,1,2,3 ; predicted 1,2,2,3
    T = [[1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]]
    S = [[.9, .1, 0], [.2, .7, .1], [.1, .8, .1], [0, .2, .9]]
    p = pred_df(spark, T, S)
    rep = {r["class"]: r for r in M.classification_report(M.sample_argmax(p)).collect()}
    assert rep["1"]["precision"] == 1.0 and rep["1"]["recall"] == 0.5
    assert rep["2"]["precision"] == 0.5 and rep["2"]["recall"] == 1.0
    w = rep["weighted avg"]
    assert w["recall"] == pytest.approx(0.75) and w["support"] == 4
