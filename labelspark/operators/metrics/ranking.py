"""Per-sample ranking metrics (E-11, E-12, E-17 .. E-21, G-1).

Labels are ranked inside each sample by ``score`` descending, ties broken by
``label_id`` descending (what a stable ascending argsort taken from the end
gives).  Top-k work keeps only the first ``k`` rows of each sample, cut inside
each map task before the shuffle, so the per-sample ranking never needs a
whole (possibly huge) sample in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..prefix import materialize, running_sums, top_k_per_group

DEFAULT_KS = (1, 3, 5, 10)
ORDINARY = 1 << 16  # labels of a sample that one window may hold


def rank_order(score: str = "score", label: str = "label_id") -> list[Column]:
    return [F.col(score).desc(), F.col(label).desc()]


def rank_labels(pred: DataFrame, k: int, keys: Sequence[str] = (),
                sample: str = "sample_id", label: str = "label_id",
                score: str = "score", with_ties: bool = False) -> DataFrame:
    """G-1: the top-k labels of each sample with ``rank`` 1..k."""
    return top_k_per_group(
        pred, list(keys) + [sample], rank_order(score, label), k,
        tie_order=[F.col(score).desc()] if with_ties else None)


def _idcg_table(k: int) -> Column:
    """IDCG of binary truth with m positives, m = 0..k, as a literal array."""
    vals, acc = [0.0], 0.0
    for i in range(1, k + 1):
        acc += 1.0 / math.log2(i + 1)
        vals.append(acc)
    return F.array(*[F.lit(v) for v in vals])


def _discount(pos: Column, k: int) -> Column:
    return F.when(pos <= k, F.lit(1.0) / F.log2(pos.cast("double") + 1)).otherwise(F.lit(0.0))


def per_sample_topk(pred: DataFrame, ks: Sequence[int], keys: Sequence[str] = (),
                    sample: str = "sample_id", label: str = "label_id",
                    score: str = "score", truth: str = "truth") -> DataFrame:
    """Per sample and for every k: hit, best / worst true position within k,
    hits within k and tie-averaged DCG@k, plus the sample's #labels and
    #positives.

    The counts are a partial aggregate; the ranked rows are those tied with or
    above the k-th, cut to them in the map tasks.  Both meet on the sample."""
    keys = list(keys)
    kmax = max(ks)
    grp = keys + [sample]
    counts = pred.groupBy(*grp).agg(F.count(F.lit(1)).alias("n_labels"),
                                    F.sum(F.col(truth).cast("long")).alias("n_pos"))
    top = top_k_per_group(pred.select(*grp, label, score, truth), grp, rank_order(score, label), kmax,
                          tie_order=[F.col(score).desc()])
    peers = Window.partitionBy(*grp).orderBy(F.col(score).desc()).rangeBetween(0, 0)
    top = top.withColumn("_gain", F.avg(F.col(truth).cast("double")).over(peers))
    pos, yy = F.col("rank"), F.col(truth) == 1
    aggs = []
    for k in ks:
        inside = pos <= k
        aggs += [
            F.count_if(inside & yy).alias(f"hits_{k}"),
            F.min(F.when(inside & yy, pos)).alias(f"best_{k}"),
            F.max(F.when(inside & yy, pos)).alias(f"worst_{k}"),
            F.sum(F.col("_gain") * _discount(pos, k)).alias(f"dcg_{k}"),
        ]
    best = top.groupBy(*grp).agg(*aggs)
    if not keys:
        return best.join(counts, sample)
    same = F.lit(True)
    for c in grp:  # a key may be NULL
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}"))
    return best.alias("b").join(counts.alias("c"), same).select("b.*", "c.n_labels", "c.n_pos")


def topk_from_samples(per: DataFrame, ks: Sequence[int], keys: Sequence[str] = (),
                      mrr_mode: str = "standard", more: Sequence[Column] = ()) -> DataFrame:
    """Average the per-sample top-k stats into HR / MRR / P / NDCG @k (and the
    aggregates ``more``)."""
    idcg = _idcg_table(max(ks))
    has_pos = F.col("n_pos") > 0
    aggs = []
    for k in ks:
        if mrr_mode == "standard":
            rr = F.when(F.col(f"best_{k}").isNotNull(), F.lit(1.0) / F.col(f"best_{k}"))
        elif mrr_mode == "reference":
            rr = F.when(F.col(f"worst_{k}").isNotNull(),
                        F.lit(1.0) / (F.lit(k + 1) - F.col(f"worst_{k}")))
        else:
            raise ValueError(f"unknown mrr_mode {mrr_mode!r}")
        ideal = F.element_at(idcg, F.least(F.col("n_pos"), F.lit(k)).cast("int") + 1)
        aggs += [
            F.avg((F.col(f"hits_{k}") > 0).cast("double")).alias(f"hr_at_{k}"),
            F.avg(F.coalesce(rr, F.lit(0.0))).alias(f"mrr_at_{k}"),
            F.coalesce(F.avg(F.when(has_pos, F.col(f"hits_{k}") / F.lit(float(k)))),
                       F.lit(0.0)).alias(f"precision_at_{k}"),
            F.avg(F.when(ideal > 0, F.col(f"dcg_{k}") / ideal).otherwise(F.lit(0.0)))
            .alias(f"ndcg_at_{k}"),
        ]
    return per.groupBy(*keys).agg(*aggs, *more)


def topk_metrics(pred: DataFrame, ks: Sequence[int] = DEFAULT_KS, keys: Sequence[str] = (),
                 mrr_mode: str = "standard", sample: str = "sample_id",
                 label: str = "label_id", score: str = "score",
                 truth: str = "truth") -> DataFrame:
    """E-17 .. E-20 for all ``ks`` in one ranked pass (wide, one row per key)."""
    per = per_sample_topk(pred, ks, keys, sample, label, score, truth)
    return topk_from_samples(per, ks, keys, mrr_mode)


def hit_rate_at_k(pred: DataFrame, k: int, keys: Sequence[str] = (), **kw) -> DataFrame:
    """E-17."""
    return topk_metrics(pred, (k,), keys, **kw).select(*keys, f"hr_at_{k}")


def mrr_at_k(pred: DataFrame, k: int, keys: Sequence[str] = (), mode: str = "standard",
             **kw) -> DataFrame:
    """E-18: ``standard`` = 1 / best rank; ``reference`` = 1/(k+1-p) with p the
    largest position of a true label inside the top k."""
    return topk_metrics(pred, (k,), keys, mrr_mode=mode, **kw).select(*keys, f"mrr_at_{k}")


def precision_at_k(pred: DataFrame, k: int, keys: Sequence[str] = (), **kw) -> DataFrame:
    """E-19: hits / k over samples that have a true label (none -> 0.0)."""
    return topk_metrics(pred, (k,), keys, **kw).select(*keys, f"precision_at_{k}")


def ndcg_at_k(pred: DataFrame, k: int, keys: Sequence[str] = (), **kw) -> DataFrame:
    """E-20: NDCG@k with tie-averaged gains; zero ideal DCG -> 0."""
    return topk_metrics(pred, (k,), keys, **kw).select(*keys, f"ndcg_at_{k}")


def topk_suite(pred: DataFrame, ks: Sequence[int] = DEFAULT_KS, keys: Sequence[str] = (),
               mrr_mode: str = "standard", sample: str = "sample_id",
               label: str = "label_id", score: str = "score",
               truth: str = "truth") -> DataFrame:
    """E-21 in long form ``(keys, k, hr_at_k, mrr_at_k, precision_at_k, ndcg_at_k)``.

    As the reference: only samples with the label count of the first sample
    (smallest ``sample``) take part, only ``k`` up to that count, and only when
    it is above one.
    """
    keys = list(keys)
    per = per_sample_topk(pred, ks, keys, sample, label, score, truth)
    # one row per (key, label count), then the one with the first sample
    wide = topk_from_samples(per, ks, [*keys, "n_labels"], mrr_mode, [F.min(sample).alias("_first")])
    cols = [F.col(c) for c in wide.columns if c not in keys]
    wide = wide.groupBy(*keys).agg(F.min_by(F.struct(*cols), "_first").alias("w")).select(*keys, "w.*")
    wide = wide.withColumnRenamed("n_labels", "n_first").where("n_first is not null")
    rows = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"hr_at_{k}").alias("hr_at_k"),
                 F.col(f"mrr_at_{k}").alias("mrr_at_k"),
                 F.col(f"precision_at_{k}").alias("precision_at_k"),
                 F.col(f"ndcg_at_{k}").alias("ndcg_at_k"))
        for k in ks])
    out = wide.select(*keys, "n_first", F.inline(rows))
    return out.filter((F.col("k") <= F.col("n_first")) & (F.col("n_first") > 1)).drop("n_first")


def rank_curve(pred: DataFrame, keys: Sequence[str] = (), sample: str = "sample_id",
               score: str = "score", truth: str = "truth", ordinary: int = ORDINARY) -> DataFrame:
    """Per (sample, distinct score): labels and true labels at this score
    (``n``, ``pos``) and at or above it (``n_above``, ``p_above``).

    The pairs are written once and the labels of each sample counted.  Samples
    of at most ``ordinary`` labels take one hash exchange on the sample, after
    which collapsing and running sums need no other.  Larger ones, if there are
    any, are collapsed per distinct score and summed by a distributed prefix
    sum along the score, so that no task holds such a sample.  Both give the
    same rows.  A null truth counts as not true."""
    by = [*keys, sample]
    y = F.coalesce(F.col(truth) == 1, F.lit(False)).cast("long")
    rows = materialize(pred.select(*by, score, y.alias("_y")))
    large = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > ordinary))

    def collapsed(df: DataFrame) -> DataFrame:
        return df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))

    def windowed(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
        return collapsed(df.repartition(*by)).select("*", F.sum("n").over(w).alias("n_above"), F.sum("pos").over(w).alias("p_above"))

    if large.isEmpty():
        return windowed(rows)
    same = [rows[c].eqNullSafe(large[c]) for c in by]
    spread = running_sums(collapsed(rows.join(large, same, "left_semi")), by, [(score, False)],
                          {"n_above": F.col("n"), "p_above": F.col("pos")}, inclusive=True, materialized=True)
    few = windowed(rows.join(large, same, "left_anti"))
    return few.unionByName(spread.select(*few.columns))


def ranking_summary(pred: DataFrame, keys: Sequence[str] = (), sample: str = "sample_id",
                    score: str = "score", truth: str = "truth") -> DataFrame:
    """E-11 and E-12 from one rank curve: coverage error and LRAP per key."""
    keys = list(keys)
    rc = rank_curve(pred, keys, sample, score, truth)
    per = rc.groupBy(*keys, sample).agg(
        F.coalesce(F.max(F.when(F.col("pos") > 0, F.col("n_above"))), F.lit(0)).alias("_cov"),
        F.sum(F.col("pos") * F.col("p_above") / F.col("n_above")).alias("_s"),
        F.sum("pos").alias("_np"), F.sum("n").alias("_n"))
    trivial = (F.col("_np") == 0) | (F.col("_np") == F.col("_n"))
    return per.groupBy(*keys).agg(
        F.avg(F.col("_cov").cast("double")).alias("coverage_error"),
        F.avg(F.when(trivial, F.lit(1.0)).otherwise(F.col("_s") / F.col("_np")))
        .alias("label_ranking_avg_precision"))


def coverage_error(pred: DataFrame, keys: Sequence[str] = (), sample: str = "sample_id",
                   score: str = "score", truth: str = "truth") -> DataFrame:
    """E-11: per sample #{labels with score >= lowest true score}; 0 when the
    sample has no true label; mean over samples."""
    keys = list(keys)
    rc = rank_curve(pred, keys, sample, score, truth)
    per = rc.groupBy(*keys, sample).agg(
        F.coalesce(F.max(F.when(F.col("pos") > 0, F.col("n_above"))), F.lit(0)).alias("_cov"))
    return per.groupBy(*keys).agg(F.avg(F.col("_cov").cast("double")).alias("coverage_error"))


def label_ranking_ap(pred: DataFrame, keys: Sequence[str] = (), sample: str = "sample_id",
                     score: str = "score", truth: str = "truth") -> DataFrame:
    """E-12: LRAP.  For every true label j: #{true l: s_l >= s_j} /
    #{l: s_l >= s_j} (ties count as ranked above); mean per sample; samples
    with no or only true labels score 1; mean over samples."""
    keys = list(keys)
    rc = rank_curve(pred, keys, sample, score, truth)
    per = rc.groupBy(*keys, sample).agg(
        F.sum(F.col("pos") * F.col("p_above") / F.col("n_above")).alias("_s"),
        F.sum("pos").alias("_np"), F.sum("n").alias("_n"))
    trivial = (F.col("_np") == 0) | (F.col("_np") == F.col("_n"))
    return per.groupBy(*keys).agg(
        F.avg(F.when(trivial, F.lit(1.0)).otherwise(F.col("_s") / F.col("_np")))
        .alias("label_ranking_avg_precision"))
