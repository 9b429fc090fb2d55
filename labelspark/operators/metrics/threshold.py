"""Threshold search (E-22, E-23, F-18).

One pass over ``pred`` regardless of the grid size: it is collapsed to one
row per distinct score (written once to the shared folder); the score range and a histogram of
bins (#grid thresholds strictly below each score) come from that table, and
everything after works on at most ``n + 1`` bins per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classification import metrics_from_counts
from .curve import collapse_scores, counts_from_collapsed

METRICS = ("f1", "accuracy", "precision", "recall")
#: A metric of one's own: a Column of the counts tp, fp, fn, tn.
Metric = Callable[[Column, Column, Column, Column], Column]


def grid_value(i: Column, lo: Column, hi: Column, n: int) -> Column:
    """F-18: the i-th of ``n`` evenly spaced values from lo to hi, computed
    as i * step + lo with the last value pinned to hi."""
    step = (hi - lo) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    return F.when(i == n - 1, hi).otherwise(i.cast("double") * step + lo)


def threshold_grid(lo: Column, hi: Column, n: int) -> Column:
    """F-18 as an array column."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: grid_value(i, lo, hi, n))


def _bin(score: Column, lo: Column, hi: Column, n: int) -> Column:
    """#{i : score > t_i}: an estimate from the step, corrected exactly by
    comparing with the grid values next to it."""
    if n == 1:
        return F.when(score > lo, F.lit(1)).otherwise(F.lit(0))
    step = (hi - lo) / F.lit(float(n - 1))
    j0 = F.least(F.greatest(F.floor((score - lo) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    base = F.greatest(j0 - 1, F.lit(0))
    checks = []
    for d in (-1, 0, 1):
        j = j0 + d
        ok = (j >= 0) & (j <= n - 1) & (score > grid_value(j, lo, hi, n))
        checks.append(F.when(ok, F.lit(1)).otherwise(F.lit(0)))
    exact = base + checks[0] + checks[1] + checks[2]
    # for j0 = 0 the -1 candidate is invalid and base is 0: exact as well
    return F.when(step == 0, F.lit(0)).otherwise(exact).cast("int")


def threshold_table(pred: DataFrame, n: int = 100, keys: Sequence[str] = (),
                    score: str = "score", truth: str = "truth",
                    collapsed: DataFrame | None = None) -> DataFrame:
    """For each key and grid index i: threshold t_i and the confusion counts
    of ``score > t_i``.  Works on the collapsed score table (one pass over
    ``pred``), then on at most ``n + 1`` bins per key."""
    keys = list(keys)
    coll = collapsed if collapsed is not None else collapse_scores(pred, keys, score, truth)
    rng = coll.groupBy(*keys).agg(F.min(score).cast("double").alias("lo"),
                                  F.max(score).cast("double").alias("hi"))
    j = (coll.join(rng, on=keys, how="inner") if keys
         else coll.crossJoin(F.broadcast(rng)))
    b = _bin(F.col(score).cast("double"), F.col("lo"), F.col("hi"), n)
    hist = j.groupBy(*keys, b.alias("bin")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    grid = (rng.select(*keys, "lo", "hi",
                       F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")))
    # predicted positives at t_i are the rows whose bin exceeds i
    w = Window.partitionBy(*keys).orderBy(F.col("bin").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    suffix = hist.select(*keys, (F.col("bin") - 1).alias("i"),
                         F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"))
    tot = hist.groupBy(*keys).agg(F.sum("p").alias("tot_p"), F.sum("q").alias("tot_q"))
    # bins are sparse: take the nearest populated bin above i (suffix sums
    # only shrink with i, so a running max over larger i finds it)
    g = grid.join(suffix, on=keys + ["i"], how="left")
    w_fill = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    g = g.select(*keys, "i", "lo", "hi",
                 F.coalesce(F.max("tp").over(w_fill), F.lit(0)).alias("tp"),
                 F.coalesce(F.max("fp").over(w_fill), F.lit(0)).alias("fp"))
    g = g.join(tot, on=keys, how="inner") if keys else g.crossJoin(tot)
    return g.select(
        *keys, "i", grid_value(F.col("i"), F.col("lo"), F.col("hi"), n).alias("threshold"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        (F.col("tot_p") - F.col("tp")).cast("long").alias("fn"),
        (F.col("tot_q") - F.col("fp")).cast("long").alias("tn"))


def _best(t: DataFrame, metric: str | Metric, keys: list) -> DataFrame:
    if callable(metric):
        m = t.withColumn("_own", metric(*[F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")]))
        metric = "_own"
    else:
        m = metrics_from_counts(t, keys + ["i", "threshold", "tp", "fp", "fn", "tn"], (metric,))
    return m.groupBy(*keys).agg(
        F.max_by(F.struct("i", "threshold", "tp", "fp", "fn", "tn"),
                 F.struct(F.col(metric), -F.col("i"))).alias("w"),
        F.max(metric).alias("best_score"))


def best_threshold(pred: DataFrame, metric: str | Metric = "f1", n: int = 100,
                   keys: Sequence[str] = (), score: str = "score",
                   truth: str = "truth") -> DataFrame:
    """E-22: the grid threshold with the highest metric, earliest on ties;
    (0.5, 0.0) when no threshold scores above zero.  ``metric`` is a name or a
    function of the counts (L-5)."""
    if not callable(metric) and metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return best_from_collapsed(collapse_scores(pred, keys, score, truth), metric, n, keys, score)


def best_from_collapsed(coll: DataFrame, metric: str | Metric = "f1", n: int = 100,
                        keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """E-22 from a collapsed score table."""
    keys = list(keys)
    best = _best(threshold_table(coll, n, keys, score, collapsed=coll), metric, keys)
    found = F.col("best_score") > 0
    return best.select(
        *keys,
        F.when(found, F.col("w.threshold")).otherwise(F.lit(0.5)).alias("best_threshold"),
        F.when(found, F.col("best_score")).otherwise(F.lit(0.0)).alias("best_score"))


def best_metrics(pred: DataFrame, n: int = 100, keys: Sequence[str] = (),
                 score: str = "score", truth: str = "truth") -> DataFrame:
    """E-23: accuracy / precision / recall / F1 at the F1-best threshold.  The
    winning grid row already carries its counts; only the fallback threshold
    0.5 (no threshold scored above zero) needs counts of its own, taken from
    the collapsed table."""
    keys = list(keys)
    coll = collapse_scores(pred, keys, score, truth)
    best = _best(threshold_table(pred, n, keys, score, truth, collapsed=coll), "f1", keys)
    at_half = counts_from_collapsed(coll, 0.5, keys, score).select(
        *keys, *[F.col(c).alias(f"h_{c}") for c in ("tp", "fp", "fn", "tn")])
    j = best.join(at_half, on=keys, how="inner") if keys else best.crossJoin(at_half)
    found = F.col("best_score") > 0
    pick = [F.when(found, F.col(f"w.{c}")).otherwise(F.col(f"h_{c}")).alias(c)
            for c in ("tp", "fp", "fn", "tn")]
    c = j.select(*keys, F.when(found, F.col("w.threshold")).otherwise(F.lit(0.5))
                 .alias("threshold"), *pick)
    return metrics_from_counts(c, keys + ["threshold"])
