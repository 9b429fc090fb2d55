"""E-24 with curves: every metric of every grouping set of an evaluation grid.

``pred`` is read once and collapsed to one row per distinct (cell, score) with
its positive and negative counts.  Such tables merge by adding counts, so the
table of a total is the sum of its cells' tables, and AUC, average precision and
the best threshold of every grouping set come from it without another look at
``pred``: none of the three is a function of the cells' own values.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..prefix import materialize
from .classification import metrics_from_counts
from .curve import collapse_scores, counts_from_collapsed, curve_from_collapsed
from .threshold import best_from_collapsed

CELL = "_cell"


def grouping_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets of ``dims``, the finest first."""
    return [s for n in range(len(dims), -1, -1) for s in combinations(dims, n)]


def _level(dims: Sequence[str], kept: Sequence[str]) -> int:
    """GROUPING_ID of a grouping set: a bit for every dimension summed over."""
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)


def merge_over(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]],
               keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Rows of ``df`` counted into every grouping set: ``sums`` added per
    (level, dims, keys).  A dimension summed over is NULL; ``level`` tells it
    from a NULL in the data."""
    def row(kept: Sequence[str]) -> Column:
        return F.struct(F.lit(_level(dims, kept)).cast("long").alias("level"),
                        *[(F.col(d) if d in kept else F.lit(None).cast(df.schema[d].dataType)).alias(d) for d in dims])

    wide = df.select(*keys, *sums, F.inline(F.array(*[row(s) for s in sets])))
    return wide.groupBy("level", *dims, *keys).agg(*[F.sum(c).alias(c) for c in sums])


def _unscored(score: str) -> Column:
    return F.col(score).isNull() | F.isnan(F.col(score).cast("double"))


def evaluation_totals(pred: DataFrame, dims: Sequence[str] = ("model", "dataset"), threshold: float = 0.5,
                      n: int = 100, planned: DataFrame | None = None,
                      sets: Sequence[Sequence[str]] | None = None, score: str = "score",
                      truth: str = "truth") -> DataFrame:
    """One row per cell and per total: ``level`` (0 for cells, else a bit for
    every dimension summed over), the dimensions, numbers of tasks and of those
    that succeeded with their rate, support, accuracy, precision, recall and F1
    at ``threshold``, ROC AUC, average precision, and the best of ``n`` grid
    thresholds for F1 with its F1.

    A task is a value of ``dims``; ``planned`` lists them (default: those in
    ``pred``).  A task fails if it has no pair, or a pair without a score (NULL
    or NaN); the pairs of failed tasks count in no metric, so a row of failed
    tasks only has NULL metrics.  ``sets`` are the grouping sets (default: all).
    Dimensions may be NULL; the result does not depend on the partitions.  An
    empty ``pred`` without plan gives no row, with a plan only failed tasks."""
    dims = list(dims)
    sets = [tuple(s) for s in (sets if sets is not None else grouping_sets(dims))]
    coll = collapse_scores(pred.select(*dims, F.col(score), F.col(truth)), dims, score, truth)

    done = coll.groupBy(*dims).agg((~F.max(_unscored(score))).alias("_ok"))
    if planned is None:
        tasks = done
    else:
        plan = planned.select(*[F.col(d).cast(pred.schema[d].dataType) for d in dims]).distinct()
        tasks = _on(plan, done, dims, "left")
    tasks = materialize(tasks.select(*dims, F.lit(1).alias("n_tasks"),
                                     F.coalesce("_ok", F.lit(False)).cast("long").alias("n_succeeded")))
    # cells are few: their number of each grouping set is what ends up in the report
    cells = merge_over(tasks, dims, sets, [], ["n_tasks", "n_succeeded"]).withColumn(CELL, _cell(dims))

    good = _on(coll, tasks.filter("n_succeeded = 1").drop("n_tasks", "n_succeeded"), dims, "left_semi")
    cube = merge_over(good.withColumnRenamed(score, "score"), dims, sets, ["score"], ["pos", "neg"])
    cube = materialize(cube.select(_cell(dims).alias(CELL), "score", "pos", "neg"))

    names = ["accuracy", "precision", "recall", "f1"]
    flat = metrics_from_counts(counts_from_collapsed(cube, threshold, [CELL]),
                               [CELL, "support", "num_positive", "avg_probability"], names)
    out = (cells.join(flat, CELL, "left").join(curve_from_collapsed(cube, [CELL]), CELL, "left")
           .join(best_from_collapsed(cube, "f1", n, [CELL]).withColumnRenamed("best_score", "best_f1"), CELL, "left"))
    return out.select("level", *dims, "n_tasks", "n_succeeded",
                      (F.col("n_succeeded") / F.col("n_tasks")).alias("success_rate"), "support", "num_positive",
                      "avg_probability", *names, "roc_auc", "avg_precision", "best_threshold", "best_f1")


def _cell(dims: Sequence[str]) -> Column:
    """One text per row of the report: a key that is never NULL."""
    return F.concat_ws(" ", F.col("level").cast("string"), F.to_json(F.struct(*dims)))


def _on(a: DataFrame, b: DataFrame, dims: Sequence[str], how: str) -> DataFrame:
    """Join on dimensions that may be NULL."""
    renamed = b.withColumnsRenamed({d: f"_r_{d}" for d in dims})
    same = F.lit(True)
    for d in dims:
        same = same & F.col(d).eqNullSafe(F.col(f"_r_{d}"))
    return a.join(renamed, same, how).drop(*[f"_r_{d}" for d in dims])
