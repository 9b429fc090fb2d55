"""E-30 / E-31 / D-11 from stored sketches: label counts of corpora that grow.

A theta sketch of a split's labels is a few kilobytes whatever the split holds.
Written once per load, sketches are united over loads and splits without
reading the data again, and they intersect, so vocabulary overlaps come from
them too.  With ``2^lg`` entries a count is exact up to ``2^lg`` labels; beyond
that its relative standard error is at most ``1 / sqrt(2^lg - 1)`` (1.6 % at
the default of 12), that of an intersection relative to the union's size.
The exact forms are in :mod:`.pairs`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG = 12


def label_sketches(df: DataFrame, split: str = "split", labels: str = "labels", not_labels: str | None = "not_labels",
                   lg: int = LG) -> DataFrame:
    """One row per split (null is a split of its own): ``n_samples``,
    ``n_positives``, ``n_with_negatives`` and ``sketch`` of the distinct labels
    of both lists.  Null lists and null labels count nothing."""
    neg = F.col(not_labels) if not_labels and not_labels in df.columns else F.lit(None).cast("array<string>")
    empty = F.array().cast("array<string>")
    rows = df.select(F.col(split).alias("split"), F.coalesce(F.col(labels), empty).alias("_p"), F.coalesce(neg, empty).alias("_n"))
    # one scan: the first exploded row of a sample stands for it in the counts
    each = rows.select("split", F.size("_p").alias("_np"), (F.size("_n") > 0).alias("_hn"),
                       F.posexplode_outer(F.concat("_p", "_n")).alias("_i", "_l"))
    first = F.coalesce("_i", F.lit(0)) == 0
    return each.groupBy("split").agg(
        F.count_if(first).alias("n_samples"), F.sum(F.when(first, F.col("_np")).otherwise(0)).cast("long").alias("n_positives"),
        F.count_if(first & F.col("_hn")).alias("n_with_negatives"), F.theta_sketch_agg("_l", lg).alias("sketch"))


def add_load(df: DataFrame, path: str, load: str, **kw) -> None:
    """Store the sketches of one load beside those of earlier ones; a load that
    runs again replaces its own rows and no others."""
    label_sketches(df, **kw).write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={load}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows, with the name of their ``load``."""
    return spark.read.option("recursiveFileLookup", "false").parquet(path)


def sketch_statistics(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """E-31 of any stored rows, per split and in all (``is_total``): counts added, sketches united,
    with the standard error that the count of labels may have."""
    g = sketches.rollup("split").agg(
        F.grouping("split").cast("boolean").alias("is_total"),
        *[F.sum(c).alias(c) for c in ("n_samples", "n_positives", "n_with_negatives")],
        F.theta_sketch_estimate(F.theta_union_agg("sketch", lg)).alias("n_unique_labels"))
    exact = F.col("n_unique_labels") <= 2 ** lg
    error = F.when(exact, 0.0).otherwise(F.col("n_unique_labels") / math.sqrt(2 ** lg - 1))
    return g.withColumn("std_error", error)


def sketch_overlap(sketches: DataFrame, first: Column, second: Column, lg: int = LG) -> DataFrame:
    """D-11 from stored rows: sizes of the vocabularies that the conditions
    ``first`` and ``second`` pick, of their intersection and of their union
    (one row; a side without rows has size 0)."""
    a, b = (F.theta_union_agg(F.when(c, F.col("sketch")), lg) for c in (first, second))
    u = sketches.agg(a.alias("_a"), b.alias("_b"))
    return u.select(F.theta_sketch_estimate("_a").alias("n_first"), F.theta_sketch_estimate("_b").alias("n_second"),
                    F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("n_overlap"),
                    F.theta_sketch_estimate(F.theta_union("_a", "_b", lg)).alias("n_union"))
