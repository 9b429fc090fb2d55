"""Deterministic sampling, shuffles, splits, slices and unions (H-5 .. H-9,
I-1, B-10, B-11).

Every random choice is a hash of the row id and a seed
(:mod:`labelspark.functions.rand`), so results are identical for any
partitioning and across task retries.  Exact-size operations rank rows by
that hash with the distributed prefix sum instead of a global sort into one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash_key, hash_uniform
from .prefix import global_row_number, materialize

KEY = "_hk"


def hash_order_key(id_col: str, seed: int) -> Column:
    """60-bit integer from md5(id | seed): the seeded shuffle order."""
    return F.conv(F.substring(hash_key(F.col(id_col), F.lit(seed)), 1, 15), 16, 10).cast("long")


def shuffled_positions(df: DataFrame, id_col: str, seed: int = 42,
                       out: str = "position") -> DataFrame:
    """H-7: global seeded shuffle, as a 1-based position per row."""
    k = df.withColumn(KEY, hash_order_key(id_col, seed))
    return global_row_number(k, [(KEY, True), (id_col, True)], out=out).drop(KEY)


def sample_exact(df: DataFrame, n: int, id_col: str, seed: int = 42,
                 oversample: float = 1.25) -> DataFrame:
    """H-5 / H-6: all rows if there are at most ``n``, else exactly the ``n``
    rows first in the seeded hash order.

    A cheap hash pre-filter keeps ~``oversample * n`` candidates, written once
    to the shared folder and counted (the full table is used when the filter
    fell short); only the candidates are ranked.
    """
    total = df.count()
    if total <= n:
        return df
    frac = min(1.0, oversample * n / total + 64.0 / total)
    k = df.withColumn(KEY, hash_order_key(id_col, seed))
    # the candidates (~oversample * n rows) are written once: counting,
    # quantiles and ranking then read the small table, not the input again
    cand = materialize(k.filter(F.col(KEY) < F.lit(int(frac * (1 << 60)))))
    if cand.count() < n:
        cand = k
    ranked = global_row_number(cand, [(KEY, True), (id_col, True)], out="_rn")
    return ranked.filter(F.col("_rn") <= n).drop("_rn", KEY)


def split_train_validation(df: DataFrame, id_col: str, test_size: float = 0.1,
                           seed: int = 42, out: str = "split") -> DataFrame:
    """H-9: disjoint, exhaustive hash split ('validation' when the row's
    uniform draw is below ``test_size``); stream-safe and partition-free."""
    u = hash_uniform(F.col(id_col), F.lit(seed), F.lit("split"))
    return df.withColumn(out, F.when(u < F.lit(float(test_size)), F.lit("validation"))
                         .otherwise(F.lit("train")))


def row_slice(df: DataFrame, order: Sequence[tuple[str, bool]], start: int,
              count: int | None = None) -> DataFrame:
    """B-11: rows ``[start, start + count)`` along ``order`` (0-based)."""
    r = global_row_number(df, order, out="_rn")
    cond = F.col("_rn") > start
    if count is not None:
        cond = cond & (F.col("_rn") <= start + count)
    return r.filter(cond).drop("_rn")


def min_length(df: DataFrame, text: str = "text", n: int = 100) -> DataFrame:
    """B-10: keep texts of at least ``n`` characters (pushes to the scan as a
    post-scan filter; parquet cannot prune on length)."""
    return df.filter(F.length(F.col(text)) >= n)


def union_capped(parts: dict[str, DataFrame], id_col: str, cap: int | None = None,
                 seed: int = 42, base: str | None = None) -> DataFrame:
    """I-1: union sources by name, each except ``base`` capped at ``cap`` rows
    by :func:`sample_exact`; a ``source`` column tags every row."""
    out = None
    for name, df in parts.items():
        d = df if (cap is None or name == base) else sample_exact(df, cap, id_col, seed)
        d = d.withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def assemble_corpus(base: DataFrame, extras: dict[str, DataFrame], id_col: str, name: str = "base",
                    test_size: float = 0.1, cap: int | None = None, seed: int = 42) -> DataFrame:
    """J-14: the training corpus itself.  ``base`` is split (H-9), the extra
    corpora, at most ``cap`` rows each, join the training part only, and all
    rows get a ``sample_id`` in one seeded global order (ids of different
    corpora may be equal: a row is told by ``source`` and its own id)."""
    out = split_train_validation(base.withColumn("source", F.lit(name)), id_col, test_size, seed)
    if extras:
        more = union_capped(extras, id_col, cap, seed).withColumn("split", F.lit("train"))
        out = out.unionByName(more, allowMissingColumns=True)
    key = F.conv(F.substring(hash_key(F.col("source"), F.col(id_col), F.lit(seed)), 1, 15), 16, 10).cast("long")
    ordered = global_row_number(out.withColumn(KEY, key), [(KEY, True), ("source", True), (id_col, True)], out="_n")
    return ordered.withColumn("sample_id", F.col("_n") - 1).drop("_n", KEY)
