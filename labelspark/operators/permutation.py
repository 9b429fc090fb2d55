"""Seeded order, exact samples and exact splits without a sort (H-5, H-7, H-9).

For tables with dense row numbers 0 .. n - 1 (``assemble_corpus`` and
``dense_positions`` give them) the seeded order is a permutation computed from
the number alone (:mod:`labelspark.functions.permute`): each function below is a
projection or a filter of one scan, with no exchange, and takes the same rows
whatever the partitions.  ``sampling`` has the forms for tables without such
numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.permute import permuted, unpermuted
from .prefix import global_row_number


def dense_positions(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "position") -> DataFrame:
    """Number the rows 0 .. n - 1 along a total ``order``, once: this is the one
    step with an exchange.  Write the result and use it for every seed."""
    return global_row_number(df, order, out="_rn").withColumn(out, F.col("_rn") - 1).drop("_rn")


def count_positions(df: DataFrame, position: str) -> int:
    """The number n of rows; raises unless the positions have no NULL, the least
    is 0 and the greatest n - 1 (that they differ is the caller's word)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(position).alias("known"), F.min(position).alias("lo"),
               F.max(position).alias("hi")).first()
    if r["n"] and (r["known"] != r["n"] or r["lo"] != 0 or r["hi"] != r["n"] - 1):
        raise ValueError(f"{position!r} does not number the rows from 0 without gaps")
    return r["n"]


def shuffled(df: DataFrame, position: str, n: int | None = None, seed: int = 42, out: str = "place") -> DataFrame:
    """H-7: the place of every row in the seeded order of the whole table, 0-based.
    ``n`` saves the count where it is known; an empty table stays empty."""
    n = count_positions(df, position) if n is None else n
    return df.withColumn(out, permuted(F.col(position), n, seed))


def sample(df: DataFrame, k: int, position: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """H-5 / H-6: exactly min(k, n) rows, the first ``k`` of the seeded order.  The
    sample of a smaller ``k`` is part of that of a larger one."""
    n = count_positions(df, position) if n is None else n
    return df if k >= n else df.filter(permuted(F.col(position), n, seed) < k)


def split(df: DataFrame, shares: dict[str, float], position: str, n: int | None = None, seed: int = 42,
          out: str = "split") -> DataFrame:
    """H-9: parts of exact size.  The parts take the places of the seeded order one
    after another, each up to floor(n * sum of the shares so far); the last one
    takes the rest."""
    if not shares or any(s < 0 for s in shares.values()) or sum(shares.values()) > 1 + 1e-9:
        raise ValueError("shares must be at least 0 and add up to at most 1")
    n = count_positions(df, position) if n is None else n
    *first, last = shares
    place, name, total = F.col("_place"), F.lit(last), 0.0
    ends = []
    for part in first:
        total += shares[part]
        ends.append((part, int(n * total + 1e-9)))
    for part, end in reversed(ends):
        name = F.when(place < end, F.lit(part)).otherwise(name)
    return df.withColumn("_place", permuted(F.col(position), n, seed)).withColumn(out, name).drop("_place")


def slice_of_order(df: DataFrame, start: int, count: int, position: str, n: int | None = None, seed: int = 42,
                   out: str = "place") -> DataFrame:
    """B-11 along the seeded order: the rows at places ``start`` .. ``start + count
    - 1``, such as one batch of an epoch.  The places are turned back into
    positions, which the table is joined to; no other row gets a place."""
    n = count_positions(df, position) if n is None else n
    stop = max(start, min(n, start + count))
    wanted = df.sparkSession.range(start, stop).select(F.col("id").alias(out))
    wanted = wanted.withColumn("_at", unpermuted(F.col(out), n, seed))
    return df.join(wanted, F.col(position) == F.col("_at")).drop("_at")
