"""Scale-safe ordered computations (G-3, G-5) and per-group top-k (G-1).

Never an un-partitioned ``Window.orderBy`` over raw rows: that plans an
``Exchange SinglePartition`` and sends the whole table through one task.

* :func:`running_sums` is a two-level prefix sum.  Rows are cut into ranges of
  the whole ordering (bounds from one bounded random sample), summed locally
  inside each ``(keys, range)`` window partition, and shifted by the exclusive
  running total of the range totals (a table of ``#keys x #ranges`` rows).  A
  hot key is spread over all ranges, and so is an ordering whose first column
  has few values; ordering columns of any type may be NULL.
* :func:`top_k_per_group` is a rank filter: Spark keeps the best ``k`` rows of
  every group inside each map task (a window group limit) before the shuffle,
  so a group with a third of all rows sends ``k`` rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bkt"


def _n_buckets(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, parts)


def _before(a: Sequence[Column], b: Sequence[Column], ascending: Sequence[bool]) -> Column:
    """Does tuple ``a`` sort before tuple ``b``?  NULL sorts first in an
    ascending column and last in a descending one, like Spark's own sorts."""
    out, same = F.lit(False), F.lit(True)
    for x, y, up in zip(a, b, ascending):
        lo, hi = (x, y) if up else (y, x)
        out = out | (same & ((lo.isNull() & hi.isNotNull()) | F.coalesce(lo < hi, F.lit(False))))
        same = same & x.eqNullSafe(y)
    return out


def order_bounds(df: DataFrame, order: Sequence[tuple[str, bool]], n_buckets: int) -> DataFrame:
    """One row with the array of up to ``n_buckets - 1`` cut points (structs of
    the ordering columns) of a uniform sample of 16 rows per bucket.  Whatever
    the sample, the result of a prefix sum is the same."""
    cols = [F.col(c).alias(f"o{i}") for i, (c, _) in enumerate(order)]
    schema = df.select(F.array(F.struct(*cols)).alias("_bounds")).schema
    sorting = [F.col(f"o{i}").asc() if up else F.col(f"o{i}").desc() for i, (_, up) in enumerate(order)]
    sample = df.select(*cols).orderBy(F.rand(17)).limit(16 * n_buckets).orderBy(*sorting).collect()
    cuts = sorted({i * len(sample) // n_buckets for i in range(1, n_buckets)}) if sample else []
    return df.sparkSession.createDataFrame([([tuple(sample[i]) for i in cuts],)], schema)


def with_range(df: DataFrame, order: Sequence[tuple[str, bool]], n_buckets: int) -> DataFrame:
    """Add ``_bkt``: the number of cut points before the row, found by binary
    search in a broadcast one-row table; equal rows always share a range."""
    up = [a for _, a in order]
    row = [F.col(c) for c, _ in order]
    steps = [1 << k for k in range(max(1, n_buckets).bit_length(), -1, -1)]

    def step(at: Column, width: Column) -> Column:
        b = F.get("_bounds", at + width - 1)
        far = (at + width <= F.size("_bounds")) & _before([b[f"o{i}"] for i in range(len(order))], row, up)
        return F.when(far, at + width).otherwise(at)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
    return (df.crossJoin(F.broadcast(order_bounds(df, order, n_buckets)))
            .withColumn(BUCKET, found).drop("_bounds"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a parquet table into the shared
    ``spark.checkpoint.dir`` folder and reading it back (never a local
    checkpoint).  The data is computed once and survives executor loss, and
    unlike an RDD checkpoint the re-read keeps file statistics (AQE can size
    joins) and column pruning."""
    import uuid

    from ..session import scratch_path
    path = scratch_path(df.sparkSession, f"tables/{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]],
                 values: dict[str, Column], inclusive: bool = True,
                 n_buckets: int | None = None, materialized: bool = False) -> DataFrame:
    """Add running sums of ``values`` along ``order`` within ``keys``.

    ``order`` is a list of ``(column, ascending)``; it should be a total order
    inside each key group (ties in the whole ordering make ROWS frames
    arbitrary, exactly like a plain window).  Output columns are named after
    the keys of ``values``; ``inclusive=False`` gives the exclusive sum.
    ``materialized=True`` writes the input to the shared folder first, for inputs that are
    expensive to recompute (the sample and the sums both read it).
    """
    keys = list(keys)
    if materialized:
        df = materialize(df)
    dfb = with_range(df, order, _n_buckets(df, n_buckets))
    tmp = {name: f"_v_{name}" for name in values}
    for name, expr in values.items():
        dfb = dfb.withColumn(tmp[name], expr)

    ordering = [F.col(c).asc() if a else F.col(c).desc() for c, a in order]
    end = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy(*keys, BUCKET).orderBy(*ordering)
               .rowsBetween(Window.unboundedPreceding, end))
    local = dfb
    for name in values:
        local = local.withColumn(f"_l_{name}",
                                 F.coalesce(F.sum(tmp[name]).over(w_local), F.lit(0)))

    totals = dfb.groupBy(*keys, BUCKET).agg(
        *[F.sum(tmp[name]).alias(f"_t_{name}") for name in values])
    w_off = (Window.partitionBy(*keys).orderBy(BUCKET)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BUCKET).alias("_k_bkt"),
        *[F.coalesce(F.sum(f"_t_{name}").over(w_off), F.lit(0)).alias(f"_o_{name}")
          for name in values])
    same = F.col(BUCKET) == F.col("_k_bkt")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(offsets, same)
    for name in values:
        out = out.withColumn(name, F.col(f"_l_{name}") + F.col(f"_o_{name}"))
    drop = [BUCKET, "_k_bkt", *[f"_k_{k}" for k in keys]] + [c for n in values for c in (tmp[n], f"_l_{n}", f"_o_{n}")]
    return out.drop(*drop)


def global_row_number(df: DataFrame, order: Sequence[tuple[str, bool]],
                      keys: Sequence[str] = (), out: str = "rn",
                      n_buckets: int | None = None) -> DataFrame:
    """1-based position of each row along ``order`` (G-3), distributed."""
    return running_sums(df, keys, order, {out: F.lit(1)}, True, n_buckets)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    tie_order: Sequence[Column] | None = None, rank_col: str = "rank") -> DataFrame:
    """Keep the top ``k`` rows of each key group by ``order`` and number them.

    With ``tie_order`` (e.g. the score alone) every row whose ``rank()`` along
    ``tie_order`` is at most ``k`` is kept, so a tie group straddling the k-th
    place stays whole.  ``rank_col`` is the 1-based ``row_number`` along
    ``order`` inside the group in both cases.
    """
    keys = list(keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if tie_order is None:
        return df.withColumn(rank_col, number).filter(F.col(rank_col) <= k)
    r = F.rank().over(Window.partitionBy(*keys).orderBy(*tie_order))
    return df.withColumn("_r", r).filter(F.col("_r") <= k).drop("_r").withColumn(rank_col, number)
