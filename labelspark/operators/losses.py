"""Training losses as aggregations over scored pairs (E-26 .. E-29)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import l2_normalize

# Default loss weights and constants of the reference model.
SUPCON_WEIGHT = 1.0
REPULSION_WEIGHT = 0.1
BCE_WEIGHT = 1.0
REPULSION_THRESHOLD = 0.3
LOGIT_SCALE_INIT = 2.0
BCE_SCALE_INIT = 1.0


def _finite(c):
    return F.isnotnull(c) & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def bce_loss(pairs: DataFrame, keys: Sequence[str] = (), logit: str = "logit",
             truth: str = "truth", scale: float = LOGIT_SCALE_INIT,
             bce_scale: float = BCE_SCALE_INIT, scaled: bool = True) -> DataFrame:
    """E-26: mean BCE-with-logits over finite pairs.  The main logit is divided
    by exp(clamp(scale, -10, 10)) (``scaled=False`` skips that, for heads that
    never multiplied by it) and multiplied by clamp(|bce_scale|, 0.1, 10)."""
    div = max(math.exp(min(max(scale, -10.0), 10.0)), 1e-6) if scaled else 1.0
    mult = min(max(abs(bce_scale), 0.1), 10.0)
    z = F.col(logit).cast("double") / F.lit(div) * F.lit(mult)
    y = F.col(truth).cast("double")
    term = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return (pairs.filter(_finite(F.col(logit).cast("double")))
            .groupBy(*keys).agg(F.coalesce(F.avg(term), F.lit(0.0)).alias("bce_loss")))


def supcon_loss(pairs: DataFrame, keys: Sequence[str] = (), sample: str = "sample_id",
                logit: str = "logit", truth: str = "truth") -> DataFrame:
    """E-27: per sample with at least one positive, minus the mean over its
    positives of the log-softmax across the sample's labels; mean over such
    samples (0 when there are none)."""
    keys = list(keys)
    x = F.col(logit).cast("double")
    m = pairs.groupBy(*keys, sample).agg(F.max(x).alias("_m"))
    p = pairs.join(m, on=keys + [sample], how="inner")
    per = p.groupBy(*keys, sample).agg(
        F.first("_m").alias("_m"),
        F.sum(F.exp(x - F.col("_m"))).alias("_se"),
        F.sum(F.when(F.col(truth) == 1, x)).alias("_sp"),
        F.count_if(F.col(truth) == 1).alias("_np"))
    lse = F.col("_m") + F.log(F.col("_se"))
    loss = -(F.col("_sp") - F.col("_np") * lse) / F.col("_np")
    return (per.groupBy(*keys)
            .agg(F.coalesce(F.avg(F.when(F.col("_np") > 0, loss)), F.lit(0.0))
                 .alias("supcon_loss")))


def _tile_sums(keys: list, tau: float, schema):
    """Arrow batches of rows sorted by tile -> one row per tile with the sum of
    its pairs.  One tile and one batch are held at a time."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def one(t: pa.Table) -> float:
        u = t["_u"].combine_chunks()
        u = u.flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1)
        ids = t["_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        w = t["_w"].to_numpy().astype(float)
        side = t["_b"].to_numpy()
        cross = t["_i"][0].as_py() != t["_j"][0].as_py()
        low = side == t["_i"][0].as_py()  # either block may have no rows: the sum is 0
        a, b = (low, ~low) if cross else (slice(None), slice(None))
        part = np.maximum(u[a] @ u[b].T - tau, 0.0)
        part[ids[a][:, None] == ids[b][None, :]] = 0.0
        return float(w[a] @ part @ w[b]) * (2.0 if cross else 1.0)

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cells = held["_cell"].to_pandas().to_numpy()
            starts = np.r_[0, np.flatnonzero(cells[1:] != cells[:-1]) + 1] if len(cells) else []
            if len(starts) > 1:
                yield rows(held, starts[:-1], starts[1:])
                held = held.slice(starts[-1])
        if held is not None and len(held):
            yield rows(held, [0], [len(held)])

    def rows(t: pa.Table, starts, ends) -> pa.RecordBatch:
        sums = [one(t.slice(s, e - s)) for s, e in zip(starts, ends)]
        cols = [t[f"_k{n}"].combine_chunks().take(pa.array(starts)) for n in range(len(keys))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(sums, pa.float64())], schema=out)

    return run


def repulsion_loss(label_vectors: DataFrame, keys: Sequence[str] = (),
                   sample: str = "sample_id", label: str = "label_id", vec: str = "vec",
                   tau: float = REPULSION_THRESHOLD, block: int = 1024) -> DataFrame:
    """E-28 / D-8: mean over ordered pairs of different labels of the same sample
    of relu(cos - tau); 0 where there is no pair.

    Equal rows count once, with a weight.  A sample of more than ``block`` of them
    is cut into blocks by hash, and every pair of blocks is one tile: a matrix
    product in a task of its own.  No pair rows are written and no task holds more
    than a tile.  Rows without a label make no pair; a vector that is NULL or holds
    NULL adds 0 but its pairs count.  The vectors of a sample have one length."""
    from pyspark.sql import types as T

    keys = list(keys)
    rows = label_vectors.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(sample).alias("_s"),
                                F.col(label).alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
    group = [f"_k{n}" for n in range(len(keys))]
    rows = rows.filter(F.col("_id").isNotNull()).groupBy(*group, "_s", "_id", "_v").agg(F.count(F.lit(1)).alias("_w"))

    # pairs of different labels: all ordered pairs of the sample less those of one label
    per_label = rows.groupBy(*group, "_s", "_id").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_rows"))
    sizes = per_label.groupBy(*group, "_s").agg(
        (F.sum("_w") * F.sum("_w") - F.sum(F.col("_w") * F.col("_w"))).alias("_n"),
        F.ceil(F.sum("_rows") / F.lit(float(block))).cast("int").alias("_tiles"))
    pairs = sizes.groupBy(*group).agg(F.sum("_n").alias("_n"))

    whole = F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull()) & (F.size("_v") > 0)
    named = sizes.select("_tiles", *[F.col(c).alias(f"_r{c}") for c in [*group, "_s"]])
    same = F.lit(True)
    for c in [*group, "_s"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    units = rows.filter(whole).join(named, same).select(
        *group, "_s", "_id", "_w", "_tiles", l2_normalize(F.col("_v")).alias("_u"),
        F.pmod(F.xxhash64("_id", "_v"), F.col("_tiles")).cast("int").alias("_b"))
    tiles = units.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).select(
        *group, "_id", "_w", "_u", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"),
        F.to_json(F.struct(*group, "_s", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))).alias("_cell"))
    schema = T.StructType([*[tiles.schema[c] for c in group], T.StructField("_sum", T.DoubleType())])
    sums = (tiles.repartition("_cell").sortWithinPartitions("_cell")
            .mapInArrow(_tile_sums(keys, float(tau), schema), schema)
            .groupBy(*group).agg(F.sum("_sum").alias("_sum")))

    value = F.when(F.col("_n") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("_n")).otherwise(F.lit(0.0))
    if not keys:
        return pairs.crossJoin(sums).select(value.alias("repulsion_loss"))
    sums = sums.withColumnsRenamed({c: f"_r{c}" for c in group})
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return pairs.join(sums, same, "left").select(*[F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)],
                                                 value.alias("repulsion_loss"))


def total_loss(supcon: DataFrame, repulsion: DataFrame, bce: DataFrame,
               keys: Sequence[str] = (), w_supcon: float = SUPCON_WEIGHT,
               w_repulsion: float = REPULSION_WEIGHT, w_bce: float = BCE_WEIGHT) -> DataFrame:
    """E-29: weighted sum; a NaN / infinite part counts as 0."""
    keys = list(keys)

    def j(a, b):
        return a.join(b, on=keys, how="inner") if keys else a.crossJoin(b)

    def clean(c):
        return F.when(_finite(F.col(c)), F.col(c)).otherwise(F.lit(0.0))

    t = j(j(supcon, repulsion), bce)
    return t.select(*keys, "supcon_loss", "repulsion_loss", "bce_loss",
                    (clean("supcon_loss") * w_supcon + clean("repulsion_loss") * w_repulsion
                     + clean("bce_loss") * w_bce).alias("total_loss"))
