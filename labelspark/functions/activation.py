"""Activations (F-7, F-8, F-20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(c) -> Column:
    """F-7: 1 / (1 + exp(-x))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def softmax_over(df: DataFrame, keys: Sequence[str], score: str = "score",
                 out: str = "score") -> DataFrame:
    """F-8: max-shifted softmax of ``score`` across the rows of each key group
    (a sample's labels).  The max and the normaliser are partial aggregates
    joined back on the keys (AQE splits a skewed key across tasks), not a
    window that would put a whole group into one task."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.max(score).alias("_m"))
    d = df.join(m, on=keys, how="inner").withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    z = d.groupBy(*keys).agg(F.sum("_e").alias("_z"))
    return (d.join(z, on=keys, how="inner").withColumn(out, F.col("_e") / F.col("_z"))
            .drop("_m", "_e", "_z"))


def array_softmax(c) -> Column:
    """Softmax inside one array value (per-row, no shuffle)."""
    a = _c(c)
    m = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / tot)


def nli_pair_score(logits, mode: str, entail_index: int = 0) -> Column:
    """F-20 per pair: 'sigmoid' mode takes the softmax across the classes of
    one pair at the entailment column; one-column logits use a plain sigmoid.
    'softmax' mode returns the raw entailment logit, to be normalised across
    the sample's labels with :func:`softmax_over`."""
    a = _c(logits)
    single = F.size(a) == 1
    ent = F.element_at(a, entail_index + 1)
    if mode == "sigmoid":
        per_class = F.element_at(array_softmax(a), entail_index + 1)
        return F.when(single, sigmoid(F.element_at(a, 1))).otherwise(per_class)
    if mode == "softmax":
        return F.when(single, F.element_at(a, 1)).otherwise(ent)
    raise ValueError(f"unknown activation mode {mode!r}")
