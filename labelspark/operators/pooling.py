"""Vector pooling (E-25, G-4) and label centroids.

Means are one aggregate with a vector buffer per group (``Summarizer``),
combined map-side: a hot group (one label holding a third of all vectors)
sends one vector per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_pool(vectors: DataFrame, group: Sequence[str], vec: str = "vec",
              out: str = "vec") -> DataFrame:
    """Average the vectors of each group element-wise; empty groups vanish."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    group = list(group)
    v = array_to_vector(F.col(vec).cast("array<double>"))
    present = vectors.where(F.col(vec).isNotNull())
    return (present.groupBy(*group).agg(Summarizer.mean(v).alias("_m"))
            .select(*group, vector_to_array("_m").alias(out)))


def pool_tokens(tokens: DataFrame, sample: str = "sample_id", lmask: str = "lmask",
                vec: str = "vec") -> DataFrame:
    """E-25: mean of the token vectors of each (sample, label id); tokens with
    label id 0 are text tokens and are skipped."""
    t = tokens.filter(F.col(lmask) > 0).withColumnRenamed(lmask, "label_id")
    return mean_pool(t, [sample, "label_id"], vec, "vec")


def separator_vectors(tokens: DataFrame, sample: str = "sample_id", pos: str = "pos",
                      is_sep: str = "is_sep", vec: str = "vec") -> DataFrame:
    """G-4: in separator-token mode a label's vector is the vector at its
    separator token; labels are numbered 1.. in position order per sample."""
    w = Window.partitionBy(sample).orderBy(pos)
    seps = tokens.filter(F.col(is_sep))
    return seps.select(sample, F.row_number().over(w).cast("int").alias("label_id"),
                       F.col(vec).cast("array<double>").alias("vec"))


def centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label (the label embedding of the flagship scorer)."""
    return mean_pool(vectors, [label], vec, "centroid")
