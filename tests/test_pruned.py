"""Pruned label search against the full product; bounded scoring."""

from __future__ import annotations

import numpy as np
import pytest
from labelspark.operators.classify import score_pairs, suggest_labels, top_predictions
from labelspark.operators.pruned import PivotIndex, find_labels
from pyspark.sql import functions as F


def clustered(n, dim, clusters, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, dim))


def sides(spark, n_texts=150, n_labels=120, dim=6):
    texts = [(i, "t", [float(x) for x in v]) for i, v in enumerate(clustered(n_texts, dim, 8, 1))]
    labels = [(i + 1, f"l{i}", [float(x) for x in v]) for i, v in enumerate(clustered(n_labels, dim, 8, 2))]
    labels += [(901, "copy", labels[4][2]), (902, "copy2", labels[4][2]), (903, "zero", [0.0] * dim)]
    t = spark.createDataFrame(texts, "sample_id long, rank string, text_vec array<double>").drop("rank")
    return t, spark.createDataFrame(labels, "label_id int, label string, label_vec array<double>")


@pytest.mark.parametrize("head", ["cosine", "dot", "bilinear"])
@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_equals_the_full_product(spark, head, shard_rows):
    t, lab = sides(spark)
    more = {"dot": {"weights": [0.5, -1.0, 2.0, 1.0, 0.0, 1.0], "bias": 0.3},
            "bilinear": {"matrix": [[((i * 6 + j) % 5 - 2.0) / 20 for j in range(6)] for i in range(6)]}}.get(head, {})
    full = score_pairs(t, lab, head=head, **more).withColumn("score", F.round("score", 9)).withColumn("logit", F.round("logit", 9))
    tops = top_predictions(full, k=4, score="logit")
    got = find_labels(t, lab, k=4, head=head, shard_rows=shard_rows, **more)

    def rows(df):
        return sorted((r["sample_id"], r["rank"], r["label_id"]) for r in df.collect())

    assert rows(got) == rows(tops)
    over = full.where("score > 0.7").select("sample_id", "label_id")
    some = find_labels(t, lab, threshold=0.7, head=head, shard_rows=shard_rows, **more).select("sample_id", "label_id")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, over.collect()))
    both = find_labels(t, lab, k=3, threshold=0.7, head=head, shard_rows=shard_rows, **more)
    assert rows(both) == rows(suggest_labels(full.withColumn("score", F.round("score", 9)), 3, 0.7))


def test_blocks_are_skipped():
    labels = clustered(2000, 8, 40, 3)
    labels /= np.linalg.norm(labels, axis=1, keepdims=True)
    x = labels[::20] + 0.001
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, s, compared = PivotIndex(labels, True).search(x, 5, -np.inf)
    assert compared.sum() < 0.2 * len(x) * len(labels)
    product = x @ labels.T
    assert np.allclose(s.reshape(len(x), 5), -np.sort(-product, axis=1)[:, :5])


def test_null_vectors_and_empty_sides(spark):
    t, lab = sides(spark, 3, 5)
    odd = spark.createDataFrame([(7, None), (8, [1.0]), (9, [float("nan")] * 6), (10, [None] * 6)], "sample_id long, text_vec array<double>")
    assert {r["sample_id"] for r in find_labels(t.unionByName(odd), lab, k=2).collect()} == {0, 1, 2}
    assert find_labels(t, lab.limit(0), k=2).count() == 0
    assert find_labels(t.limit(0), lab, k=2, shard_rows=2).count() == 0
    with pytest.raises(ValueError):
        find_labels(t, lab)


def test_scoring_holds_few_pairs_at_a_time(spark):
    """Texts times labels is more than a worker could hold as one batch."""
    t = spark.range(5000).select(F.col("id").alias("sample_id"), F.array(*[F.sin(F.col("id") + k) for k in range(4)]).alias("text_vec"))
    lab = spark.range(4096).select(F.col("id").cast("int").alias("label_id"), F.array(*[F.cos(F.col("id") * (k + 1)) for k in range(4)]).alias("label_vec"))
    got = score_pairs(t.coalesce(1), lab).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored")).first()
    assert (got["n"], got["scored"]) == (5000 * 4096, 5000 * 4096)
