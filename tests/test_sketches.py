"""Stored label sketches against exact counts."""

from __future__ import annotations

from labelspark.operators import pairs as P
from labelspark.operators import sketches as K
from pyspark.sql import functions as F


def corpus(spark, start, n, spread):
    d = spark.range(start, start + n)
    label = lambda k: F.concat(F.lit("l"), F.pmod(F.col("id") * 7919 + k, F.lit(spread)).cast("string"))
    return d.select("id", F.when(F.col("id") % 10 == 0, "validation").otherwise("train").alias("split"),
                    F.array(label(0), label(1)).alias("labels"),
                    F.when(F.col("id") % 3 == 0, F.array(label(2))).otherwise(F.array().cast("array<string>")).alias("not_labels"))


def test_loads_unite_to_the_exact_counts(spark, tmp_path):
    path = str(tmp_path / "sketches")
    a, b = corpus(spark, 0, 500, 700), corpus(spark, 500, 300, 900)
    K.add_load(a, path, "a")
    K.add_load(a.limit(10), path, "b")
    K.add_load(b, path, "b")  # run again: replaces its own rows
    both = a.unionByName(b)
    want = {r["split"]: r.asDict() for r in P.dataset_statistics(both).collect()}
    got = {r["split"]: r.asDict() for r in K.sketch_statistics(K.stored(spark, path)).collect()}
    for split, row in got.items():
        assert row.pop("std_error") == 0 and row.pop("is_total") == (split is None)
        assert row == want[split]
    assert set(got) == {None, "train", "validation"}
    rows = K.stored(spark, path)
    exact = P.vocabulary_overlap(P.label_vocabulary(both.where("split = 'train'")),
                                 P.label_vocabulary(both.where("split = 'validation'"))).first()
    assert K.sketch_overlap(rows, F.col("split") == "train", F.col("split") == "validation").first() == exact


def test_error_bound(spark):
    df = corpus(spark, 0, 120_000, 90_000).repartition(7)
    for lg in (9, 12):
        rows = K.sketch_statistics(K.label_sketches(df, lg=lg), lg).collect()
        want = {r["split"]: r["n_unique_labels"] for r in P.dataset_statistics(df).collect()}
        for r in rows:
            assert 0 < abs(r["n_unique_labels"] - want[r["split"]]) <= 4 * r["std_error"]
            assert r["std_error"] <= r["n_unique_labels"] / (2 ** lg - 1) ** 0.5 * 1.0001


def test_nulls_and_empty_tables(spark):
    rows = [(None, ["a", None], None), ("x", None, ["b"]), ("x", [], []), ("x", ["b", "b"], ["c"])]
    df = spark.createDataFrame(rows, "split string, labels array<string>, not_labels array<string>")
    got = {(r["split"], r["is_total"]): tuple(r)[2:6] for r in K.sketch_statistics(K.label_sketches(df)).collect()}
    assert got == {(None, False): (1, 2, 0, 1), ("x", False): (3, 2, 2, 2), (None, True): (4, 4, 2, 3)}
    none = K.label_sketches(df.limit(0))
    assert none.count() == 0
    assert tuple(K.sketch_overlap(none, F.lit(True), F.lit(True)).first()) == (0, 0, 0, 0)
