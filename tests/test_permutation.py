"""The keyed permutation and what is built on it."""

import pytest
from pyspark.sql import functions as F

from labelspark.functions.permute import permuted, sides, unpermuted
from labelspark.operators import permutation as P


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 97, 1000, 4999])
def test_one_to_one_and_back(spark, n):
    a, b = sides(n)
    assert a * b - a < n <= a * b
    for seed in (0, 42):
        rows = spark.range(n).select("id", permuted(F.col("id"), n, seed).alias("y"))
        rows = rows.withColumn("back", unpermuted(F.col("y"), n, seed)).collect()
        assert sorted(r["y"] for r in rows) == list(range(n))
        assert all(r["back"] == r["id"] for r in rows)


def test_large_numbers_and_outside(spark):
    n = 10**12 + 39
    ids = [0, 1, n // 2, n - 1, n, -1, None]
    df = spark.createDataFrame([(i,) for i in ids], "id long").select("id", permuted(F.col("id"), n, 7).alias("y"))
    got = {r["id"]: r["y"] for r in df.withColumn("b", unpermuted(F.col("y"), n, 7)).filter("b <=> id or y is null").collect()}
    assert all(0 <= got[i] < n for i in ids[:4]) and [got[i] for i in (n, -1, None)] == [None] * 3
    assert len({got[i] for i in ids[:4]}) == 4


def test_looks_random(spark):
    n = 5000
    y = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 3)).collect()]
    firsts = sum(1 for i in range(1000) if y[i] < n / 2)
    assert 400 < firsts < 600
    assert sum(1 for i in range(n - 1) if y[i] < y[i + 1]) in range(2300, 2700)
    assert sum(1 for i in range(n) if y[i] == i) < 15
    other = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 4)).collect()]
    assert sum(u == v for u, v in zip(y, other)) < 15


@pytest.mark.parametrize("parts", [1, 8])
def test_sample_split_slice(spark, parts):
    n = 1003
    df = spark.range(n).withColumn("_place", F.lit("clash")).repartition(parts).withColumnRenamed("id", "position")
    df = df.withColumnRenamed("_place", "other")
    order = {r["place"]: r["position"] for r in P.shuffled(df, "position").collect()}
    assert {r["position"] for r in P.sample(df, 100, "position").collect()} == {order[i] for i in range(100)}
    assert P.sample(df, 5000, "position").count() == n
    assert P.sample(df, 0, "position").count() == 0
    sizes = {r["split"]: r["count"] for r in P.split(df, {"validation": 0.1, "test": 0.05, "train": 0.85}, "position")
             .groupBy("split").count().collect()}
    assert sizes == {"validation": 100, "test": 50, "train": 853}
    got = {r["place"]: r["position"] for r in P.slice_of_order(df, 990, 50, "position").collect()}
    assert got == {i: order[i] for i in range(990, n)}
    assert P.slice_of_order(df, 2000, 5, "position").count() == 0


def test_no_exchange(spark, sf001):
    df = spark.read.parquet(f"{sf001}/embeddings.parquet")
    for out in (P.shuffled(df, "vec_id", 50), P.sample(df, 10, "vec_id", 50), P.split(df, {"a": 0.5, "b": 0.5}, "vec_id", 50)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_positions_are_checked(spark):
    with pytest.raises(ValueError):
        P.sample(spark.range(1, 10), 3, "id")
    with pytest.raises(ValueError):
        P.shuffled(spark.createDataFrame([(0,), (None,)], "id long"), "id")
    with pytest.raises(ValueError):
        P.split(spark.range(3), {"a": 0.7, "b": 0.7}, "id")
    assert P.shuffled(spark.range(0), "id").count() == 0
    words = spark.createDataFrame([("b",), ("a",), (None,)], "w string")
    assert {r["w"]: r["position"] for r in P.dense_positions(words, [("w", True)]).collect()} == {None: 0, "a": 1, "b": 2}
