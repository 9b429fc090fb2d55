"""E-24 totals against metrics of the pooled pairs."""

import math

import pytest
from pyspark.sql import functions as F

from labelspark.operators import metrics as M

SCHEMA = "model string, dataset string, sample_id long, label_id int, truth int, score double"


def frame(spark):
    rows = [(m, d, i, j, (i * 7 + j * 3 + len(m or "")) % 3 == 0, ((i * 37 + j * 11 + len(d) * 5) % 17) / 16)
            for m in ("a", "bb", None) for d in ("x", "yy") for i in range(12) for j in range(3)]
    rows = [(m, d, i, j, int(t), s) for m, d, i, j, t, s in rows]
    rows.append(("bb", "bad", 1, 1, 1, None))
    rows.append(("bb", "bad", 1, 2, 0, 0.25))
    rows.append(("a", "nan", 1, 1, 1, math.nan))
    return spark.createDataFrame(rows, SCHEMA)


def test_totals_are_those_of_pooled_pairs(spark):
    df = frame(spark).repartition(37)
    plan = spark.createDataFrame([("a", "x"), ("a", "yy"), ("a", "nan"), ("bb", "x"), ("bb", "yy"), ("bb", "bad"),
                                  (None, "x"), (None, "yy"), ("a", "absent"), ("a", "x")], "model string, dataset string")
    got = {(r["level"], r["model"], r["dataset"]): r for r in M.evaluation_totals(df, planned=plan).collect()}
    pooled = {(3, None, None): "true", (1, "a", None): "model = 'a'", (1, None, None): "model is null",
              (2, None, "yy"): "dataset = 'yy'", (0, "bb", "x"): "model = 'bb' and dataset = 'x'"}
    good = df.filter("dataset in ('x', 'yy')").select("*", F.explode(F.filter(F.array(*[
        F.when(F.expr(c), F.lit(i)) for i, c in enumerate(pooled.values())]), lambda x: x.isNotNull())).alias("pool"))
    want = {}
    for part in (M.basic_metrics(good, 0.5, ["pool"]), M.curve_stats(good, ["pool"]),
                 M.best_threshold(good, keys=["pool"]), good.groupBy("pool").agg(F.count("score").alias("support"))):
        for r in part.withColumnRenamed("best_score", "best_f1").collect():
            want.setdefault(r["pool"], {}).update(r.asDict())
    for i, key in enumerate(pooled):
        for name in ("support", "accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision", "best_threshold", "best_f1"):
            assert got[key][name] == pytest.approx(want[i][name]), (key, name)
    assert (got[3, None, None]["n_tasks"], got[3, None, None]["n_succeeded"]) == (9, 6)
    assert got[3, None, None]["success_rate"] == pytest.approx(6 / 9)
    assert (got[1, "a", None]["n_tasks"], got[1, "a", None]["n_succeeded"]) == (4, 2)
    for failed in ((0, "bb", "bad"), (0, "a", "nan"), (0, "a", "absent")):
        assert got[failed]["n_succeeded"] == 0 and got[failed]["roc_auc"] is None and got[failed]["f1"] is None
    assert len(got) == 9 + 3 + 5 + 1


def test_without_plan_and_empty(spark):
    df = frame(spark)
    rows = M.evaluation_totals(df, ["dataset"], sets=[("dataset",), ()]).collect()
    assert {(r["dataset"], r["n_succeeded"]) for r in rows} == {("x", 1), ("yy", 1), ("bad", 0), ("nan", 0), (None, 2)}
    empty = df.filter(F.lit(False))
    assert M.evaluation_totals(empty).count() == 0
    plan = df.select("model", "dataset").distinct()
    assert M.evaluation_totals(empty, planned=plan).agg(F.sum("n_succeeded")).first()[0] == 0
