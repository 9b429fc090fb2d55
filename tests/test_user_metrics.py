"""User metrics with mergeable states: values, keys, partitions, own metrics."""

from __future__ import annotations

import math

import pytest
from labelspark.operators import metrics as M
from pyspark.sql import functions as F

ROWS = [("a", 1, 0.9), ("a", 0, 0.2), ("a", 1, 0.55), ("b", 0, 1.0), ("b", 0, 0.0), (None, 1, 0.5), ("a", None, 0.5), ("b", 1, None)]


def widest():
    class Widest:
        """Largest distance between a score and its truth, with the number of rows:
        nothing that counts at a threshold could give."""

        def init(self):
            return 0, 0.0

        def update(self, state, truth, score):
            return state[0] + len(truth), max(state[1], float(abs(truth - score).max()))

        def merge(self, a, b):
            return a[0] + b[0], max(a[1], b[1])

        def finish(self, state):
            return state[1] + state[0] if state[0] else None

    return Widest()


def frame(spark):
    return spark.createDataFrame(ROWS, "k string, truth int, score double").withColumn("_part", F.lit("clash"))


@pytest.mark.parametrize("parts", [1, 8, 300])
def test_by_key(spark, parts):
    got = {r["k"]: r for r in M.user_metrics(frame(spark).repartition(parts), ["brier", "ece", "log_loss"], ["k"]).collect()}
    assert set(got) == {"a", "b", None}
    assert got["a"]["brier"] == pytest.approx((0.01 + 0.04 + 0.2025) / 3)
    assert got["a"]["ece"] == pytest.approx((0.1 + 0.2 + 0.45) / 3)
    assert got["a"]["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.8) + math.log(0.55)) / 3)
    assert got["b"]["brier"] == pytest.approx(0.5)
    assert got["b"]["log_loss"] == pytest.approx(-(math.log(1e-15)) / 2, rel=1e-2)


def test_own_metric_by_object_and_by_name(spark):
    df = frame(spark)
    assert M.user_metrics(df, {"widest": widest()}).first()["widest"] == 7.0
    M.register_metric("widest", widest())
    try:
        assert M.user_metrics(df, ["widest"], ["k"]).where("k = 'a'").first()["widest"] == pytest.approx(3.45)
    finally:
        M.METRICS.pop("widest")
    with pytest.raises(KeyError):
        M.user_metrics(df, ["absent"])


def test_empty(spark):
    df = frame(spark).limit(0)
    assert [tuple(r) for r in M.user_metrics(df, ["brier"]).collect()] in ([(None,)], [])
    assert M.user_metrics(df, ["brier"], ["k"]).count() == 0
