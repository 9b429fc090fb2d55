"""Edge paths: error handling, column choice, ordering rules and loss guards."""

import math

import pytest
from pyspark.sql import functions as F

from labelspark.operators import losses as L
from labelspark.operators import normalize as N
from labelspark.operators.classify import predictions
from labelspark.sources.readers import load_validated


def test_load_validated_empty_on_error(spark):
    def broken():
        return spark.createDataFrame([(1,)], "x long")  # no canonical columns
    out = load_validated(spark, broken, on_error="empty")
    assert out.count() == 0 and out.columns == ["sample_id", "text", "ltext", "lint"]
    with pytest.raises(Exception):
        load_validated(spark, broken)


def test_choose_text_column(spark):
    a = spark.createDataFrame([("x", "y")], "sentence string, other string")
    b = spark.createDataFrame([("x", "y")], "text string, sentence string")
    assert N.choose_text_column(a) == "sentence"
    assert N.choose_text_column(b) == "text"
    assert N.choose_text_column(b, "sentence") == "sentence"


def test_predictions_keep_input_order_without_threshold(spark):
    d = spark.createDataFrame([(1, 2, "b", 0.9), (1, 1, "a", 0.1), (1, 3, "c", 0.5)],
                              "sample_id long, label_id int, label string, score double")
    plain = predictions(d).collect()[0].predictions
    assert [p.label for p in plain] == ["a", "b", "c"]
    thr = predictions(d, threshold=0.5).collect()[0].predictions
    assert [p.label for p in thr] == ["b", "c"]  # >= threshold, score descending


def test_total_loss_zeroes_non_finite_parts(spark):
    sup = spark.createDataFrame([(float("nan"),)], "supcon_loss double")
    rep = spark.createDataFrame([(0.5,)], "repulsion_loss double")
    bce = spark.createDataFrame([(float("inf"),)], "bce_loss double")
    r = L.total_loss(sup, rep, bce).collect()[0]
    assert r.total_loss == pytest.approx(0.05)


def test_bce_scaled_and_unscaled(spark):
    d = spark.createDataFrame([(2.0, 1), (-1.0, 0), (float("inf"), 1)], "logit double, truth int")

    def bce(z, y):
        return max(z, 0) - z * y + math.log1p(math.exp(-abs(z)))
    s = math.exp(2.0)
    want_scaled = (bce(2.0 / s, 1) + bce(-1.0 / s, 0)) / 2
    want_raw = (bce(2.0, 1) + bce(-1.0, 0)) / 2
    assert L.bce_loss(d).collect()[0][0] == pytest.approx(want_scaled)
    assert L.bce_loss(d, scaled=False).collect()[0][0] == pytest.approx(want_raw)


def test_limit_labels_underscore_probability_bounds(spark):
    d = spark.range(0, 50).select(F.col("id").alias("sample_id"),
                                  F.array(F.lit("a_b"), F.lit("c_d")).alias("ltext"),
                                  F.array(F.lit(1), F.lit(0)).alias("lint"))
    always = N.limit_labels(d, 5, shuffle=False, remove_underscores=1.0).collect()
    never = N.limit_labels(d, 5, shuffle=False, remove_underscores=0.0).collect()
    assert all(r.ltext == ["a b", "c d"] for r in always)
    assert all(r.ltext == ["a_b", "c_d"] for r in never)


def test_vector_functions_match_numpy(spark):
    import numpy as np

    from labelspark.functions import vector as V
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=6), rng.normal(size=6)
    d = spark.createDataFrame([(a.tolist(), b.tolist(), [0.0] * 6)], "a array<double>, b array<double>, z array<double>")
    r = d.select(V.dot("a", "b").alias("dot"),
                 V.l2_normalize("a").alias("unit"), V.l2_normalize("z").alias("zero")).collect()[0]
    assert r.dot == pytest.approx(a @ b)
    assert r.unit == pytest.approx((a / np.linalg.norm(a)).tolist())
    assert r.zero == [0.0] * 6
