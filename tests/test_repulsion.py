"""E-28 by tiles against the plain double loop."""

import time

import numpy as np
import pytest

from labelspark.operators.losses import repulsion_loss

SCHEMA = "k string, sample_id long, label_id int, vec array<double>"


def plain(rows, tau):
    total, n = 0.0, 0
    unit = [None if v is None or None in v else np.array(v) / max(np.linalg.norm(v), 1e-12) for *_, v in rows]
    for (_, s, a, _), u in zip(rows, unit):
        for (_, t, b, _), v in zip(rows, unit):
            if s == t and a is not None and b is not None and a != b:
                n += 1
                total += 0.0 if u is None or v is None else max(float(u @ v) - tau, 0.0)
    return total / n if n else 0.0


@pytest.mark.parametrize("block", [1024, 3])
def test_plain_version(spark, block):
    rng = np.random.default_rng(5)
    rows = [(k, s, l % 7, rng.normal(size=4).tolist()) for k in ("a", None) for s in (1, 2, None) for l in range(9)]
    rows += [rows[0], rows[0], ("a", 1, None, [1.0, 0.0, 0.0, 0.0]), ("a", 1, 3, None), ("a", 2, 4, [1.0, None, 0.0, 0.0]),
             ("alone", 9, 1, [1.0, 2.0, 3.0, 4.0])]
    got = {r["k"]: r["repulsion_loss"] for r in
           repulsion_loss(spark.createDataFrame(rows, SCHEMA), ["k"], tau=0.1, block=block).collect()}
    assert got == {k: pytest.approx(plain([r for r in rows if r[0] == k], 0.1)) for k in ("a", None, "alone")}


def test_five_thousand_labels_in_one_sample(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(5000, 16))
    df = spark.createDataFrame([("a", 1, i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    start = time.time()
    got = repulsion_loss(df).first()[0]
    assert time.time() - start < 60
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    g = np.maximum(u @ u.T - 0.3, 0)
    np.fill_diagonal(g, 0)
    assert got == pytest.approx(g.sum() / (5000 * 4999))


def test_empty(spark):
    assert repulsion_loss(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0
