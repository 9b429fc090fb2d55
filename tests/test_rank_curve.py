"""Ordinary and large samples take different paths to the same rank curve."""

from __future__ import annotations

from labelspark.operators.metrics.ranking import rank_curve
from pyspark.sql import functions as F


def plain(rows):
    groups = {}
    for k, s, score, truth in rows:
        groups.setdefault((k, s), []).append((score, truth == 1))
    return sorted(((k is None, k, s is None, s, score, *(sum(w) for w in zip(*[(x == score, x == score and t, x >= score, x >= score and t)
                                                                            for x, t in g])))
                   for (k, s), g in groups.items() for score in {x for x, _ in g}), key=str)


def test_paths_agree(spark):
    rows = [("m" if i % 3 else None, i % 7 if i % 5 else None, (i * 37 % 11) / 10, i % 2 if i % 9 else None) for i in range(300)]
    rows += [("m", 99, (i * 13 % 50) / 50, int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, sample_id long, score double, truth int").repartition(5)
    for ordinary in (0, 20, 399, 1000):
        got = rank_curve(df, ["k"], ordinary=ordinary).select(
            F.isnull("k"), "k", F.isnull("sample_id"), "sample_id", "score", "n", "pos", "n_above", "p_above").collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert rank_curve(df.limit(0), ["k"]).count() == 0
