"""One large results document: blocks, strings with brackets, part files, errors."""

from __future__ import annotations

import json

import pytest
from labelspark.sources.document import Parts, read_results_document, sample_ranges, write_results_document
from pyspark.sql import functions as F

SCORES = [[0.5, 0.25, 1e-07], [], [1.0], [[0.125], [0.75]], [0.0, -3.5]] * 7 + [[i / 8 for i in range(300)]]
TRUTHS = [[1, 0, 1], [], [0], [[1], [0]], [1, 0]] * 7 + [[i % 2 for i in range(300)]]
NOISE = ['a "quoted" [bracket', "back\\slash\\", '\\" predictions": [[1', "\\\\\\", "{[", "é]}"]


def document(**more):
    return {"texts": NOISE * 3, "other": {"predictions": [[9.0]], "true_labels": [[1]]}, "rows": [[1], [{"predictions": [2]}]],
            "detailed_results": {"texts": NOISE, "true_labels": TRUTHS, "note": {"predictions": [[7.0]]},
                                 "predictions": SCORES, "end": ["]"]},
            "metrics": {"detailed_results": {"predictions": [[8.0]]}}, **more}


def flat(x):
    return [v for y in x for v in (flat(y) if isinstance(y, list) else [y])]


@pytest.mark.parametrize("block,indent", [(7, None), (64, 2), (1000, None), (1 << 20, 2)])
def test_equals_the_whole_document(spark, tmp_path, block, indent):
    path = str(tmp_path / "results.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document(), f, indent=indent, ensure_ascii=False)
    df = read_results_document(spark, path, block, nested=True)
    got = {r[0]: (r[1], r[2]) for r in df.collect()}
    assert got == {i: (flat(s), flat(t)) for i, (s, t) in enumerate(zip(SCORES, TRUTHS))}
    if block == 64:
        assert df.rdd.getNumPartitions() > 5


def test_long_backslash_runs(spark, tmp_path):
    path = str(tmp_path / "results.json")
    for n in (3000, 3001):
        with open(path, "w") as f:
            json.dump(document(z="\\" * n + '"[' * 5), f)
        assert sum(n for _, n, _ in sample_ranges(spark, Parts.find(path), 500)) == len(SCORES)


def test_round_trip_in_parts(spark, tmp_path):
    path = str(tmp_path / "out")
    pred = spark.range(400).select((F.col("id") * 3).alias("sample_id"), F.explode(
        F.sequence(F.lit(1), F.pmod("id", F.lit(4)).cast("int") + 1)).alias("label_id"))
    pred = pred.withColumn("score", F.col("sample_id") / 7 + F.col("label_id")).withColumn(
        "truth", F.pmod(F.col("sample_id") + F.col("label_id"), F.lit(2)).cast("int")).repartition(5)
    metrics = spark.createDataFrame([(0.5, "x")], "f1 double, name string")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")  # small parts stay apart
    write_results_document(metrics, pred, path)
    spark.conf.set(coalesce, before)
    parts = sorted((tmp_path / "out").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and whole["metrics"] == {"f1": 0.5, "name": "x"} and len(whole["detailed_results"]["predictions"]) == 400
    back = read_results_document(spark, path, 2000)
    want = sorted((r.sample_id // 3, r.label_id, r.truth, r.score) for r in pred.collect())
    assert sorted(tuple(r) for r in back.select("sample_id", "label_id", "truth", "score").collect()) == want
    write_results_document(metrics, pred.limit(0), path)
    assert read_results_document(spark, path).count() == 0


@pytest.mark.parametrize("text,message", [
    ("", "empty"), ('{"detailed_results": {"predictions": [[1', "cut off"), ('{"a": {"predictions": [[1]]}}', "no detailed_results"),
    ('{"detailed_results": {"predictions": [[1], [2]], "true_labels": [[1]]}}', "2 predictions but 1")])
def test_errors(spark, tmp_path, text, message):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(ValueError, match=message):
        read_results_document(spark, str(path), 16)
