"""L-6: factories are called once for each worker process."""

import os

import pytest
from pyspark.sql import functions as F

from labelspark.operators import placement
from labelspark.operators.annotate import generate
from labelspark.operators.classify import score_with_model


def counting(folder, value):
    def factory():
        open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}-{os.urandom(4).hex()}", "w").close()
        return value
    return factory


def test_scoring_model(spark, tmp_path):
    kept, fresh = tmp_path / "kept", tmp_path / "fresh"
    kept.mkdir(), fresh.mkdir()
    model = lambda texts, labels: texts.str.len() + labels.str.len()
    pairs = spark.range(400, numPartitions=40).select(F.col("id"), F.lit("ab").alias("text"), F.lit("c").alias("label"))
    name = f"len-{tmp_path}"
    for _ in range(2):
        got = score_with_model(pairs, counting(str(kept), model), model_name=name).agg(F.sum("score"), F.count("id")).first()
        assert tuple(got) == (1200.0, 400)
    calls = [f.split("-")[0] for f in os.listdir(kept)]
    assert len(calls) == len(set(calls)) < 40
    score_with_model(pairs, counting(str(fresh), model)).agg(F.sum("score")).collect()
    assert len(os.listdir(fresh)) == 40


def test_generator_and_profile(spark, tmp_path):
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder

    prompts = spark.range(100, numPartitions=20).select("id", F.col("id").cast("string").alias("prompt"))
    got = generate(prompts, factory=counting(str(tmp_path), lambda p: "<" + p + ">"), model_name=f"gen-{tmp_path}")
    assert {r["raw"] for r in got.collect()} == {f"<{i}>" for i in range(100)}
    calls = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert len(calls) == len(set(calls))
    profile = ResourceProfileBuilder().require(ExecutorResourceRequests().cores(2).memory("4g")).build
    assert generate(prompts, lambda p: p, profile=profile).columns == ["id", "prompt", "raw"]


def test_cache(monkeypatch):
    monkeypatch.setattr(placement, "_models", placement.OrderedDict())
    made = []

    def make(x):
        made.append(x)
        return x
    for n in (0, 1, 2, 3, 0, 4, 0, 1):
        assert placement.model_of_worker(str(n), lambda n=n: make(n)) == n
    assert made == [0, 1, 2, 3, 4, 1]

    def broken():
        raise RuntimeError
    with pytest.raises(RuntimeError):
        placement.model_of_worker("broken", broken)
    assert placement.model_of_worker("broken", lambda: 5) == 5
