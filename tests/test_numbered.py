"""Numbered batch files: names, sizes, lost attempts, resuming."""

from __future__ import annotations

import json
import os

import pytest
from labelspark.sources.numbered import ATTEMPTS, NumberedWriter, existing, read_numbered, write_numbered
from pyspark.sql import Row
from pyspark.sql import functions as F


def contents(path):
    return {n: json.load(open(p, encoding="utf-8")) for n, p in sorted(existing(path).items())}


def test_names_sizes_and_order(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(123).select(F.col("id"), F.concat(F.lit("é"), "id").alias("t"), F.array("id").alias("a")).repartition(5)
    write_numbered(df, path, "id", 50)
    got = contents(path)
    assert sorted(os.listdir(path)) == ["batch_0001.json", "batch_0002.json", "batch_0003.json"]
    assert [len(v) for v in got.values()] == [50, 50, 23]
    assert [r["id"] for v in got.values() for r in v] == list(range(123))
    assert got[1][0] == {"id": 0, "t": "é0", "a": [0]}
    back = read_numbered(spark, path, df.schema)
    assert sorted((r["batch"], r["id"]) for r in back.collect()) == [(i // 50 + 1, i) for i in range(123)]
    write_numbered(df.where("id < 10"), path, "id", 50)  # overwrites
    assert [len(v) for v in contents(path).values()] == [10]


def test_start_index_and_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).withColumn("v", F.lit("first"))
    write_numbered(df.where("id < 40"), path, "id", 20)
    os.remove(existing(path)[1])
    write_numbered(df.withColumn("v", F.lit("second")), path, "id", 20, resume=True)
    assert {n: {r["v"] for r in v} for n, v in contents(path).items()} == {
        1: {"second"}, 2: {"first"}, 3: {"second"}, 4: {"second"}, 5: {"second"}}
    other = str(tmp_path / "later")
    write_numbered(df, other, "id", 50, start_index=500_000)
    assert sorted(os.listdir(other)) == ["batch_10001.json", "batch_10002.json"]


def test_attempts_that_fail_leave_nothing(tmp_path):
    path = str(tmp_path / "out")
    writer = NumberedWriter(path, "n", True)

    def rows(broken):
        for i in range(6):
            if broken and i == 5:
                raise RuntimeError("lost")
            yield Row(n=i // 2 + 1, x=i)

    with pytest.raises(RuntimeError):
        writer.write(rows(True))
    assert existing(path) == {}
    twice = writer.write(rows(False))  # an attempt that finished but does not count
    writer.commit([writer.write(rows(False)), None])
    assert twice.files and sorted(os.listdir(path)) == ["batch_0001.json", "batch_0002.json", "batch_0003.json"]
    assert [len(v) for v in contents(path).values()] == [2, 2, 2]
    writer.write(rows(False))
    writer.abort([])
    assert not os.path.exists(f"{path}/{ATTEMPTS}") and len(existing(path)) == 3
