"""Corpora as configuration, loading with quarantine, the table function."""

from __future__ import annotations

import json

import pytest
from labelspark.sources.expander import register_expander
from labelspark.sources.quarantine import load_quarantined
from labelspark.sources.readers import SAMPLE_SCHEMA
from labelspark.sources.specs import SHAPES, SpecError, corpus, load_specs
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

SPEC = {"name": "q", "table": "t", "shape": "mcq_index", "role": "train",
        "columns": {"sample_id": "id", "question": "q", "choices": "split(c, ',')", "answer": "a"}}


def table(spark):
    return spark.createDataFrame([(1, "what", "x,y", 1), (2, "why", "u,v,w", 0)], "id long, q string, c string, a int")


def test_specs_become_samples(spark):
    specs = load_specs(json.dumps([SPEC, {**SPEC, "name": "e", "role": "eval"}]))
    got = corpus(specs, lambda name: table(spark), "train")
    assert [tuple(r) for r in got.orderBy("sample_id").collect()] == [
        ("q", "train", 1, "what", ["x", "y"], [0, 1]), ("q", "train", 2, "why", ["u", "v", "w"], [1, 0, 0])]
    assert corpus(specs, lambda name: table(spark)).count() == 4
    with pytest.raises(SpecError):
        corpus(specs[:1], lambda name: table(spark), "eval")


@pytest.mark.parametrize("change, what", [
    ({"shape": "absent"}, "unknown shape"), ({"role": "test"}, "role"), ({"more": 1}, "unknown key"),
    ({"columns": {"sample_id": "id"}}, "no expression for 'question'"), ({"options": {"names": []}}, "no option 'names'"),
    ({"shape": "binary_names", "columns": {"sample_id": "id", "text": "q", "label": "a"}}, "no option 'names'"),
])
def test_faults_of_a_spec(change, what):
    with pytest.raises(SpecError, match=what):
        load_specs([{**SPEC, **change}])
    with pytest.raises(SpecError, match="second corpus"):
        load_specs([SPEC, SPEC])


def test_faults_against_the_table(spark):
    def bound(**columns):
        load_specs([{**SPEC, "columns": {**SPEC["columns"], **columns}}])[0].samples(table(spark))

    with pytest.raises(SpecError, match="question"):
        bound(question="absent")
    with pytest.raises(SpecError, match="choices: string is no array.*answer: string is no number"):
        bound(choices="c", answer="q")


def test_every_shape_names_arguments_of_its_normaliser():
    import inspect

    for shape in SHAPES.values():
        names = list(inspect.signature(shape.function).parameters)
        assert names[1 : 1 + len(shape.columns)] == list(shape.columns)
        assert shape.options <= set(names)


def test_truncated_file(spark, tmp_path):
    good = {"sample_id": 1, "text": "a", "ltext": ["l"], "lint": [1]}
    lines = [good, {**good, "sample_id": 2, "text": " "}, {**good, "sample_id": 3, "ltext": []}, {**good, "sample_id": 4, "lint": [1, 0]}, good]
    text = "\n".join(map(json.dumps, lines))
    (tmp_path / "a.json").write_text(text[:-20])
    got = load_quarantined(spark, str(tmp_path), SAMPLE_SCHEMA)
    assert got.counts == {"valid": 1, "corrupt_record": 1, "empty_text": 1, "no_labels": 1, "truth_length": 1}
    assert [tuple(r) for r in got.samples.collect()] == [(1, "a", ["l"], [1])]
    rejected = {r["reason"]: r["record"] for r in got.rejected.collect()}
    assert rejected["corrupt_record"] == json.dumps(good)[:-20] and json.loads(rejected["no_labels"])["sample_id"] == 3


def test_columns_are_mapped_and_a_missing_path_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,hello,x\n2,there,\nbad,row,y\n")
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("i long, t string, l string")
    got = load_quarantined(spark, str(tmp_path), schema, lambda: {
        "sample_id": F.col("i"), "text": F.col("t"), "ltext": F.array("l"), "lint": F.array(F.lit(1))}, fmt="csv")
    assert got.counts == {"valid": 1, "corrupt_record": 1, "blank_label": 1}
    with pytest.raises(AnalysisException):
        load_quarantined(spark, str(tmp_path / "none"), SAMPLE_SCHEMA)


def test_table_function(spark):
    rows = [(1, "a", ["x", "y"], 1), (1, "b", ["z"], None), (2, "c", [], 0), (3, "d", None, 0)]
    spark.createDataFrame(rows, "id long, q string, c array<string>, a int").createOrReplaceTempView("mcq")
    name = register_expander(spark)
    got = spark.sql(f"SELECT * FROM {name}(TABLE(mcq) PARTITION BY (id) ORDER BY (q), 'c', 'a')")
    assert got.columns == ["id", "q", "label_id", "label", "truth"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, "x", 0), (1, "a", 2, "y", 1), (1, "b", 3, "z", 0)]
    ints = spark.createDataFrame([(1, [5, 6], 0)], "id long, c array<int>, a int")
    ints.createOrReplaceTempView("numbers")
    assert dict(spark.sql(f"SELECT * FROM {name}(TABLE(numbers) PARTITION BY (id), 'c', 'a')").dtypes)["label"] == "int"
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {name}(TABLE(mcq) PARTITION BY (id), 'q', 'a')")
