"""A-10: record, label lists and sink, against the operators that build the pairs."""

from labelspark.operators import pairs as P
from labelspark.sources.sinks import write_dataset_info

ROWS = [
    ("train", 1, "t1", ["a", "b"], ["c", "d", "e"]), ("train", 2, "t2", ["a"], ["b"]), ("train", 3, "t3", ["f"], []),
    ("train", 4, "t4", [], ["a", "b", "c", "d"]), ("eval", 5, "t5", ["a", "g"], ["h"]), ("eval", 6, "t6", ["a"], None),
    ("eval", 7, "t7", None, ["a", "b", "c"]),
]
SCHEMA = "split string, sample_id long, text string, labels array<string>, not_labels array<string>"


def test_record_counts_what_the_operators_build(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["split"]: r for r in P.dataset_record(df).collect()}
    assert {s: (r["n_samples"], r["n_train_pairs"], r["n_eval_triplets"]) for s, r in got.items()} == {
        "train": (4, 2, 3), "eval": (3, 0, 2), None: (7, 2, 5)}
    for s in ("train", "eval"):
        part = df.where(df["split"] == s)
        assert got[s]["n_train_pairs"] == P.negative_tuples(part).count()
        assert got[s]["n_eval_triplets"] == P.contrastive_pairs(part).count()
    bare = {r["split"]: (r["n_train_pairs"], r["n_eval_triplets"]) for r in P.dataset_record(df.drop("not_labels")).collect()}
    assert bare == {"train": (0, 4), "eval": (0, 3), None: (0, 7)}


def test_sink(spark, tmp_path):
    write_dataset_info(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path))
    labels = spark.read.parquet(f"{tmp_path}/labels").collect()
    assert sorted((r["split"], r["label"]) for r in labels) == sorted(
        [("train", x) for x in "abcdef"] + [("eval", x) for x in "abcgh"])
    record = {r["split"]: r["n_train_pairs"] for r in spark.read.json(f"{tmp_path}/record").collect()}
    assert record == {"train": 2, "eval": 0, None: 2}
