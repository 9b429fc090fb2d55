"""The pipeline's stages against their operators and brute force."""

import hashlib

import corpus_pipeline
import pytest

from labelspark.llm import neardup, suffixes, templates, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of every stage, rows by id."""
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        after = spark.read.parquet(f"{base}/{name}")
        out.append((docs, after))
        docs = after
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_order_and_columns(steps, spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert list(steps) == ["toxicity", "near_duplicates", "suffix_dedup", "benchmark_decontamination", "bpe"]
    for name, (_, after) in steps.items():
        assert (after.columns == columns) == (name != "bpe")


def test_filters_change_nothing_else(steps):
    for name in ("toxicity", "near_duplicates", "benchmark_decontamination"):
        before, after = map(rows, steps[name])
        assert all(before[i] == r for i, r in after.items()) and len(after) < len(before)


def test_decisions(steps, spark):
    before, after = steps["toxicity"]
    bad = {r["doc_id"] for r in toxicity.score(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert rows(before).keys() - rows(after).keys() == bad
    before, after = steps["near_duplicates"]
    assert rows(after).keys() == {r["doc_id"] for r in neardup.groups(before, 5).where("kept").collect()}
    before, after = steps["benchmark_decontamination"]
    bad = {r["doc_id"] for r in templates.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert rows(before).keys() - rows(after).keys() == bad


def test_suffix_stage_by_brute_force(steps):
    before, after = map(rows, steps["suffix_dedup"])
    n = corpus_pipeline.PASSAGE_BYTES
    assert before.keys() == after.keys()
    seen, bodies = {}, {i: r["text"].encode() for i, r in before.items()}
    for b in bodies.values():
        for k in range(len(b) - n + 1):
            h = hashlib.blake2b(b[k : k + n], digest_size=12).digest()
            seen[h] = seen.get(h, 0) + 1
    for i, b in bodies.items():
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[hashlib.blake2b(b[k : k + n], digest_size=12).digest()] > 1:
                gone[k : k + n] = b"\1" * n
        left = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        assert after[i]["text"] == left and after[i]["n_chars"] == len(left)


def test_tokens(steps):
    tokenizers = pytest.importorskip("tokenizers")
    from labelspark.llm.queries import tokenizer_path

    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    before, after = map(rows, steps["bpe"])
    assert before.keys() == after.keys()
    for i, r in after.items():
        want = lib.encode(before[i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["decoded"] == lib.decode(want, skip_special_tokens=False)


def test_run(spark, steps):
    got = rows(corpus_pipeline.run(spark, SF))
    assert got == rows(steps["bpe"][1])
