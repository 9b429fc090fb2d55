"""Operator tests: packing, normalisers, pairs, sampling and partition-count
invariance of everything ordered or random."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelspark.operators import annotate as AN
from labelspark.operators import normalize as N
from labelspark.operators import pack as PK
from labelspark.operators import pairs as P
from labelspark.operators import sampling as SM
from labelspark.operators.prefix import global_row_number, running_sums


def tiny(spark):
    return spark.createDataFrame(
        [(0, "hello", ["a"], [1]), (1, "worlds", ["b", "c"], [0, 1])],
        "sample_id long, text string, ltext array<string>, lint array<int>")


def test_pack_tiny(spark):
    rows = {r.sample_id: r for r in PK.pack(tiny(spark), 32).collect()}
    assert rows[0].input_tokens == ["[CLS]", "hello", "[SEP]", "a", "[LAB]"]
    assert rows[0].lmask == [0, 0, 0, 1, 0]
    assert rows[1].lmask == [0, 0, 0, 1, 0, 2, 0]
    assert rows[1].n_fit == 2


def test_pack_budget_truncates_text_and_labels(spark):
    df = spark.createDataFrame(
        [(0, " ".join(f"w{i}" for i in range(40)), ["x y", "z", "long label here"], [1, 0, 1])],
        "sample_id long, text string, ltext array<string>, lint array<int>")
    r = PK.pack_training(df, 24, 10, shuffle=False, remove_underscores=0.0).collect()[0]
    # text budget max(22 // 2, 10) = 11, label budget 11: "x y"(3) + "z"(2) + 4 = 9 fits all? 3+2+4=9
    assert r.input_tokens[:2] == ["[CLS]", "w0"] and r.input_tokens.count("[SEP]") == 1
    assert len([t for t in r.input_tokens[1:12]]) == 11
    assert r.n_fit == 3 and r.lint == [1, 0, 1]


def test_pad(spark):
    r = PK.pad(PK.pack(tiny(spark), 32), 8).filter("sample_id = 0").collect()[0]
    assert r.input_tokens == ["[CLS]", "hello", "[SEP]", "a", "[LAB]", "[PAD]", "[PAD]", "[PAD]"]
    assert r.attention_mask == [1, 1, 1, 1, 1, 0, 0, 0]


def test_build_labels_strict_length_and_strip(spark):
    df = spark.createDataFrame([(0, "t", [" ab ", "a", "\tabc\n"], ["xy", ""])],
                               "sample_id long, text string, pos array<string>, neg array<string>")
    r = N.build_labels(df, "sample_id", "text", "pos", "neg", 1).collect()[0]
    assert r.ltext == ["ab", "abc", "xy"] and r.lint == [1, 1, 0]


def test_validate_reasons(spark):
    df = spark.createDataFrame(
        [(0, " _ ", ["a"], [1]), (1, "t", [], []), (2, "t", ["a", "__"], [1, 0]),
         (3, "t", ["a"], [1, 0]), (4, "t", ["a"], [1])],
        "sample_id long, text string, ltext array<string>, lint array<int>")
    got = {r.reason: r.n for r in N.reject_summary(df).collect()}
    assert got == {"empty_text": 1, "no_labels": 1, "blank_label": 1, "truth_length": 1, "valid": 1}


def test_running_sums_partition_invariant(spark):
    base = spark.range(0, 997).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    want = None
    for parts in (1, 8):
        d = base.repartition(parts)
        got = sorted(tuple(r) for r in running_sums(d, [], [("k", True)], {"c": F.col("v")})
                     .select("k", "c").collect())
        if want is None:
            want = got
        assert got == want
    exp, acc = [], 0
    for k in range(997):
        acc += k % 7
        exp.append((k, acc))
    assert want == exp


def test_global_row_number_with_keys(spark):
    d = spark.range(0, 300).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    rows = global_row_number(d.repartition(7), [("x", False)], keys=["g"]).collect()
    for r in rows:
        assert r.rn == (299 - r.x) // 3 + 1


def test_sample_exact_partition_invariant(spark):
    d = spark.range(0, 5000).withColumnRenamed("id", "doc_id")
    a = sorted(r.doc_id for r in SM.sample_exact(d.repartition(1), 123, "doc_id").collect())
    b = sorted(r.doc_id for r in SM.sample_exact(d.repartition(9), 123, "doc_id").collect())
    assert a == b and len(a) == 123


def test_contrastive_cycle_and_invariance(spark):
    df = spark.createDataFrame(
        [(1, "t1", ["p1", "p2"], ["n1", "n2", "n3"]), (2, "t2", ["q1"], []),
         (3, "t3", ["r1", "r2"], ["m1", "m2"])],
        "sample_id long, text string, labels array<string>, not_labels array<string>")
    for parts in (1, 3):
        got = sorted((r.sample_id, r.pos, r.negative)
                     for r in P.contrastive_pairs(df.repartition(parts)).collect())
        # emitted n = 1, 2 (sample 1), 3, 4 (sample 3): indices (n-1) mod L
        assert got == [(1, 0, "n1"), (1, 1, "n2"), (3, 0, "m1"), (3, 1, "m2")]


def test_random_other_negative_never_self(spark):
    df = spark.createDataFrame([(i, f"t{i}", [f"l{i % 5}"]) for i in range(50)],
                               "sample_id long, text string, labels array<string>")
    pairs = P.contrastive_pairs(df, not_labels=None)
    out = P.random_other_negatives(pairs).collect()
    assert len(out) == 50 and all(r.negative != r.positive for r in out)


def test_eval_pairs_positive_wins(spark):
    t = spark.createDataFrame([("a", "x", "y"), ("a", "y", "x")], "text string, positive string, negative string")
    got = {(r.text, r.label): r.flag for r in P.evaluation_pairs(t).collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 1}


def test_shuffle_labels_partition_invariant(spark):
    d = spark.range(0, 200).select(F.col("id").alias("sample_id"), F.lit("t").alias("text"),
                                   F.array(*[F.lit(c) for c in "abcde"]).alias("ltext"),
                                   F.array(*[F.lit(i) for i in (1, 0, 0, 0, 0)]).alias("lint"))
    a = {r.sample_id: (r.ltext, r.lint) for r in N.shuffle_labels(d.repartition(1)).collect()}
    b = {r.sample_id: (r.ltext, r.lint) for r in N.shuffle_labels(d.repartition(6)).collect()}
    assert a == b
    for lt, li in a.values():
        assert li[lt.index("a")] == 1


def test_generator_retry(spark):
    calls = {"n": 0}

    def flaky(prompts: pd.Series) -> pd.Series:
        calls["n"] += 1
        if calls["n"] == 1:
            raise RuntimeError("transient")
        return AN.stub_generator(prompts)

    d = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string").coalesce(1)
    out = AN.annotate(d, flaky, min_length=10).collect()
    assert len(out) == 1 and out[0].sentence == "word " * 30 and out[0].labels == []


def test_annotate_samples_and_writes_batches(spark, tmp_path):
    d = spark.range(300).selectExpr("id AS doc_id", "concat('text of a document that is long enough ', repeat('x', CAST(id % 7 AS INT))) AS text")
    out = AN.annotate(d, factory=lambda: AN.stub_generator, min_length=10, sample=200, path=str(tmp_path / "a"), batch_size=50)
    rows = out.collect()
    whole = {r["doc_id"] for r in AN.annotate(d, AN.stub_generator, min_length=10).collect()}
    assert {r["doc_id"] for r in rows} <= whole and 150 < len(rows) < 200
    sizes = [r["n"] for r in spark.read.json(str(tmp_path / "a")).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert sizes[:3] == [50, 50, 50] and sum(sizes) == len(rows)


@pytest.mark.parametrize("raw,ok", [
    ('{"sentence": "s", "labels": ["a"], "not_labels": [], "x": 1}', True),
    ('{"sentence": "s", "labels": [1], "not_labels": []}', False),
    ('{"sentence": 3, "labels": ["a"], "not_labels": []}', False),
    ('{"labels": ["a"], "not_labels": []}', False),
    ('{"sentence": "s", "labels": ["a"]', False),
])
def test_parse_generated_strict(spark, raw, ok):
    r = spark.createDataFrame([(raw,)], "raw string").select(
        AN.parse_generated("raw").alias("g")).collect()[0]
    assert (r.g is not None) == ok


def test_write_batches_sizes(spark):
    import uuid

    from labelspark.session import scratch_path
    from labelspark.sources.sinks import write_batches
    d = spark.range(0, 230).withColumnRenamed("id", "doc_id")
    path = scratch_path(spark, f"batches-{uuid.uuid4().hex}")
    write_batches(d, path, "doc_id", batch_size=50, start_index=100)
    back = spark.read.json(path)
    sizes = {r.batch: r["count"] for r in back.groupBy("batch").count().collect()}
    # start index 100 with 50 per file -> first batch number 3
    assert sizes == {3: 50, 4: 50, 5: 50, 6: 50, 7: 30}


def test_checked_vocab_rejects_large(spark):
    d = spark.range(0, 50).withColumnRenamed("id", "v")
    with pytest.raises(ValueError):
        N.checked_vocab(d, "v", max_size=10)
    assert N.checked_vocab(d, "v", max_size=100).collect()[0].vocab == list(range(50))


def test_tiled_product_equals_matrix_scores(spark, monkeypatch):
    from labelspark.operators import classify as C
    vec = "transform(sequence(0, 4), j -> cast(sin({} * 5 + j) AS double))"
    texts = spark.range(0, 40).selectExpr("id AS sample_id", f"CASE WHEN id = 7 THEN NULL ELSE {vec.format('id')} END AS text_vec")
    labels = spark.range(0, 25).selectExpr("id AS cand", f"{vec.format('(id + 100)')} AS label_vec")
    assert C.pair_product(texts, labels, text_blocks=3, label_blocks=4).select("sample_id", "cand").distinct().count() == 1000
    weights, matrix = [.5, -1., 2., 0., 1.], [[float(i * j % 3) for j in range(5)] for i in range(5)]
    for head, act in (("cosine", "sigmoid"), ("cosine", "softmax"), ("dot", "none"), ("bilinear", "sigmoid")):
        got = []
        for rows in (4096, 10):
            monkeypatch.setattr(C, "MAX_MATRIX_ROWS", rows)
            s = C.score_pairs(texts, labels, head=head, activation=act, weights=weights, matrix=matrix, bias=.25)
            got.append({(r["sample_id"], r["cand"]): (r["logit"], r["score"]) for r in s.collect()})
        assert got[0].keys() == got[1].keys() and len(got[0]) == 1000
        for k, (a, b) in got[0].items():
            assert (a, b) == (None, None) if k[0] == 7 else (a, b) == pytest.approx(got[1][k])


def test_sample_exact_small_input_returns_all(spark):
    d = spark.range(0, 20).withColumnRenamed("id", "doc_id")
    assert SM.sample_exact(d, 50, "doc_id").count() == 20


def test_softmax_over_sums_to_one(spark):
    from labelspark.functions.activation import softmax_over
    d = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, -1.0), (2, 3.0)], "s long, x double")
    got = {r.s: r.t for r in softmax_over(d, ["s"], "x", "p").groupBy("s").agg(
        F.sum("p").alias("t")).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(1.0)


def test_running_sums_many_buckets(spark):
    d = spark.range(0, 3000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    got = sorted(tuple(r) for r in running_sums(d, [], [("k", True)], {"c": F.col("v")},
                                                n_buckets=600).select("k", "c").collect())
    assert got == [(k, k + 1) for k in range(3000)]


def test_top_predictions_all_ranked(spark):
    from labelspark.operators.classify import top_predictions
    d = spark.createDataFrame([(1, 1, "a", 0.2), (1, 2, "b", 0.9), (1, 3, "c", 0.9), (2, 1, "a", 0.1)],
                              "sample_id long, label_id int, label string, score double")
    got = sorted((r.sample_id, r.label, r.rank) for r in top_predictions(d).collect())
    assert got == [(1, "a", 3), (1, "b", 1), (1, "c", 2), (2, "a", 1)]


def test_write_results_roundtrip(spark):
    import uuid

    from labelspark.session import scratch_path
    from labelspark.sources.readers import read_results
    from labelspark.sources.sinks import write_detail_json, write_results
    from helpers import pred_df
    p = pred_df(spark, [[1, 0, 0], [0, 1, 0]], [[.9, .2, .1], [.3, .6, .4]])
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    from labelspark.operators import metrics as M
    write_results(M.basic_metrics(p), p, path)
    write_detail_json(p, f"{path}/nested")
    assert spark.read.json(f"{path}/metrics").count() == 1
    assert spark.read.parquet(f"{path}/detail").count() == 6
    back = sorted(tuple(r) for r in read_results(spark, f"{path}/nested").collect())
    assert back == sorted(tuple(r) for r in p.select("sample_id", "label_id", "truth", "score").collect())


def test_pad_to_max(spark):
    r = {x.sample_id: x for x in PK.pad_to_max(PK.pack(tiny(spark), 32), 32).collect()}
    assert len(r[0].input_tokens) == len(r[1].input_tokens) == 7
    assert r[0].attention_mask == [1, 1, 1, 1, 1, 0, 0]


def test_running_sums_awkward_orders(spark):
    """NULL, text and two-valued order keys and NULL group keys, alike for any
    number of ranges."""
    rows = [(None if i % 7 == 0 else f"k{i % 2}", None if i % 5 == 0 else i % 2, i, f"id-{i:04d}") for i in range(400)]
    d = spark.createDataFrame(rows, "g string, two int, i int, name string")
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, -r[2])):
            total += r[2]
            want[r[3]] = total
    for n in (1, 8, 300):
        got = running_sums(d, ["g"], [("two", True), ("name", False)], {"c": F.col("i")}, n_buckets=n)
        assert {r["name"]: r["c"] for r in got.collect()} == want
        down = global_row_number(d, [("two", False), ("name", True)], n_buckets=n).collect()
        order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[3]))
        assert {r["name"]: r["rn"] for r in down} == {r[3]: k + 1 for k, r in enumerate(order)}


def test_batch_folders_past_four_digits(spark, tmp_path):
    from labelspark.sources.sinks import write_batches
    d = spark.range(300).withColumnRenamed("id", "k")
    write_batches(d, str(tmp_path / "b"), "k", 50, start_index=9998 * 50)
    counts = {r["batch"]: r["count"] for r in spark.read.json(str(tmp_path / "b")).groupBy("batch").count().collect()}
    assert counts == {n: 50 for n in range(9999, 10005)}


def test_dialogue_ids_do_not_collide(spark):
    from labelspark.operators.normalize import dialogue
    q = F.expr("transform(sequence(1, n), i -> struct(concat('q', i) AS question, array('a', 'b') AS choice, 'a' AS answer))")
    d = spark.createDataFrame([(1, 1001), (2, 3), (7, 0), (9, 2)], "id long, n int").withColumn("t", F.array(F.lit("x")))
    d = d.withColumn("q", F.when(F.col("n") > 0, q))
    ids = sorted(r["sample_id"] for r in dialogue(d, "id", "t", "q").collect())
    assert ids == list(range(1006))


def test_missing_answers_are_false_and_null_truth_is_rejected(spark):
    from labelspark.operators.normalize import binary_answer, mcq_value, reject_summary
    d = spark.createDataFrame([(1, "q", ["a", "b"], None)], "id long, q string, c array<string>, a string")
    assert mcq_value(d, "id", "q", "c", "a").first()["lint"] == [0, 0]
    assert binary_answer(d.withColumn("n", F.lit(None).cast("int")), "id", "q", "n").first()["lint"] == [0, 0]
    bad = spark.createDataFrame([(1, "t", ["a"], [None])], "sample_id long, text string, ltext array<string>, lint array<int>")
    assert reject_summary(bad).first()["reason"] == "null_truth"


def test_unmapped_hierarchy_label_fails_by_default(spark):
    import pytest
    from labelspark.operators.normalize import hierarchy_rollup
    h = spark.createDataFrame([("g", "x")], "group string, fine string")
    d = spark.createDataFrame([(1, "t", "x"), (2, "t", "y")], "id long, t string, y string")
    with pytest.raises(Exception, match="not in the hierarchy"):
        hierarchy_rollup(d, "id", "t", "y", h).collect()
    kept = {r["sample_id"]: r["lint"] for r in hierarchy_rollup(d, "id", "t", "y", h, on_unmapped="keep").collect()}
    assert kept == {1: [1], 2: [0]}


def test_expand_maps_a_row_to_many_samples(spark):
    from labelspark.sources.readers import expand

    def split(b):
        rows = [(r.id * 10 + k, w, [w], [1]) for r in b.itertuples() for k, w in enumerate(r.t.split())]
        return pd.DataFrame(rows, columns=["sample_id", "text", "ltext", "lint"])

    d = spark.createDataFrame([(1, "a b c"), (2, ""), (3, "d")], "id long, t string")
    got = sorted((r["sample_id"], r["text"], r["ltext"]) for r in expand(d, split).collect())
    assert got == [(10, "a", ["a"]), (11, "b", ["b"]), (12, "c", ["c"]), (30, "d", ["d"])]


def test_own_metric_and_non_strings(spark):
    from labelspark.functions.text import ensure_string
    from labelspark.operators import metrics as M
    p = spark.createDataFrame([(i, 1, int(s >= .4), s) for i, s in enumerate([.1, .2, .4, .5, .9])],
                              "sample_id long, label_id int, truth int, score double")
    r = M.best_threshold(p, lambda tp, fp, fn, tn: tp / (tp + fn) - fp / (fp + tn)).first()
    assert r["best_score"] == 1.0 and .2 <= r["best_threshold"] <= .4
    d = spark.createDataFrame([(3, " a_b ", None)], "n int, s string, v string")
    row = d.select(ensure_string("n").alias("n"), ensure_string("s").alias("s"), ensure_string("v").alias("v"),
                   F.transform(F.array("n"), lambda x: ensure_string(x)).alias("a")).first()
    assert (row["n"], row["s"], row["v"], row["a"]) == ("", "a b", "", [""])
