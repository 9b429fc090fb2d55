"""Top-k searches against plain versions, at several sizes of shards and blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from labelspark.llm import maxscore, termtime
from pyspark.sql import functions as F


def plain_nearest(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [max(-maxscore.LARGEST, min(maxscore.LARGEST, math.floor(64 * x))) for x in v]
        vectors[i] = min(vectors.get(i, w), w)
    out = []
    for q in vectors:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[c])), c) for c in vectors if c != q)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_postings": 40, "block_weights": 30}])
def test_nearest(spark, sizes):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(120)]
    rows += [(i, [0.5, 0.0, -0.25, 0.0, 0.0, 0.125]) for i in range(200, 260)]  # one vector many times
    rows += [(300, [0.0] * 6), (305, []), (310, [1e30, -1e30]), (311, [0.2] * 9), (320, None), (325, [1.0, None]),
             (330, [float("nan")]), (335, [float("inf")]), (None, [1.0]), (5, [0.1] * 6), (5, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = maxscore.nearest(df, 7, 5, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_nearest(rows, 7, 5)


def test_fewer_rows_than_k_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [-1.0]), (1, [1.0]), (2, [0.0])]
    got = maxscore.nearest(spark.createDataFrame(rows, schema), 20, 20).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2, 0), (0, 2, 1, -4096)]
    assert maxscore.nearest(spark.createDataFrame([], schema), 20, 20).count() == 0


def test_sparse_rows_skip_weak_lists(spark):
    """Many terms per row, few shared: the lists of weak terms are only probed."""
    rng = random.Random(8)
    rows = [(i, sorted(rng.sample(range(500), 12)), [rng.randint(1, 9) ** 3 for _ in range(12)]) for i in range(9000)]
    queries = [(10_000 + j, sorted(rng.sample(range(500), 20)), [rng.randint(1, 9) ** 3 for _ in range(20)]) for j in range(6)]
    schema = "id long, terms array<int>, weights array<bigint>"
    got = maxscore.search(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), 5).collect()
    for q, terms, weights in queries:
        own = dict(zip(terms, weights))
        best = sorted((-sum(own.get(t, 0) * w for t, w in zip(ts, ws)), i) for i, ts, ws in rows)[:5]
        assert sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def plain_rank(docs, items, k):
    def terms(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]

    tf = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in tf if c), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in of.items():
        found = []
        for i, c in tf:
            if c:
                m = 50 + 50 * sum(c.values()) * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
                if s > 0:
                    found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_pairs": 9, "shard_postings": 60}])
def test_rank(spark, sizes):
    rng = random.Random(4)
    common, rare = ["the", "of", "and", "Ärger", "x9"], [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(400)]
    docs += [(i, "The w1, w1; of_W2") for i in range(500, 620)]  # ties over many rows
    docs += [(None, "the w1 w2"), (None, "the w1 w2"), (7, "the w1 w2"), (700, None), (701, ""), (702, "--- ..."), (703, "w1 the " * 20_000)]
    items = [(j, " ".join(rng.choices(common + rare, k=12))) for j in range(12)]
    items += [(20, "w1 W1 w2"), (20, "w3"), (21, None), (22, "absent"), (None, "w5 the"), (23, "the of and"), (24, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("item_id", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = plain_rank(docs, items, 50)
    got = termtime.rank(d, q, 50, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sorted((tuple(r) for r in termtime.rank(d.repartition(9), q, 50, **sizes).collect()), key=repr) == want


def test_rank_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert termtime.rank(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert termtime.rank(some, items.limit(0)).count() == 0
