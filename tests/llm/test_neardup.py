"""Near-duplicate groups against exact Jaccard over all pairs."""

import random
import re

import numpy as np
import pytest

from labelspark.llm import neardup
from labelspark.llm.superminhash import signature


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return {d: (len(s), best[find(i)], best[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def corpus(seed):
    r = random.Random(seed)
    def words(n, v=400):
        return [f"w{r.randrange(v)}" for _ in range(n)]
    texts = [None, "", "  \t", "One", "one", "two words", "two  WORDS", "two words more"]
    for _ in range(12):
        base = words(r.randrange(3, 120))
        for _ in range(r.randrange(1, 25)):  # edits from none to beyond the threshold
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 8))):
                t[r.randrange(len(t))] = f"w{r.randrange(400)}"
            texts.append(" ".join(t))
    texts += [texts[20]] * 40 + [" ".join(words(30)) for _ in range(40)]
    r.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [2, 5])
def test_matches_all_pairs(spark, k):
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS key", "0 AS node")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(df, k).collect()}
    assert got == brute(rows, k)


def test_prefix_join_finds_what_the_bands_miss(spark):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.groups(df, 2, bands=3, band_rows=1).collect()
    want = brute(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: w[1] for d, w in want.items()}


def test_edges_and_dedup(spark):
    schema = "doc_id long, text string"
    assert neardup.groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c"), (4, "a b c"), (2, "A b  c"), (None, None), (5, "same id"), (5, "same id"), (9, "")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.groups(df, 2).collect())
    assert got == [(0, 0, True), (0, 2, False), (2, 2, True), (4, 2, False), (5, 5, True), (5, 5, True), (9, 9, True)]
    kept = sorted(r["doc_id"] or 0 for r in neardup.deduplicate(df, shingle=2).collect())
    assert kept == [0, 0, 2, 5, 9]


def test_signature_estimates_jaccard():
    g = np.random.default_rng(0)
    x = g.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(x[:2700]), np.sort(x[300:])
    same = np.mean(signature(a, 256) == signature(b, 256))
    assert abs(same - 0.8) < 0.1 and (signature(a, 256) == signature(a, 256, block=100)).all()


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
