"""Quality rules, boosted trees and neighbour votes."""

import random
import re
import zlib

import numpy as np
import pytest

from labelspark.llm import gbt, neighbours, rules

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside.update(range(i, i + 5))
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)]


def texts():
    r = random.Random(4)
    out = [None, "", " \n\t", "a", "a b c d e a b c d e", "x\nx\n \nx", "é|# <b>\nTop", "a a a a a a a a a a a"]
    for _ in range(60):
        out.append("".join(r.choice(["a ", "b ", "cc ", "d# ", "\n", "ü\t"]) for _ in range(r.randrange(120))))
    return out


def test_counts():
    for t in texts():
        assert rules.statistics(t)[0] == plain_counts(t), t


def test_judge(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "one " * 12)], "doc_id long, text string").selectExpr("*", "'f' AS features")
    rows = docs.selectExpr("doc_id", "text", "lang AS features").unionAll(odd)
    got = {r["doc_id"]: r for r in rules.judge(rows, labels).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        g, want = got[r["doc_id"]], plain_counts(r["text"]) if len(r["text"] or "") < 3000 else None
        if want:
            assert [g[c] for c in rules.COUNTS] == want
        failed = g["n_words"] < 10 or 100 * g["n_repeat_words"] > 20 * g["n_words"]
        assert g["base_failed"] == failed and g["kept"] == (not failed and g["score"] >= 0.5)
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    held = [(g["kept"], q) for g, q in held if not g["base_failed"]]
    assert sum(k == bool(q) for k, q in held) / len(held) > 0.95
    assert rules.judge(rows.limit(0), labels).count() == 0
    assert {r["score"] for r in rules.judge(rows.limit(9), labels.limit(0)).collect()} == {0.5}


def test_trees_respect_the_constraints():
    g = np.random.default_rng(0)
    x = g.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * g.normal(size=3000) > 0).astype(float)
    forest = gbt.train(x, y, np.array([1, 0, -1]))
    assert ((forest.predict(x) > 0.5) == y).mean() > 0.9
    for f, sign in ((0, 1), (2, -1)):
        base = g.normal(size=(200, 3))
        line = np.linspace(-3, 3, 60)
        probe = np.repeat(base, len(line), axis=0)
        probe[:, f] = np.tile(line, len(base))
        steps = np.diff(forest.margin(probe).reshape(len(base), -1), axis=1)
        assert (sign * steps >= -1e-12).all()
    def walk(row):
        total = forest.base
        for k in forest.roots:
            while forest.feature[k] >= 0:
                k = forest.high[k] if row[forest.feature[k]] > forest.at[k] else forest.low[k]
            total += forest.value[k]
        return total
    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])
    assert gbt.train(x[:0], y[:0], np.array([1, 0, -1])).predict(x[:2]).tolist() == [0.5, 0.5]


def test_neighbours(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (-1, "")], "doc_id long, text string").selectExpr("*", "'b' AS bin")
    rows = docs.selectExpr("doc_id", "text", "lang AS bin").unionAll(odd)
    got = {r["doc_id"]: r for r in neighbours.classify(rows, labels).collect()}
    assert len(got) == rows.count()
    for d, g in got.items():
        assert g["held_out"] == (zlib.crc32(b"" if d is None else str(d).encode()) % 3 == 1)
        assert 0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5)
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert got[None]["score"] == got[-1]["score"]
    assert neighbours.classify(rows.limit(0), labels).count() == 0
    assert {r["score"] for r in neighbours.classify(rows.limit(5), labels.limit(0)).collect()} == {0.5}


def test_votes_are_exact():
    g = np.random.default_rng(2)
    x, y = neighbours._unit(np.abs(g.normal(size=(300, 40)))).astype(np.float32), g.integers(0, 2, 300)
    space = neighbours.Space(x, y, np.ones(40), rank=10)
    probe = neighbours._unit(np.abs(g.normal(size=(700, 40)))).astype(np.float32)
    z = neighbours._unit(probe @ space.axes)
    for i, s in enumerate(space.vote(probe, 5, 8)):
        c = space.vectors @ z[i]
        near = np.argsort(-c)[:5]
        w = np.maximum(c[near], 0) ** 8
        assert s == pytest.approx((w * y[near]).sum() / w.sum(), rel=1e-3)
