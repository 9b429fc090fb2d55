"""Language-model scores against a sequential model in plain Python."""

import math
import re
import zlib
from collections import Counter

import pytest

from labelspark.llm import lm

TEXTS = [None, "", "the cat sat", "the cat sat on the mat", "The\tCAT ran", "a  b a b a b", "zebra", "É é the"] * 3 + ["the the the"] * 9


def brute(texts, order, mu):
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    toks = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for t in texts]
    counts, n = Counter(), 0
    for h, ws in zip(held, toks):
        if h:
            continue
        counts["<s>",] += 1
        for i, w in enumerate(ws):
            n += 1
            for j in range(1, order + 1):
                gram = tuple((["<s>"] + ws[: i + 1])[-j:])
                if j == 1 or gram not in [tuple((["<s>"] + ws[: i + 1])[-k:]) for k in range(1, j)]:
                    counts[gram] += 1
    v = sum(len(g) == 1 for g in counts) - ("<s>",) .__len__()

    def p(hist, w):
        if not hist:
            return (counts[w,] + 0.1) / (n + 0.1 * (v + 1))
        return (counts[(*hist, w)] + mu * p(hist[1:], w)) / (counts[hist] + mu)

    out = []
    for h, ws in zip(held, toks):
        base = sum(math.log10(p((), w)) for w in ws)
        full = sum(math.log10(p(tuple((["<s>"] + ws[:i])[-(order - 1):]) if order > 1 else (), w)) for i, w in enumerate(ws))
        out.append((h, len(ws), sum(counts[w,] > 0 for w in ws), n, base, full))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_sequential_model(spark, order):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'x' AS batch")
    got = {r["doc_id"]: r for r in lm.score(df, order, mu=2.0).collect()}
    want = brute(TEXTS, order, 2.0)
    assert sorted(got) == list(range(len(TEXTS)))
    for i, (h, k, known, n, base, full) in enumerate(want):
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (h, k, known, n)
        assert g["base_score"] == pytest.approx(base, rel=1e-12) and g["score"] == pytest.approx(full, rel=1e-12)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert lm.score(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score(spark.createDataFrame([(held, "no training rows")], schema)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and math.isfinite(row["score"])
    rows = lm.score(spark.createDataFrame([(None, "a"), (None, None)], schema)).collect()
    assert [r["doc_id"] for r in rows] == [None, None]
