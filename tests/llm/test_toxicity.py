"""Toxicity on the given labels, and restoration of disguised words."""

import pytest
from pyspark.sql import functions as F

from labelspark.llm import channel, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def scored(tables):
    return toxicity.score(*tables).cache()


def test_held_out_accuracy(scored, tables):
    rows = scored.join(tables[1], "doc_id").where("held_out").collect()
    wrong = [r for r in rows if r["predicted"] != r["toxic"]]
    assert len(rows) > 100 and len(wrong) / len(rows) < 0.06
    assert sum(r["predicted"] and not r["toxic"] for r in rows) / len(rows) < 0.02


def test_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "x" * 3000 + "1" * 3000)], "doc_id long, text string")
    got = toxicity.score(docs.select("doc_id", "text").unionAll(odd), labels).where("doc_id is null or doc_id < 0").collect()
    assert len(got) == 3 and all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in got)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    none = toxicity.score(docs.limit(5), labels.limit(0)).collect()
    assert len(none) == 5 and not any(r["found"] for r in none)


def test_disguised_words_are_found(spark, tables):
    docs, labels = tables
    plain = "Of thnea onreat a {} that on thhahati the {} heing."
    words = [("loser", "idiot"), ("1d10t", "m0r0n"), ("l.o.s.e.r", "i d i o t"), ("idiooot", "$tupid"), ("reat", "thonor")]
    more = spark.createDataFrame([(10**6 + i, plain.format(*w)) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"] - 10**6: r for r in toxicity.score(docs.select("doc_id", "text").unionAll(more), labels)
           .where(F.col("doc_id") >= 10**6).collect()}
    assert [got[i]["predicted"] for i in range(5)] == [1, 1, 1, 1, 0]


def test_filter_keeps_columns(tables, scored):
    docs, labels = tables
    kept = {r["doc_id"] for r in toxicity.filtered(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in scored.where("predicted = 0").collect()}


def test_viterbi_against_all_paths():
    import numpy as np

    model = channel.CharModel(np.random.default_rng(1).integers(0, 50, channel.SIZE**3).astype(float))

    def paths(text):
        ways, ends = [(0, "", 0.0)], {}
        while ways:
            k, out, cost = ways.pop()
            if k < len(text):
                ways += [(to, out + o, cost + w) for to, o, w in channel._edges(text, k)]
                continue
            c = [0, 0, *[0 if x == " " else channel._CLASS.get(x, channel.OTHER) for x in out], 0]
            score = cost + sum(model.table[a][b][d] for a, b, d in zip(c, c[1:], c[2:]))
            ends[out] = max(score, ends.get(out, -1e9))
        return ends

    for text in ("1d10t", "a!!b", "sss0", "~x~y", "4", "", "zzzz1"):
        ends = paths(text)
        assert ends[channel.decode(text, model)] == pytest.approx(max(ends.values()))


def test_letters_set_apart():
    assert [m[0] for m in channel.APART.finditer("the l o s e r is l.o.s.e.r, a b c-d-e")] == ["l o s e r", "l.o.s.e.r", "c-d-e"]
    assert "loser" in channel.together("a l o s e r")


def test_split_and_joined_words_are_found(spark, tables):
    docs, labels = tables
    plain = "Of thnea onreat a {} that on thhahati the heing."
    words = ["y o u i d i o t", "id io t", "i  d  i  o  t", "i, d, i, o, t", "i\nd\ni\no\nt", "1, d, 1, 0, t", "you,idiot", "sad-idiot",
             "idi.ot", "you idiot", "idi ot", "l_o_s_e_r", "l o s e r s", "$ c u m", "idi" + "o" * 100 + "t", "reat heing", "d i t o"]
    more = spark.createDataFrame([(10**6 + i, plain.format(w)) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"] - 10**6: r for r in toxicity.score(docs.select("doc_id", "text").unionAll(more), labels)
           .where(F.col("doc_id") >= 10**6).collect()}
    told = [{x for x in ("idiot", "loser", "scum") if any(f.startswith(x) for f in got[i]["found"])} for i in range(len(words))]
    assert told == [{"idiot"}] * 11 + [{"loser"}] * 2 + [{"scum"}, {"idiot"}, set(), set()]


def test_pieces_overlap():
    import numpy as np

    counts = np.zeros(channel.SIZE**3)
    for word in ("idiot", "of", "the"):
        at, n = np.unique(channel.trigram_counts(f" {word} " * 1000), return_counts=True)
        counts[at] += n
    restorer = toxicity.Restorer(channel.CharModel(counts))
    for k in range(40, 80):
        assert "idiot" in restorer.word(("of.the." * 12)[:k].rstrip(".") + ".1d10t.of.the")


def test_scores_do_not_depend_on_the_partitions(spark):
    """A clean text with the term in 24 copies counts once, however it is dealt."""
    words = [f"{a}{b}{c}" for a in "bdfgklmnpr" for b in "aeiou" for c in ("st", "nd", "rk")]
    rows = [(i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(12)), 0) for i in range(300)]
    rows += [(1000 + i, f"{words[i]} {words[i + 9]} horrid {words[i + 30]}", 1) for i in range(60)]
    rows += [(2000 + i, "a horrid day in the mark", 0) for i in range(24)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = []
    for n in (1, 64):
        part = table.repartition(n)
        scored = toxicity.score(part.select("doc_id", "text"), part.select("doc_id", "toxic"))
        got.append(sorted((r["doc_id"], r["score"], r["predicted"]) for r in scored.collect()))
    assert got[0] == got[1] and sum(p for _, _, p in got[0]) >= 60
