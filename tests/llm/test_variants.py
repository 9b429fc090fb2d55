"""Spelling variants: near pairs against edit distances, counts and forms against
a plain version, and the defined results of odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from labelspark.llm import variants
from pyspark.sql import functions as F


def edit_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, every=199, least_length=6, least_count=5, factor=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    near = {w: sorted((-n[v], v) for v in n if edit_one(v, w)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= factor * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_near_pairs_are_all_pairs_one_edit_apart(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé×ö") for _ in range(rng.randint(1, 7))) for _ in range(400)}
    words |= {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500, "y" * 3000, "a"}
    want = {(a, b) for a in words for b in words if a < b and edit_one(a, b)}
    df = spark.createDataFrame([(w, "other") for w in words] + [(None, "z"), ("", "z")], "word string, key string")
    for parts in (3, variants.PARTS):
        got = [tuple(sorted(r)) for r in variants.near(df, parts).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_against_plain_version(spark):
    rng = random.Random(7)
    base = ["garden", "gardens", "gardenx", "Über" + "setzung", "naïveté", "abc"]
    docs = []
    for i in range(300):
        text = " ".join(rng.choices(base, [60, 12, 2, 20, 8, 4], k=20))
        docs.append((i, rng.choice([text, text.upper(), text.replace(" ", "\n1_"), text + " gardén"])))
    docs += [(None, "garden gardens"), (3, None), (4, ""), (5, "garden " * 5000), (5, "garden " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    want = plain(docs)
    assert len(want) > 5 and any(v[0] for v in want.values())
    assert rows_of(variants.group(df)) == want
    assert rows_of(variants.group(df.repartition(7))) == want


def test_forms_chain_to_the_last_and_ties_take_the_smallest(spark):
    counts = {"aaaaaaaa": 1, "aaaaaaab": 5, "aaaaaabb": 25, "aaaaabbb": 125, "aaaabbbb": 625, "zaaaabbbb": 625, "laaaab": 3}
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(variants.group(df, every=1 << 40, least_count=1))
    assert got["aaaaaaaa"] == ("aaaaaaab", "aaaabbbb", 1, 1, 5)
    assert got["aaaaabbb"][:2] == ("aaaabbbb", "aaaabbbb") and got["aaaabbbb"][0] is None
    assert got["laaaab"] == (None, "laaaab", 3, 0, None)
    assert got == plain(docs, every=1 << 40, least_count=1)
    tie = spark.createDataFrame([(1, "tested " * 5 + "testeb " * 5 + "testea " + "testec")], "doc_id long, text string")
    assert rows_of(variants.group(tie, every=1 << 40, least_count=1))["testea"][0] == "testeb"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(df).count() == 0
    assert variants.near(spark.createDataFrame([], "word string")).count() == 0
