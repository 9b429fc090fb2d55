"""Licence scan on a small tree."""

from pyspark.sql import functions as F

from labelspark.llm import licences

GPL = "This work is licensed under the GNU General Public License, version 3."


def test_tree(spark):
    long_line = " ".join(f"w{i}" for i in range(100)) + " Released under the MIT License. " + " ".join(f"v{i}" for i in range(70))
    files = [
        (1, "LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/x.py", "plain text\nno notice"),
        (3, "a/b/COPYING", GPL + "\nmore words here"),
        (4, "a/b/c/d/y.txt", None),
        (5, "a/b/c/z.txt", "All rights reserved.\n" + "word " * 50),
        (6, "a/b/c/w.txt", ""),
        (7, "other/q.txt", long_line),
        (8, None, "nothing"),
        (9, "a/b/c/v.txt", "this license text is about versions of a work"),
    ]
    df = spark.createDataFrame(files, "fid long, p string, text string").withColumn("own", F.lit("clash"))
    got = {r["fid"]: (r["own"], r["licence"], r["inherited_from"]) for r in licences.scan(df, "fid", F.col("p")).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "Apache-2.0", ""), 3: ("GPL-3.0", "GPL-3.0", None),
        4: (None, "GPL-3.0", "a/b"), 5: ("proprietary", "proprietary", None), 6: (None, "GPL-3.0", "a/b"),
        7: ("MIT", "MIT", None), 8: (None, "Apache-2.0", ""), 9: (None, "GPL-3.0", "a/b")}


def test_empty_and_unlicensed(spark):
    schema = "fid long, p string, text string"
    assert licences.scan(spark.createDataFrame([], schema), "fid", F.col("p")).count() == 0
    row = licences.scan(spark.createDataFrame([(1, "a/b", "text"), (1, "a/b", "text")], schema), "fid", F.col("p")).collect()
    assert [(r["licence"], r["cosine"]) for r in row] == [(None, 0.0)] * 2


def test_documents_with_a_notice_line(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = {r["doc_id"]: r["own"] for r in licences.scan(docs, "doc_id", path).collect()}
    notices = {"GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "proprietary", "CC BY-NC 4.0.": "CC-BY-NC-4.0",
               "MIT License.": "MIT", "Apache License, Version 2.0.": "Apache-2.0"}
    for r in docs.collect():
        want = {x for line in r["text"].split("\n") for k, x in notices.items() if line.endswith(k)}
        assert found[r["doc_id"]] in want if want else found[r["doc_id"]] is None


def test_cues_lose_nothing():
    m = licences.Matcher(licences.TEMPLATES, {"the": 90, "license": 5, "this work": 3}, 100)
    cues = set(m.cues(0.7))
    for k, v in enumerate(m.vectors):
        left = {t: w for t, w in v.items() if cues.isdisjoint(t.split())}
        assert sum(w * w for w in left.values()) < 0.49
    words = licences._TERM.findall("this work is licensed under the gnu general public license, version 3.")
    assert m.best(words)[1] == "GPL-3.0" and m.best(words)[0] > 0.99


def test_notice_anywhere_in_a_text_at_any_table_size():
    lines = {
        "Code released under the MIT License.": "MIT", "This project is released under the MIT License.": "MIT",
        "# Licensed under the Apache License, Version 2.0; see the file": "Apache-2.0",
        "// This work is licensed under the GNU General\n// Public License, version 3.\nint x;": "GPL-3.0",
        " ".join(f"w{i}" for i in range(100)) + " Released under the MIT License. " + " ".join(f"v{i}" for i in range(70)): "MIT",
        "Licensed under the Foo License": None, "Some rights reserved": None, "this license text is about versions of a work": None}
    df = {"the": 90, "under": 60, "license": 5, "released": 4, "licensed": 3, "mit": 2, "under the": 50, "all": 40, "work": 30}
    for scale in (1, 100, 10_000):
        m = licences.Matcher(licences.TEMPLATES, {t: n * scale for t, n in df.items()}, 100 * scale)
        got = {line: m.best(licences._TERM.findall(line.lower())) for line in lines}
        assert {line: g and g[1] for line, g in got.items()} == lines


def test_segments_against_every_window():
    m = licences.Matcher({"A": ["one two three"], "B": ["two two four five"]}, {"one": 3, "two": 50}, 100)
    words = "x one two three two two y four five one two z three".split()

    def cosine(window, v):
        terms = licences.segment_terms(window)
        w = {t: f * m.idf(t) for t, f in terms.items()}
        return sum(w[t] * v.get(t, 0.0) for t in w) / sum(x * x for x in w.values()) ** 0.5

    want = {(round(c, 9), name, s, e) for v, name, n in zip(m.vectors, m.names, m.lengths)
            for s in range(len(words)) for e in range(s + n, min(len(words), s + licences.longest(n)) + 1)
            if (c := cosine(words[s:e], v)) >= 0.5}
    got = [(round(c, 9), *x) for c, *x in m.close(words, 0.5)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3


def test_tags_short_forms_and_negation(spark):
    lines = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "Released under the BSD 2-Clause License.": "BSD-2-Clause",
        "Released under the BSD 3-Clause License.": "BSD-3-Clause", "Licensed under the GPLv3.": "GPL-3.0",
        "Distributed under the terms of the MIT licence": "MIT", "Released under the ISC License": "ISC",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Licensed under the Eclipse Public License 2.0": "EPL-2.0", "This software is not licensed under the MIT License.": None,
        "It isn't released under the MIT License.": None, "Licensed under the Foo License": None, "the mit campus": None,
        "Not all is well. " + "word " * 8 + "Released under the MIT License.": "MIT", "x " * 50_000 + "Licensed under the MIT License.": "MIT"}
    df = spark.createDataFrame([(i, f"d{i}/f.txt", t) for i, t in enumerate(lines)], "fid long, p string, text string")
    got = {r["fid"]: r["own"] for r in licences.scan(df, "fid", F.col("p")).collect()}
    assert {t: got[i] for i, t in enumerate(lines)} == lines


def test_plain_document_with_a_notice_gives_its_siblings_nothing(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    files = [(1, "a/x.txt", "a few words. " + notice), (2, "a/y.txt", "plain"), (3, "b/any.txt", " ".join(licences.TEMPLATES["Apache-2.0"])), (4, "b/z.txt", "plain")]
    got = {r["fid"]: r["licence"] for r in licences.scan(spark.createDataFrame(files, "fid long, p string, text string"), "fid", F.col("p")).collect()}
    assert got == {1: "GPL-3.0", 2: None, 3: "Apache-2.0", 4: "Apache-2.0"}
