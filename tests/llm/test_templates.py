"""Template windows against a plain Python version and by example."""

import re
from collections import defaultdict

from labelspark.llm import templates


def canon(text):
    out, before = [], None
    for line in (text or "").split("\n"):
        start = True
        for w in re.split(r"[ \t\x0b\f\r]+", line):
            if not w:
                continue
            core = w.strip(templates.PUNCT) or w
            inside = before is not None and not start and before[-1] not in ".!?:"
            low = core.lower()
            if re.fullmatch(r"[0-9]+([.,:/-][0-9]+)*", core):
                c = templates.NUM
            elif low in templates.UNITS:
                c = templates.UNIT
            elif inside and len(core) > 1 and core[0] != core[0].lower() and core[0] + low[1:] == core:
                c = templates.NAME
            else:
                c = low
            out.append((c, low))
            before, start = w, False
    return out


def windows(text):
    c = canon(text)
    n = max(1, len(c) - 4)
    return [c[i : i + 5] for i in range(n)] if c else []


def brute(docs, items):
    found = set()
    at = defaultdict(list)
    for b, t in items:
        for i, w in enumerate(windows(t)):
            at[tuple(x for x, _ in w)].append((b, i, w))
    total = {b: len({tuple(x for x, _ in w) for w in windows(t)}) for b, t in items}
    for d, t in docs:
        lines = defaultdict(lambda: (set(), set()))
        for p, w in enumerate(windows(t)):
            key = tuple(x for x, _ in w)
            for b, i, iw in at.get(key, ()):
                keys, pairs = lines[b, p - i]
                keys.add(key)
                pairs.update((x[1], y[1]) for x, y in zip(iw, w) if x[0] in (templates.NUM, templates.UNIT, templates.NAME))
        good = defaultdict(set)
        for (b, _), (keys, pairs) in lines.items():
            if len({x for x, _ in pairs}) == len(pairs):
                good[b] |= keys
        found |= {(d, b, len(k)) for b, k in good.items() if len(k) / total[b] >= 0.8}
    return found


ITEMS = [
    (1, "Anna has 12 apples and buys 12 pears for 30 cents. How many fruits does Anna have now?"),
    (2, "what is the capital of the large country in the north"),
    (3, "two words"), (4, None), (5, ""),
]
Q = "He said that {0} has {1} apples and buys {2} pears for {3} {4}. How many fruits does {0} have now? Bye."
DOCS = [
    (1, Q.format("Anna", 12, 12, 30, "cents")),
    (2, "so " + Q.format("Peter", 15, 15, "4.5", "dollars")),  # re-parameterised
    (3, Q.format("Peter", 15, 16, 4, "dollars")),  # 12 became 15 and 16
    (4, "Foo\nwhat is the capital of the large country in the north pole"),
    (5, "what is the capital of the small country in the north"),
    (6, "two words"), (7, "two words more"), (8, None), (9, ""), (10, "12"),
    (11, "clean text about apples and pears " * 30), (None, "two words"),
]


def test_examples_and_plain_version(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS b")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "2 AS d")
    got = {(r["doc_id"], r["item_id"], r["n_matched"]) for r in templates.leaks(docs, items).collect()}
    assert got == brute([d for d in DOCS if d[0] is not None], [i for i in ITEMS if i[1]])
    assert {(d, b) for d, b, _ in got} == {(1, 1), (2, 1), (4, 2), (6, 3)}
    kept = sorted(r["doc_id"] or 0 for r in templates.decontaminate(docs, items).collect())
    assert kept == [0, 3, 5, 7, 8, 9, 10, 11]
    assert templates.leaks(docs.limit(0), items).count() == 0
    assert templates.leaks(docs, items.limit(0)).count() == 0


def test_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(tuple, templates.leaks(docs, items).collect()))
    monkeypatch.setattr(templates, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, templates.leaks(docs, items).collect())) == want


def test_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"], r["n_matched"]) for r in templates.leaks(docs, items).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and len(got) > 10
