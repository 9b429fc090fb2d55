"""Suffix removal against brute force over all byte windows."""

import hashlib
import random

import pytest

from labelspark.llm import suffixes
from pyspark.sql import functions as F


def brute(texts, n):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for b in bodies:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(b), sum(gone), len(spans), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    def words(k):
        return " ".join(r.choice(["alpha", "bé", "c", "delta", "ö", "eps"]) + str(r.randrange(40)) for _ in range(k))
    shared = [words(12), words(30), "ab" * 60, "x" * 90]
    out = [None, "", "short", words(400)]
    for _ in range(n):
        parts = [words(r.randrange(1, 40)) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(shared)[r.randrange(8):])
        out.append(r.choice(["", " "]).join(parts))
    return out + out[5:9] + [out[6]] * 20


@pytest.mark.parametrize("n", [9, 40, 60])
def test_matches_brute_force(spark, n):
    texts = corpus(n, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("batch", F_lit())
    got = {r["doc_id"]: r for r in suffixes.repeats(df, n).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, (size, removed, spans, kept) in enumerate(brute(texts, n)):
        g = got[i]
        assert (g["n_bytes"], g["n_removed"], len(g["spans"]), bytes(g["kept"])) == (size, removed, spans, kept), i


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert suffixes.repeats(spark.createDataFrame([], schema), 20).count() == 0
    rows = [(None, "z" * 10 + "q" * 25), (1, "hello there, whole text"), (1, "hello there, whole text")]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.repeats(spark.createDataFrame(rows, schema), 20).collect())
    assert got == [(0, 25), (1, 23), (1, 23)]


@pytest.mark.parametrize("q", [2, 3, 5, 17])
def test_difference_cover(q):
    v, d = suffixes.difference_cover(q)
    assert len(d) == q + 1 and {(x - y) % v for x in d for y in d} == set(range(v))


def test_window_hashes_across_blocks(monkeypatch):
    import numpy as np

    body = np.frombuffer(hashlib.sha256(b"x").digest() * 8, np.uint8)
    whole = np.concatenate([h for _, h in suffixes.window_hashes(body, 10)])
    monkeypatch.setattr(suffixes, "BLOCK", 16)
    parts = np.concatenate([h for _, h in suffixes.window_hashes(body, 10)])
    assert (whole == parts).all() and len(set(whole.tolist())) == 32


def test_deduplicate_keeps_columns_and_nulls(spark):
    rows = [(1, "é" * 30 + "abcdefghij" * 3, "x", 5), (2, "ü" + "abcdefghij" * 3, "y", None), (3, None, None, 7), (4, "tiny", "z", 8)]
    df = spark.createDataFrame(rows, "id long, text string, rest string, batch int")
    got = {r["id"]: tuple(r) for r in suffixes.deduplicate(df, 20, doc_id="id").collect()}
    assert got == {1: (1, "", "x", 5), 2: (2, "ü", "y", None), 3: (3, None, None, 7), 4: (4, "tiny", "z", 8)}


def test_copies_of_one_row_spread_over_batches(spark):
    from labelspark.llm import exchange

    df = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 1000).alias("text"), F.lit("e").alias("batch"))
    df = df.unionAll(spark.createDataFrame([(2, "y" * 5000, "e"), (3, None, "e")], "doc_id long, text string, batch string"))
    rows, _ = exchange.batched(df, "doc_id", "text", 20_000)
    sizes = {r["batch"]: r["count"] for r in rows.groupBy("batch").count().collect()}
    assert sum(sizes.values()) == 402 and len(sizes) > 10 and max(sizes.values()) < 120


def test_query_cuts_planted_passages_from_400_bytes_on(spark, tmp_path):
    """The bound of the query is bytes, whatever words they hold; ``n_bytes`` is the size before removal."""
    from labelspark.llm import queries

    r = random.Random(4)
    def text(n):
        return "".join(r.choice("abcdefgh ") for _ in range(n))
    short = " ".join(r.choice(["the", "erethe", "onhaly", "ed", "thtion"]) + str(k) for k in range(51))
    passages = [short, text(399), text(400), text(900)]
    assert len(short) < 400
    rows, size = [], {}
    for k, p in enumerate(passages):
        for copy in (0, 1):  # other letters at both ends: the common string is the passage
            rows.append((10 * k + copy, text(300 + 50 * copy) + "XY"[copy] + p + "VW"[copy] + text(200)))
            size[rows[-1][0]] = len(rows[-1][1])
    rows.append((99, text(3000)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: x["n_bytes"] for i, x in got.items()} == size | {99: 3000}
    assert {i: (x["n_removed"], x["n_spans"]) for i, x in got.items()} == {
        0: (0, 0), 1: (0, 0), 10: (0, 0), 11: (0, 0), 20: (400, 1), 21: (400, 1), 30: (900, 1), 31: (900, 1), 99: (0, 0)}
    for i, t in rows:
        cut = passages[i // 10] if i in (20, 21, 30, 31) else ""
        assert got[i]["kept_sha256"] == hashlib.sha256(t.replace(cut, "").encode()).hexdigest()


def phases(batches, n, cells=2):
    """The four phases on lists of texts, in this process: rows of the last one."""
    import pyarrow as pa

    def table(k, texts):
        return pa.table({"batch": pa.array([k] * len(texts), pa.int32()), "id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})

    answers = pa.table({"batch": pa.array([], pa.int32()), "phase": pa.array([], pa.int32()), "cell": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
    for phase in range(4):
        run, out = suffixes._phase(phase, n, cells), []
        for k, texts in enumerate(batches):
            mine = answers.filter(pa.array([b == k for b in answers["batch"].to_pylist()], pa.bool_()))
            out.append(run(table(k, texts), mine) if phase else run(table(k, texts)))
        if phase == 3:
            return [r for t in out for r in t.to_pylist()]
        sent = pa.concat_tables(out)
        at = sent["cell"].to_pylist()
        cell = [sent.filter(pa.array([c == x for c in at])) for x in sorted(set(at))]
        answers = pa.concat_tables([answers, *map(suffixes._sort_cell(phase), cell)])


def test_only_samples_and_candidates_are_hashed(monkeypatch):
    r = random.Random(8)
    def text(n):
        return "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(400)
    first = [text(3000) for _ in range(20)] + [text(699) + "Z" + passage, passage + text(500), "", text(3000) + passage[1:]]
    second = [text(3000) for _ in range(20)] + [first[3], text(450) + passage + text(5), text(399)]
    hashed, mix = [], suffixes.mix
    monkeypatch.setattr(suffixes, "BLOCK", 512)  # passages across blocks, texts across blocks
    monkeypatch.setattr(suffixes, "mix", lambda x: hashed.append(len(x)) or mix(x))
    got = phases([first, second], 400)
    assert [(g["n_bytes"], g["n_removed"], len(g["spans"]), g["kept"]) for g in got] == brute(first + second, 400)
    assert [g["spans"] for g in got[20:22]] == [[{"start": 700, "end": 1100}], [{"start": 0, "end": 400}]]
    # three phases hash the samples, 18 in 307 positions; once all positions, eight times
    assert sum(hashed) < 0.4 * sum(map(len, first + second))


def test_equal_keys_of_other_checks_are_told_apart():
    import numpy as np
    import pyarrow as pa
    from labelspark.llm import exchange

    keys = np.array([1 << 20, 5 << 20], np.uint64)
    sent = [exchange.send(k, keys, np.array([check, 9], np.uint16), 1, drop=suffixes.SUFFIX_DROP) for k, check in enumerate((7, 3, 7))]
    back = suffixes._sort_cell(2)(pa.concat_tables([*sent, exchange.send(3, keys[:1] * np.uint64(3), np.zeros(1, np.uint16), 1)]))
    bits = {b: np.unpackbits(np.frombuffer(d, np.uint8)).tolist() for b, d in zip(back["batch"].to_pylist(), back["data"].to_pylist())}
    assert [bits[k][:2] for k in range(4)] == [[1, 1], [0, 1], [1, 1], [0, 0]]
