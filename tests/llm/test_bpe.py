"""BPE against the tokenizers library and the lexicon against its words."""

import hashlib
import random
import struct

import pytest

from labelspark.llm import bpe, lexicon

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


def ids_of(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_every_code_point(lib, own):
    bad = []
    # all of the first two planes; the others hold long runs of one kind
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 61)]):
        text = f"a{c}b {c} x"
        if lib.encode(text, add_special_tokens=False).ids != ids_of(own.encode(text, None)):
            bad.append(hex(ord(c)))
    assert bad == []


def test_fuzz_and_decoding(lib, own):
    r = random.Random(5)
    letters = list("aAbBsStTdD'' \t\n\x1c\x1f01.,!é́ΣσςİŒß中<|>") + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(5000)]
    texts += ["", "ab" * 3000, "the" * 2000 + "!" * 3000, "x" * 49, "x" * 48, "Hello WORLD's end́"]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t, None)
        assert ids_of(got) == want, t
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_lexicon_is_exact_and_shares_endings():
    r = random.Random(3)
    words = {bytes(r.choice(b"abc\xc3") for _ in range(r.randrange(1, 9))) for _ in range(3000)}
    entries = {w: [r.randrange(50000) for _ in range(r.randrange(4))] for w in words} | {b"": [7]}
    read = lexicon.mapped(lexicon.compile_lexicon(entries))
    for w, ids in entries.items():
        assert read.get(w) == struct.pack(f"<{len(ids)}I", *ids)
    for _ in range(3000):
        w = bytes(r.choice(b"abcd") for _ in range(r.randrange(10)))
        assert (read.get(w) is None) == (w not in entries)
    states, _ = lexicon._minimal_states(sorted([b"tested", b"rested", b"nested"]))
    assert len(states) == 7
    assert lexicon.Lexicon(lexicon.compile_lexicon({})).get(b"a") is None


def test_documents(spark, sf001, lib):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").withColumnRenamed("lang", "ids")
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (None, "<|endoftext|> I'll", "x")], "doc_id long, text string, ids string")
    rows = docs.select("doc_id", "text", "ids").unionAll(odd)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    got = bpe.round_trip(rows, PATH, words=500).collect()
    assert len(got) == len(texts)
    for r in got:
        want = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert hashlib.sha256(r["ids"]).digest() == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).digest()
        assert r["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(rows.limit(0), PATH).count() == 0
    again = bpe.decode(bpe.encode(rows, PATH, words=500), PATH, out="decoded").collect()
    assert {r["doc_id"]: r["decoded"] for r in again} == {r["doc_id"]: r["decoded"] for r in got}
