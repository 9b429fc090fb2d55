"""Spelling variants of the corpus vocabulary by PartEnum signatures.

1. Words and their counts over all texts, counted in the tasks before the
   shuffle.
2. A word is the binary vector of its letter multiset: the elements are (letter,
   occurrence).  One inserted or deleted code point changes one element, one
   replaced code point two, so near words have a Hamming distance of one or two.
3. PartEnum: the elements are dealt to ``parts`` parts; two differences touch at
   most two of them, so near words agree on the rest for at least one choice of
   two parts.  Each choice gives a signature, a hash of the elements in all other
   parts.  Words meet by an equi-join of signature and length.
4. Within the join a pair has to share its first or its last half (one edit can't
   touch both) and is then verified by its edit distance: only near pairs leave
   the join, no bucket is spelled out.
5. A word's form is its near word of largest count, if that is large enough; the
   root follows the forms to the last by pointer doubling.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.shared import keep, values

#: Two differences between the vectors of near words.
DISTANCE = 2
PARTS = 6
#: Distinct words a task holds before it sends their counts on.
_HELD = 200_000
#: Runs ``[A-Za-z\\u00C0-\\u00FF]+`` in UTF-8, after A-Z were lower-cased.
_RUN = re.compile(rb"[a-z]+(?:\xc3[\x80-\xbf][a-z]*)*|(?:\xc3[\x80-\xbf][a-z]*)+")


def dropped(word: bytes, hashed: int, every: int) -> bytes:
    """The run without code point ``hashed % length`` if ``every`` divides ``hashed``."""
    if hashed % every:
        return word
    letters = word.decode()
    at = hashed % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counter(every: int, least_length: int):
    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(values(batch.column("id")), values(batch.column("text"))):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                # a code point has at least one byte, so shorter runs can't be long enough
                for w, n in Counter([w for w in _RUN.findall(text.encode().lower()) if len(w) >= least_length]).items():
                    w = dropped(w, zlib.crc32(w, start), every)
                    if len(w) >= least_length and (len(w) >= 2 * least_length or len(w.decode()) >= least_length):
                        held[w] += n
                if len(held) >= _HELD:
                    yield out()
                    held.clear()
        yield out()

    return run


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 199, least_length: int = 6,
          least_count: int = 5) -> DataFrame:
    """(``word``, ``n``): the letter runs of all texts that have at least
    ``least_length`` code points and occur ``least_count`` times.

    Runs are maximal, A-Z are lower-cased.  A run whose crc32 of ``<id>:<run>``
    is divisible by ``every`` loses one code point before it is counted.  Null
    and empty texts have no runs; a null id counts as the empty text; a repeated
    row counts each time."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_counter(every, least_length), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(vocabulary: DataFrame, most: int = 256) -> list[str]:
    """The up to ``most`` commonest code points of the words, commonest first."""
    each = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c != ''")
    found = each.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(most)
    return [r["c"] for r in found.collect()]


def _signer(order: list[str], parts: int):
    """Task function: a word's signatures and hashes of its halves."""
    import xxhash

    # common letters lie in different parts; a letter's next occurrence goes to the next part
    base = {c: (i % parts if (i // parts) % 2 == 0 else parts - 1 - i % parts) for i, c in enumerate(order)}
    choices = list(itertools.combinations(range(parts), DISTANCE))
    mask, element = (1 << 64) - 1, {}

    def hashed(text: str) -> int:
        return xxhash.xxh64_intdigest(text)

    def signatures(word: str) -> list[int]:
        seen: Counter = Counter()
        sums = [0] * parts
        for c in word:
            seen[c] += 1
            k = (c, seen[c])
            if k not in element:
                if len(element) > 100_000:
                    element.clear()
                element[k] = ((base.get(c, ord(c)) + seen[c] - 1) % parts, hashed(f"{c}{seen[c]}"))
            part, h = element[k]
            sums[part] += h
        total = sum(sums)
        # the choice of parts is a part of the signature
        return [xxhash.xxh64_intdigest((((total - sum(sums[p] for p in drop)) & mask).to_bytes(8, "little")), seed=s) - (1 << 63)
                for s, drop in enumerate(choices)]

    def halves(word: str, n: int) -> int:
        return ((hashed(word[:n]) >> 33) << 32 | hashed(word[len(word) - n :]) >> 32)

    def run(batches):
        for batch in batches:
            got = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array([len(w) for w in got], pa.int32()),
                 pa.array([signatures(w) for w in got], pa.list_(pa.int64())),
                 pa.array([halves(w, len(w) // 2) for w in got], pa.int64()),
                 pa.array([halves(w, (len(w) - 1) // 2) for w in got], pa.int64())],
                names=["word", "size", "signatures", "even", "longer"])

    return run


def near(vocabulary: DataFrame, parts: int = PARTS) -> DataFrame:
    """(``a``, ``b``): distinct pairs of words that differ by exactly one
    inserted, deleted or replaced code point, each pair once.

    ``vocabulary`` has distinct non-empty words in a column ``word`` (null words
    are left out); other columns are not read.  ``parts`` over two: more parts
    make signatures that fewer words share, and more of them."""
    if parts <= DISTANCE:
        raise ValueError("parts must be more than the distance of near words")
    rows = vocabulary.where("word != ''").select("word")
    schema = "word string, size int, signatures array<bigint>, even bigint, longer bigint"
    signed = keep(rows.mapInArrow(_signer(letters(rows), parts), schema))

    def side(length, half: str, name: str) -> DataFrame:
        return signed.select(F.explode("signatures").alias("s"), length.alias("size"), F.col("word").alias(name), F.col(half).alias(f"half_{name}"))

    left = side(F.col("size"), "even", "a").select(F.xxhash64("s", "size").alias("key"), "a", "half_a")
    same = side(F.col("size"), "even", "b").withColumn("longer", F.lit(False))
    longer = side(F.col("size") - 1, "longer", "b").withColumn("longer", F.lit(True))
    right = same.unionAll(longer).select(F.xxhash64("s", "size").alias("key"), "b", "half_b", "longer")
    apart = F.col("half_a").bitwiseXOR(F.col("half_b"))
    half = (F.shiftright(apart, 32) == 0) | (apart.bitwiseAND(F.lit((1 << 32) - 1)) == 0)
    fits = half & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, "key").where(fits).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``) for rows (``word``, ``form``) without circles: the
    form's form and so on to the last.  Paths double in length each round."""
    at = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = keep(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return at


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 199, least_length: int = 6,
          least_count: int = 5, factor: int = 5, parts: int = PARTS) -> DataFrame:
    """One row for each word of :func:`words`, with its spelling form.

    Columns: ``word``, ``form`` (of the words one edit away the one of largest
    count, among equals the first in code-point order, if its count is at least
    ``factor`` times the word's; else null), ``root`` (from the word along the
    forms to the last, the word itself if it has none), ``n`` (the word's count),
    ``n_near`` (number of words one edit away) and ``form_n`` (the form's count).
    An empty table gives no rows.  Texts of any length are read whole; other
    columns are not read; ids may repeat."""
    vocabulary = keep(words(docs, doc_id, text, every, least_length, least_count))
    pairs = keep(near(vocabulary, parts))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counts = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    large = -F.col("best.minus") >= factor * F.col("n")
    known = keep(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n")))
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
