"""Ranked lexical search, term at a time with limited accumulators.

One pass over the texts counts the items' terms in each document; these postings
are written once.  Then every task takes its documents in shards:

1. An item's terms are processed rarest first.  A term's bound is its weight
   times its largest term-frequency part among the shard's postings.
2. As long as the bounds of the terms left reach the kth best sum so far, a
   posting of a new document makes an accumulator.  From then on it can't come in,
   and no more accumulators are made.
3. The documents that have one are updated to the end, so their scores are exact.

The kth score is carried on from shard to shard; each task gives its best k
documents for each item and a rank over the tasks gives the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.shared import keep, values

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Distinct (item, term) pairs of the items that one pass answers (mean size).
BLOCK_PAIRS = 1 << 18
#: Postings of a shard.
SHARD_POSTINGS = 1 << 20


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of letters, digits and all characters beyond ASCII, with A-Z
    lower-cased; null has none."""
    if not text:
        return []
    # bytes.lower() changes A-Z only
    return _TERM.findall(text.encode().lower().decode())


def _item_terms(batches):
    for batch in batches:
        items, terms = [], []
        for i, text in zip(batch.column("item").to_pylist(), values(batch.column("text"))):
            got = dict.fromkeys(terms_of(text))
            items += [i] * len(got)
            terms += got
        yield pa.RecordBatch.from_arrays([pa.array(items, batch.schema.field("item").type), pa.array(terms, pa.string())], names=["item", "term"])


def _postings(vocabulary: list[str]):
    """Task function: a document's number of terms and its counts of the items' terms."""

    def run(batches):
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            ns, ids, counts = [], [], []
            for text in values(batch.column("text")):
                got = terms_of(text)
                found = Counter([number[t] for t in got if t in number])
                ns.append(len(got))
                ids.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ns, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "tfs"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Posting lists with the term-frequency parts of the score."""

    def __init__(self, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int):
        rows = np.repeat(np.arange(len(m)), counts)
        by = np.argsort(terms, kind="stable")
        self.size, self.rows = len(m), rows[by]
        tf = tfs[by]
        self.parts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.rows])
        self.start = np.searchsorted(terms[by], np.arange(n_terms + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, kth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (and scores) that may be among the best ``k`` given ``kth`` (0: none
        yet): terms are given rarest first."""
        lists = [(self.rows[s:e], w * self.parts[s:e]) for t, w in zip(terms, weights)
                 for s, e in [(self.start[t], self.start[t + 1])] if s < e]
        left = np.append(np.cumsum([int(p.max()) for _, p in lists][::-1])[::-1], 0).astype(np.int64)
        sums = np.zeros(self.size, np.int64)
        for j, (rows, parts) in enumerate(lists):
            if left[j] < kth:  # what is left can't lift a new document
                break
            sums[rows] += parts
            some = sums[sums > 0]
            if len(some) > k and some.max() > left[j + 1]:
                kth = max(kth, int(np.partition(some, len(some) - k)[len(some) - k]))
        else:
            j = len(lists)
        live = np.flatnonzero(sums)
        for i in range(j, len(lists)):
            live = live[sums[live] + left[i] >= kth]
            if not len(live):
                break
            rows, parts = lists[i]
            spot = np.searchsorted(rows, live)
            hit = spot < len(rows)
            hit[hit] = rows[spot[hit]] == live[hit]
            sums[live[hit]] += parts[spot[hit]]
        live = live[(sums[live] >= kth) & (sums[live] > 0)]
        return live, sums[live]


def _order(missing: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k: by score, then id, null ids last."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], missing[some], -scores[some]))[:k]]
    return np.lexsort((ids, missing, -scores))[:k]


def _searcher(items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, total: int, n_terms: int, k: int, shard_postings: int):
    """Task function: (place of the item, id, score) of the task's best documents."""

    def shards(batches):
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                held.append(part)
                size += len(part.column("terms").flatten()) + part.num_rows
                if size >= shard_postings:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        empty = (np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64))
        tops = [empty] * len(items)
        for t in shards(batches):
            ids = t.column("id").combine_chunks()
            missing = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            terms, tfs = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
            m = 50 + (50 * np.asarray(t.column("n")) * n_docs) // total
            counts = np.asarray(pc.list_value_length(terms)).astype(np.int64)
            shard = Shard(m, counts, np.asarray(terms.flatten()), np.asarray(tfs.flatten()), n_terms)
            for i, (of, weights) in enumerate(items):
                a, b, c = tops[i]
                rows, scores = shard.best(of, weights, k, int(c[-1]) if len(c) >= k else 0)
                if len(rows):
                    a, b, c = np.concatenate((a, missing[rows])), np.concatenate((b, ids[rows])), np.concatenate((c, scores))
                    at = _order(a, b, c, k)
                    tops[i] = a[at], b[at], c[at]
        places = np.repeat(np.arange(len(items)), [len(c) for _, _, c in tops])
        joined = [np.concatenate(x) for x in zip(empty, *tops)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int64()), pa.array(joined[1], pa.int64(), mask=joined[0]), pa.array(joined[2], pa.int64())],
            names=["place", "id", "score"])

    return run


def _ranked(rows: DataFrame, pairs: list, item_type: str, k: int, shard_postings: int) -> DataFrame:
    spark = rows.sparkSession
    vocabulary = sorted({r["term"] for r in pairs})
    posts = keep(rows.mapInArrow(_postings(vocabulary), "id bigint, n bigint, terms array<int>, tfs array<bigint>"))
    n_docs, total = posts.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    df = {r["t"]: r["df"] for r in posts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    number = {t: i for i, t in enumerate(vocabulary)}
    of: dict = {}
    for r in pairs:
        if number[r["term"]] in df:
            of.setdefault(r["item"], []).append(number[r["term"]])
    weights = {t: weight(n_docs, c) for t, c in df.items()}
    names, items = list(of), []
    for i in names:
        rarest = sorted(of[i], key=lambda t: (df[t], t))
        items.append((np.array(rarest, np.int64), np.array([weights[t] for t in rarest], np.int64)))
    found = posts.where(F.size("terms") > 0).mapInArrow(
        _searcher(items, n_docs, total or 1, len(vocabulary), k, shard_postings), "place bigint, id bigint, score bigint")
    known = spark.createDataFrame([(p, i) for p, i in enumerate(names)], f"place bigint, item {item_type}")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(F.broadcast(known), "place").select("item", "rank", "id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
         block_pairs: int = BLOCK_PAIRS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The ``k`` best documents for each item: the item's id, ``rank`` (from 1),
    the document's id (an integer), ``score``.

    Items with about ``block_pairs`` distinct (item, term) pairs are answered in
    one pass; there are as many passes as the items' terms need.  Items that share
    an id (null is one, too) are one item with the terms of all.  Every row of
    ``docs`` is a document, repeated rows and ids as well; equal scores rank by
    ascending id, null ids last.  Null and empty texts have no terms and are never
    found; texts of any length are read whole.  Items without terms that occur,
    and empty tables, give no rows.  Other columns are not read."""
    kind = dict(items.dtypes)[item_id]
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    own = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    pairs = keep(own.mapInArrow(_item_terms, f"item {kind}, term string").distinct())
    blocks = max(1, -(-pairs.count() // block_pairs))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    out = None
    for b in range(blocks):
        part = _ranked(rows, pairs.where(block == b).collect(), kind, k, shard_postings)
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
