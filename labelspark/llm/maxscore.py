"""Exact top-k search by MaxScore over integer term weights.

Rows are sparse vectors (term, weight); the score of a query and a row is the sum
of the products of their weights.  Rows are dealt to shards, queries to blocks;
a task holds one shard as posting lists and answers one block of queries:

1. A term's bound for a query is the largest product that any posting of the
   shard can give, or zero.  Terms are ordered by their bounds.
2. While the bounds of the weakest terms together stay below the score of the
   kth row so far, these terms are *non-essential*: a row that is in none of the
   other lists can't come in.  The essential lists are traversed.
3. The rows found there are probed in the non-essential lists, strongest first,
   as long as their score so far and the bounds left reach the kth score.

Each shard gives its best k rows for each query; a rank over the shards gives the
result.  Rows equal to the kth score stay in, so ties are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.shared import keep

#: Postings of a shard and weights of a block of queries (mean sizes).
SHARD_POSTINGS, BLOCK_WEIGHTS = 1 << 19, 1 << 16
#: Rows of a shard that are searched at a time; the kth score rises in between.
_STEP = 4096
#: Wide lists that are probed before rows are given up.
_PROBED = 4
#: Weights beyond this are held at it: sums of up to 2^13 products stay exact.
LARGEST = 1 << 25


def whole_parts(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; null if the vector is null
    or has a null or non-finite component.  Held at -LARGEST and LARGEST."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))), F.lit(LARGEST)), F.lit(-LARGEST)))
    return F.when(fine, held.cast("array<bigint>"))


class Shard:
    """Posting lists of a shard's rows; rows are numbered by ascending id.  Lists
    that hold at least a quarter of the rows are kept as whole columns, which
    takes at most four times their postings: those of a step of rows are traversed
    for all queries of a block by one matrix product."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, terms: np.ndarray, weights: np.ndarray, largest: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        rows = np.repeat(place, counts)
        some = weights != 0
        rows, terms, weights = rows[some], terms[some], weights[some]
        by = np.lexsort((rows, terms))
        self.ids, self.rows, self.weights = ids[order], rows[by], weights[by]
        self.names, self.start = np.unique(terms[by], return_index=True)
        self.end = np.append(self.start[1:], len(by))
        empty = np.empty(0, np.int64)
        self.most = np.maximum.reduceat(self.weights, self.start) if len(by) else empty
        self.least = np.minimum.reduceat(self.weights, self.start) if len(by) else empty
        wide = 4 * (self.end - self.start) >= len(ids)
        self.column = np.where(wide, np.cumsum(wide) - 1, -1)
        # doubles hold the sums exactly up to 2^53 (``largest``: of the queries' weights)
        most = int(np.abs(self.weights).max(initial=0)) * largest * max(1, len(self.names))
        self.columns = np.zeros((int(wide.sum()), len(ids)), np.float64 if most < 1 << 53 else np.int64)
        for t in np.flatnonzero(wide):
            s, e = self.start[t], self.end[t]
            self.columns[self.column[t], self.rows[s:e]] = self.weights[s:e]

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A query's lists by falling bound, its weights, and the sum of the bounds
        from each list on."""
        at = np.searchsorted(self.names, terms)
        there = (at < len(self.names)) & (weights != 0)
        there[there] = self.names[at[there]] == terms[there]
        at, q = at[there], weights[there]
        bounds = np.maximum(0, np.maximum(q * self.most[at], q * self.least[at]))
        strong = np.argsort(-bounds, kind="stable")
        return at[strong], q[strong], np.append(np.cumsum(bounds[strong][::-1])[::-1], 0)

    def postings(self, t: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (from ``lo``) and weights of a list between two rows."""
        rows = self.rows[self.start[t] : self.end[t]]
        s, e = self.start[t] + np.searchsorted(rows, (lo, hi))
        return self.rows[s:e] - lo, self.weights[s:e]

    def search(self, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (id, terms, weights) the ids and scores of the best ``k``
        rows but its own; ties go to the smaller id."""
        plans = [self.lists(terms, weights) for _, terms, weights in queries]
        none = np.empty(0, np.int64)
        tops = [(none, none)] * len(queries)
        for lo in range(0, len(self.ids), _STEP):
            hi = min(lo + _STEP, len(self.ids))
            wide, essential = np.zeros((len(queries), len(self.columns)), self.columns.dtype), []
            for j, (at, q, left) in enumerate(plans):
                # lists from here on: together they can't lift a row to the kth score
                n = int(np.count_nonzero(left[:-1] >= tops[j][1][-1])) if len(tops[j][1]) >= k else len(at)
                columns = self.column[at[:n]]
                wide[j, columns[columns >= 0]] = q[:n][columns >= 0]
                essential.append(n)
            sums = wide @ self.columns[:, lo:hi]
            for j, (query_id, _, _) in enumerate(queries):
                kth = tops[j][1][-1] if len(tops[j][1]) >= k else None
                found = self._found(sums[j], lo, hi, *plans[j], essential[j], kth)
                if len(found[0]):
                    tops[j] = _best(*tops[j], *found, query_id, k)
        return tops

    def _found(self, sums: np.ndarray, lo: int, hi: int, at, q, left, essential: int, kth) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the rows of a step that reach the kth score; ``sums``
        has what the wide ones among the essential lists gave."""
        for t, w in zip(at[:essential], q[:essential]):
            if self.column[t] < 0:
                rows, weights = self.postings(t, lo, hi)
                sums[rows] += w * weights
        # a row in no essential list has a sum of 0 and is passed over unless the kth score is no higher
        rows = np.flatnonzero(sums >= kth - left[essential]) if kth is not None else np.arange(hi - lo)
        j = essential
        while j < len(at) and len(rows):
            columns = self.column[at[j : j + _PROBED]]
            if columns.min() >= 0:  # a few wide lists at a time
                sums[rows] += q[j : j + _PROBED] @ self.columns[np.ix_(columns, lo + rows)]
                j += len(columns)
            else:
                post, weights = self.postings(at[j], lo, hi)
                spot = np.searchsorted(post, rows)
                hit = spot < len(post)
                hit[hit] = post[spot[hit]] == rows[hit]
                sums[rows[hit]] += q[j] * weights[spot[hit]]
                j += 1
            if kth is not None:
                rows = rows[sums[rows] + left[j] >= kth]
        return self.ids[lo + rows], sums[rows].astype(np.int64)


def _best(ids_a, scores_a, ids_b, scores_b, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    other = ids_b != query_id
    ids, scores = np.concatenate((ids_a, ids_b[other])), np.concatenate((scores_a, scores_b[other]))
    if len(ids) > 4 * k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """ids, number of terms of each row, all terms, all weights."""
    t = table.combine_chunks()

    def whole(name: str) -> pa.Array:
        c = t.column(name)
        return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    terms, weights = whole("terms"), whole("weights")
    counts = np.asarray(pc.list_value_length(terms)).astype(np.int64)
    return (np.asarray(whole("id")).astype(np.int64), counts, np.asarray(terms.flatten()).astype(np.int64),
            np.asarray(weights.flatten()).astype(np.int64))


def _answer(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, counts, terms, weights = _columns(queries)
        shard = Shard(*_columns(rows), largest=int(np.abs(weights).max(initial=0)))
        ends = np.cumsum(counts)
        block = [(int(i), terms[e - n : e], weights[e - n : e]) for i, n, e in zip(ids, counts, ends)]
        out = [(i, *top) for (i, _, _), top in zip(block, shard.search(block, k))]
        return pa.table({"query_id": np.concatenate([np.full(len(g), i, np.int64) for i, g, _ in out]),
                         "id": np.concatenate([g for _, g, _ in out]), "score": np.concatenate([s for _, _, s in out])}, schema=schema)

    return run


def search(rows: DataFrame, queries: DataFrame, k: int, shard_postings: int = SHARD_POSTINGS,
           block_weights: int = BLOCK_WEIGHTS) -> DataFrame:
    """The ``k`` best rows for each query: ``query_id``, ``rank`` (from 1), ``id``, ``score``.

    ``rows`` and ``queries`` have ``id`` (long, distinct in each), ``terms``
    (array<int>, distinct in a row) and ``weights`` (array<bigint>, of the same
    length).  A row with the query's own id is no answer to it.  Equal scores rank
    by ascending id; all other rows are answers if they are fewer than ``k``,
    those with a score of zero or less included."""
    def blocks(df: DataFrame, of: int) -> int:
        return max(1, -(-(df.agg(F.sum(F.size("terms") + F.lit(1))).first()[0] or 0) // of))

    shards, parts = blocks(rows, shard_postings), blocks(queries, block_weights)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.select("id", "terms", "weights", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), every.alias(other))

    left = dealt(rows, "shard", shards, "block", parts).groupBy("shard", "block")
    right = dealt(queries, "block", parts, "shard", shards).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(_answer(k), "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, k: int, every: int, vec_id: str = "vec_id", embedding: str = "embedding",
            scale: int = 64, **sizes: int) -> DataFrame:
    """The ``k`` rows of largest integer inner product for each row whose id is
    divisible by ``every``: ``query_id``, ``rank``, the id column, ``score``.

    Components are turned into floor(``scale`` * x) (held at 2^25 in magnitude);
    of vectors of different lengths the rest counts as zeros.  A row with a null
    id, a null vector or one with null or non-finite components takes no part.
    Rows that share an id are one row, with the smallest of their vectors.  An
    empty table gives no rows; other columns are not read."""
    whole = vectors.select(F.col(vec_id).cast("long").alias("id"), whole_parts(F.col(embedding), scale).alias("v"))
    whole = whole.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    at = F.filter(F.transform("v", lambda x, i: F.struct(i.cast("int").alias("t"), x.alias("w"))), lambda s: s["w"] != 0)
    rows = keep(whole.select("id", at.alias("s")).select("id", F.col("s.t").alias("terms"), F.col("s.w").alias("weights")))
    out = search(rows, rows.where(F.col("id") % every == 0), k, **sizes)
    return out.withColumnRenamed("id", vec_id)
