"""Exact top-k and threshold search over label vectors (H-3, H-4, D-3) that
writes no text x label pairs.

The labels of a shard are cut into blocks around pivots (farthest-first).  What
a label of a block can score at most follows from the pivot's score by the
triangle inequality: of angles for unit vectors, of distances otherwise.  A
text goes through the blocks by falling bound and stops at the first one that
can't reach its kth score or the threshold; only the rows found leave the task.

One shard is held by every task if it is small (rows and bytes are measured);
more labels are dealt to shards and met with blocks of texts by an equi-join,
and a rank over the shards gives the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import logit_scale
from .classify import MAX_MATRIX_BYTES, MAX_MATRIX_ROWS, prepare_label_side
from .prefix import top_k_per_group

#: Scores that agree to this many places are ties: the lower label id is first.
PLACES = 9
_SLACK = 1e-8
#: Texts of one step, and (text, label) scores that it may hold.
_TEXTS, _HELD = 4096, 1 << 18


class PivotIndex:
    """Blocks of label vectors around pivots; labels are in rank order of ties."""

    def __init__(self, vectors: np.ndarray, unit: bool, n_blocks: int | None = None):
        lengths = np.linalg.norm(vectors, axis=1)
        # a zero vector stays zero when it is normalised
        self.vectors, self.unit = vectors, unit and bool((np.abs(lengths - 1) < 1e-6).all())
        n = len(vectors)
        want = n_blocks or max(1, math.isqrt(n))
        pivots, near = [], np.full(n, np.inf)
        owner = np.zeros(n, int)
        at = 0
        while n and len(pivots) < want:
            distance = np.linalg.norm(vectors - vectors[at], axis=1)
            owner[distance < near] = len(pivots)
            near = np.minimum(near, distance)
            pivots.append(vectors[at])
            at = int(near.argmax())
            if near[at] == 0:
                break
        self.pivots = np.array(pivots).reshape(len(pivots), vectors.shape[1])
        self.blocks = [np.flatnonzero(owner == b) for b in range(len(pivots))]
        self.radius = np.array([near[m].max(initial=0.0) for m in self.blocks])
        # of unit vectors at this distance from the pivot
        self.angle = 2 * np.arcsin(np.minimum(self.radius / 2, 1.0))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The most that a label of each block can have as a product with each text."""
        p = x @ self.pivots.T
        if self.unit:
            apart = np.arccos(np.clip(p, -1.0, 1.0)) - self.angle
            return np.cos(np.clip(apart, 0.0, np.pi)) + _SLACK
        length = np.linalg.norm(x, axis=1)[:, None]
        return p + length * self.radius + _SLACK * (1.0 + length)

    def search(self, x: np.ndarray, k: int | None, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, label, product) of the best ``k`` labels of each text with a
        product of ``floor`` or more (all if ``k`` is None), and how many labels
        each text was compared with."""
        n, compared = len(x), np.zeros(len(x), np.int64)
        width = k or 0
        best = np.full((n, width), -np.inf)
        which = np.full((n, width), len(self.vectors))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        most = self.bounds(x)
        order = np.argsort(-most, axis=1, kind="stable")
        active = np.arange(n)
        for r in range(len(self.blocks)):
            b = order[active, r]
            least = np.maximum(best[active, -1], floor) if k else np.full(len(active), floor)
            go = most[active, b] >= least - _SLACK
            active, b = active[go], b[go]
            if not len(active):
                break
            for block in np.unique(b):
                rows, labels = active[b == block], self.blocks[block]
                s = x[rows] @ self.vectors[labels].T
                compared[rows] += len(labels)
                if k:
                    both = np.concatenate((best[rows], s), axis=1)
                    ids = np.concatenate((which[rows], np.broadcast_to(labels, s.shape)), axis=1)
                    top = np.lexsort((ids, -np.round(both, PLACES)), axis=1)[:, :k]
                    best[rows], which[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
                else:
                    i, j = np.nonzero(s >= floor - _SLACK)
                    found.append((rows[i], labels[j], s[i, j]))
        if k:
            i, j = np.nonzero((which < len(self.vectors)) & (best >= floor - _SLACK))
            return i, which[i, j], best[i, j], compared
        if not found:
            none = np.empty(0, int)
            return none, none, np.empty(0), compared
        i, j, s = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((j, -np.round(s, PLACES), i))
        return i[by], j[by], s[by], compared


def _floor(threshold: float | None, activation: str) -> float:
    if threshold is None:
        return -math.inf
    if activation == "none":
        return threshold
    if threshold <= 0:
        return -math.inf
    return math.inf if threshold >= 1 else math.log(threshold / (1 - threshold))


def _vectors(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow column of the commonest length (or ``dim``), and
    their rows; null vectors and ones with a null or non-finite component are
    left out."""
    rows = column.to_pylist()
    fine = [i for i, v in enumerate(rows) if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    if dim is None:
        sizes = [len(rows[i]) for i in fine]
        dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    at = np.array([i for i in fine if len(rows[i]) == dim], int)
    return np.array([rows[i] for i in at], float).reshape(len(at), dim), at


def _finder(schema, t_cols, l_cols, text_vec, label_vec, label_id, head, scale, bias, activation, k, threshold):
    """Function from an Arrow table of labels to one from tables of texts to rows."""
    import pyarrow as pa

    gain = logit_scale(scale) if head == "cosine" else 1.0
    shift = 0.0 if head == "cosine" else bias

    def over(labels):
        labels = labels.sort_by([(label_id, "ascending")]).combine_chunks()
        vectors, at = _vectors(labels.column(label_vec))
        index, side = PivotIndex(vectors, head == "cosine"), labels.select(l_cols).take(pa.array(at))
        floor = (_floor(threshold, activation) - shift) / gain
        step = max(1, min(_TEXTS, _HELD // max(1, k or len(vectors))))

        def rows_of(texts):
            for lo in range(0, texts.num_rows, step):
                part = texts.slice(lo, step)
                x, have = _vectors(part.column(text_vec), vectors.shape[1])
                if head == "cosine":
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                i, j, s, compared = index.search(x, k, floor)
                logit = s * gain + shift
                score = 1.0 / (1.0 + np.exp(-logit)) if activation == "sigmoid" else logit
                if threshold is not None:
                    over_t = score > threshold
                    i, j, logit, score = i[over_t], j[over_t], logit[over_t], score[over_t]
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1  # rows are grouped by text
                take, match = pa.array(have[i]), pa.array(j)
                columns = [part.column(c).take(take) for c in t_cols] + [side.column(c).take(match) for c in l_cols]
                columns += [pa.array(logit), pa.array(score), pa.array(rank, pa.int32()), pa.array(compared[i])]
                yield pa.Table.from_arrays(columns, names=schema.names)

        return rows_of

    return over


def find_labels(texts: DataFrame, labels: DataFrame, k: int | None = None, threshold: float | None = None,
                sample: str = "sample_id", label_id: str = "label_id", text_vec: str = "text_vec",
                label_vec: str = "label_vec", head: str = "cosine", scale: float = 2.0,
                weights: Sequence[float] | None = None, matrix: Sequence[Sequence[float]] | None = None,
                bias: float = 0.0, activation: str = "sigmoid", shard_rows: int = MAX_MATRIX_ROWS) -> DataFrame:
    """The best ``k`` labels of each text, those with a score over ``threshold``,
    or both: exactly what :func:`classify.score_pairs` and a filter of the ranks
    by logit give (scores of a sigmoid may be equal where logits still differ).

    Adds ``logit``, ``score``, ``rank`` (from 1; ties to the lower ``label_id``)
    and ``n_compared`` (how many labels of the row's shard the text was compared
    with, as a measure of the pruning).  Texts and labels without a vector of the
    labels' length, or with a null or non-finite component, are in no row.
    ``sample`` has to be distinct when the labels need more than one shard."""
    if k is None and threshold is None:
        raise ValueError("give k, threshold or both")
    if head not in ("cosine", "dot", "bilinear") or activation not in ("sigmoid", "none"):
        raise ValueError("head must be cosine, dot or bilinear; activation sigmoid or none")
    lab = prepare_label_side(labels, label_vec, head, matrix, weights)
    t_cols, l_cols = [c for c in texts.columns if c != text_vec], [c for c in lab.columns if c != label_vec]
    schema = T.StructType([texts.schema[c] for c in t_cols] + [lab.schema[c] for c in l_cols] + [
        T.StructField("logit", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()), T.StructField("n_compared", T.LongType())])
    over = _finder(schema, t_cols, l_cols, text_vec, label_vec, label_id, head, scale, bias, activation, k, threshold)
    size = lab.agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.size(label_vec)).alias("b")).first()
    shards = max(-(-size["n"] // shard_rows), -(-(size["b"] or 0) // MAX_MATRIX_BYTES), 1)
    if shards == 1:
        table = lab.toArrow()

        def run(batches):
            import pyarrow as pa

            rows_of = over(table)
            for batch in batches:
                for part in rows_of(pa.Table.from_batches([batch])):
                    yield from part.combine_chunks().to_batches()

        return texts.mapInArrow(run, schema)

    def meet(left, right):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        parts = list(over(right)(left)) if left.num_rows and right.num_rows else []
        return pa.concat_tables(parts) if parts else to_arrow_schema(schema).empty_table()

    blocks = max(1, -(-texts.count() // _TEXTS))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.select("*", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own)).select("*", every.alias(other))

    left = dealt(texts, sample, "_block", blocks, "_shard", shards).groupBy("_block", "_shard")
    right = dealt(lab, label_id, "_shard", shards, "_block", blocks).groupBy("_block", "_shard")
    got = left.cogroup(right).applyInArrow(meet, schema)
    tie = F.round("logit", PLACES).desc()
    return top_k_per_group(got.drop("rank"), [sample], [tie, F.col(label_id).asc()], k or size["n"]).select(*schema.names)
