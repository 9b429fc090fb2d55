"""Zero-shot scoring and classification (J-1 .. J-3, H-1 .. H-4, D-1 .. D-5).

Texts and candidate labels arrive with their vectors as columns (the user's
encoder runs upstream, e.g. through :mod:`labelspark.operators.annotate`'s
Arrow hook).  Scoring is one expression per pair after each vector has been
normalised once in its own table.

The text x shared-label product (D-1) scores whole Arrow batches of texts
against the label matrix (one matrix product per batch, softmax across a
text's labels inside it, no shuffle).  The matrix is collected and broadcast
only if it is small, in rows and in bytes; beyond that the product is tiled
into (text block, label block) pairs by an equi-join, so neither side has to
fit in one executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.activation import sigmoid, softmax_over
from ..functions.vector import dot, l2_normalize, logit_scale
from .placement import once_per_worker
from .prefix import global_row_number, top_k_per_group

#: A label side of at most this many rows and bytes is broadcast as a matrix.
MAX_MATRIX_ROWS = 4096
MAX_MATRIX_BYTES = 64 << 20
#: Pairs that a task holds at a time.
MAX_PAIRS = 1 << 18


def pair_product(texts: DataFrame, labels: DataFrame, text_blocks: int | None = None,
                 label_blocks: int | None = None) -> DataFrame:
    """D-1 for a label side of any size: every text against every label, tiled.
    A task joins one block of texts with one block of labels; texts are copied
    once per label block and labels once per text block."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    label_blocks = label_blocks or max(1, int(n ** 0.5))
    text_blocks = text_blocks or max(1, -(-n // label_blocks))

    def block(df: DataFrame, count: int) -> Column:
        return F.pmod(F.xxhash64(*df.columns), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    t = texts.withColumn("_tb", block(texts, text_blocks)).withColumn("_lb", every(label_blocks))
    lab = labels.withColumn("_lb", block(labels, label_blocks)).withColumn("_tb", every(text_blocks))
    return t.join(lab, on=["_tb", "_lb"], how="inner").drop("_tb", "_lb")


def label_matrix(labels: DataFrame, vec: str):
    """The label side as an Arrow table if it is small enough, else None.  At
    most one row more than the bound is fetched."""
    got = labels.limit(MAX_MATRIX_ROWS + 1).toArrow()
    small = got.num_rows <= MAX_MATRIX_ROWS and got.nbytes <= MAX_MATRIX_BYTES
    sizes = {len(v) for v in got.column(vec).to_pylist() if v is not None} if small else set()
    return got if small and len(sizes) <= 1 else None


def _score_batches(texts: DataFrame, labels: DataFrame, table, text_vec: str, label_vec: str, head: str,
                   scale: float, bias: float, activation: str) -> DataFrame:
    """Rows of ``texts`` times the rows of the label table, with logits."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    t_cols = [c for c in texts.columns if c != text_vec]
    l_cols = [c for c in labels.columns if c != label_vec]
    schema = T.StructType([texts.schema[c] for c in t_cols] + [labels.schema[c] for c in l_cols]
                          + [T.StructField("logit", T.DoubleType()), T.StructField("score", T.DoubleType())])
    rows = [v for v in table.column(label_vec).to_pylist()]
    dim = next((len(v) for v in rows if v is not None), 0)
    matrix = np.array([v if v is not None else [np.nan] * dim for v in rows], float).reshape(len(rows), dim)
    missing = np.array([v is None for v in rows], bool)
    n_labels, side = len(rows), table.select(l_cols).combine_chunks()

    def vectors(column) -> tuple[np.ndarray, np.ndarray]:
        """Text vectors, and which of them are missing or of another length."""
        size = np.array([-1 if x is None else x for x in pc.list_value_length(column).to_pylist()])
        bad = size != dim
        out = np.zeros((len(size), dim))
        if dim and not bad.all():
            good = column.filter(pa.array(~bad)) if bad.any() else column
            out[~bad] = good.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        return out, bad

    def slices(batches):
        """Parts of the batches whose pairs fit in memory."""
        step = max(1, MAX_PAIRS // max(1, n_labels))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step)

    def run(batches):
        for batch in slices(batches):
            x, bad = vectors(batch.column(text_vec))
            if head == "cosine":
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            logit = x @ matrix.T
            logit = logit * logit_scale(scale) if head == "cosine" else logit + bias
            void = bad[:, None] | missing[None, :]
            if activation == "softmax":
                z = np.where(void, -np.inf, logit)
                e = np.exp(z - np.max(z, axis=1, keepdims=True, initial=-1e300))
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = e / e.sum(axis=1, keepdims=True)
            elif activation == "sigmoid":
                score = 1.0 / (1.0 + np.exp(-logit))
            else:
                score = logit
            take = pa.array(np.repeat(np.arange(batch.num_rows), n_labels))
            again = pa.array(np.tile(np.arange(n_labels), batch.num_rows))
            mask = void.ravel()
            columns = [batch.column(c).take(take) for c in t_cols]
            columns += [side.column(c).combine_chunks().take(again) if n_labels else pa.array([], side.schema.field(c).type) for c in l_cols]
            columns += [pa.array(a.ravel(), pa.float64(), mask=mask) for a in (logit, score)]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=schema.names)

    return texts.mapInArrow(run, schema)


def score_expr(text_vec: str, label_vec: str, head: str = "cosine", scale: float = 2.0,
               bias: float = 0.0) -> Column:
    """Similarity head on prepared sides (see :func:`prepare_label_side`):
    'cosine' (F-9, both sides unit vectors), 'dot' (F-10, label side already
    multiplied by w) or 'bilinear' (F-11, label side already projected by W).
    Every head is one dot product per pair."""
    if head == "cosine":
        return dot(F.col(text_vec), F.col(label_vec)) * F.lit(logit_scale(scale))
    if head in ("dot", "bilinear"):
        return dot(text_vec, label_vec) + F.lit(float(bias))
    raise ValueError(f"unknown head {head!r}")


def _params(spark, **arrays) -> DataFrame:
    """Head parameters as a one-row DataFrame (bounded: one row), so large
    weight vectors / matrices never become giant literal expressions."""
    from pyspark.sql import types as T
    fields, row = [], []
    for name, val in arrays.items():
        depth = 2 if val and isinstance(val[0], (list, tuple)) else 1
        dt = T.ArrayType(T.ArrayType(T.DoubleType())) if depth == 2 else T.ArrayType(T.DoubleType())
        fields.append(T.StructField(name, dt))
        row.append([[float(x) for x in r] for r in val] if depth == 2 else [float(x) for x in val])
    return spark.createDataFrame([tuple(row)], T.StructType(fields))


def prepare_label_side(labels: DataFrame, vec: str, head: str = "cosine",
                       matrix: Sequence[Sequence[float]] | None = None,
                       weights: Sequence[float] | None = None) -> DataFrame:
    """Per-label work done once: normalise (cosine), multiply by the weights
    (dot: w . (t * l) = t . (w * l)) or project by W (bilinear: W l)."""
    v = F.col(vec).cast("array<double>")
    if head == "cosine":
        return labels.withColumn(vec, l2_normalize(v))
    if head == "dot":
        p = _params(labels.sparkSession, _w=weights)
        j = labels.crossJoin(F.broadcast(p))
        return j.withColumn(vec, F.zip_with(v, F.col("_w"), lambda a, b: a * b)).drop("_w")
    if head == "bilinear":
        p = _params(labels.sparkSession, _W=matrix)
        j = labels.crossJoin(F.broadcast(p))
        return j.withColumn(vec, F.transform(F.col("_W"), lambda row: dot(row, v))).drop("_W")
    return labels.withColumn(vec, v)


def prepare_text_side(texts: DataFrame, vec: str, head: str = "cosine") -> DataFrame:
    v = F.col(vec).cast("array<double>")
    return texts.withColumn(vec, l2_normalize(v) if head == "cosine" else v)


def score_pairs(texts: DataFrame, labels: DataFrame, text_vec: str = "text_vec",
                label_vec: str = "label_vec", head: str = "cosine", scale: float = 2.0,
                weights: Sequence[float] | None = None,
                matrix: Sequence[Sequence[float]] | None = None, bias: float = 0.0,
                activation: str = "sigmoid", sample: str = "sample_id") -> DataFrame:
    """J-1 core: pairs -> logit -> activation.  Adds ``logit`` and ``score``;
    'softmax' normalises across a text's labels (one row per ``sample``),
    'sigmoid' is per pair, 'none' keeps the logit.  A missing vector, or one of
    another length than the labels', gives NULLs."""
    if activation not in ("sigmoid", "softmax", "none"):
        raise ValueError(f"unknown activation {activation!r}")
    if head not in ("cosine", "dot", "bilinear"):
        raise ValueError(f"unknown head {head!r}")
    lab = prepare_label_side(labels, label_vec, head, matrix, weights)
    table = label_matrix(lab, label_vec)
    if table is not None:
        return _score_batches(texts, lab, table, text_vec, label_vec, head, scale, bias, activation)
    pairs = pair_product(prepare_text_side(texts, text_vec, head), lab)
    pairs = pairs.withColumn("logit", score_expr(text_vec, label_vec, head, scale, bias)).drop(text_vec, label_vec)
    if activation == "sigmoid":
        return pairs.withColumn("score", sigmoid("logit"))
    if activation == "softmax":
        return softmax_over(pairs, [sample], "logit", "score")
    return pairs.withColumn("score", F.col("logit"))


def own_label_pairs(samples: DataFrame, sample: str = "sample_id", ltext: str = "ltext",
                    lint: str = "lint") -> DataFrame:
    """D-2: one row per (sample, own label) with 1-based ``label_id`` and
    truth; row-local, no shuffle."""
    z = F.arrays_zip(F.col(ltext).alias("label"), F.col(lint).alias("truth"))
    return samples.select(sample, F.posexplode(z).alias("_p", "_z")).select(
        sample, (F.col("_p") + 1).cast("int").alias("label_id"),
        F.col("_z.label").alias("label"), F.col("_z.truth").cast("int").alias("truth"))


def attach_scores(truth: DataFrame, scores: DataFrame, keys: Sequence[str] = ("sample_id", "label_id"),
                  score: str = "score") -> DataFrame:
    """D-5 / D-6: scores joined to truth by (sample, label id), never by
    position; a label with no score counts as 0.0."""
    return (truth.join(scores.select(*keys, score), on=list(keys), how="left")
            .withColumn(score, F.coalesce(F.col(score).cast("double"), F.lit(0.0))))


def predictions(pred: DataFrame, threshold: float | None = None, sample: str = "sample_id",
                label: str = "label", label_id: str = "label_id",
                score: str = "score") -> DataFrame:
    """H-1: per sample ``array<struct<label, score>>``.  Without a threshold
    the labels stay in input order; with one, labels with score >= threshold
    are kept, sorted by score descending."""
    g = pred
    if threshold is not None:
        g = g.filter(F.col(score) >= F.lit(float(threshold)))
    arr = F.collect_list(F.struct(F.col(label_id).alias("_i"), F.col(label).alias("label"),
                                  F.col(score).alias("score")))
    out = g.groupBy(sample).agg(arr.alias("_a"))
    if threshold is None:
        sorted_ = F.array_sort(F.col("_a"))
    else:
        sorted_ = F.array_sort(F.col("_a"), lambda x, y: F.when(
            x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(
            F.when(x["_i"] < y["_i"], -1).when(x["_i"] > y["_i"], 1).otherwise(0)))
    return out.select(sample, F.transform(sorted_, lambda s: F.struct(
        s["label"].alias("label"), s["score"].alias("score"))).alias("predictions"))


def top_predictions(pred: DataFrame, k: int | None = None, sample: str = "sample_id",
                    label: str = "label", label_id: str = "label_id",
                    score: str = "score") -> DataFrame:
    """H-2 / H-3: labels ranked by score (ties: lower label id first), the
    first ``k`` (all when ``k`` is falsy) as rows with ``rank``."""
    order = [F.col(score).desc(), F.col(label_id).asc()]
    if k:
        return top_k_per_group(pred, [sample], order, k)
    # all labels ranked: distributed row number inside each sample
    return global_row_number(pred, [(score, False), (label_id, True)], keys=[sample], out="rank")


def top_label(pred: DataFrame, sample: str = "sample_id", label: str = "label",
              label_id: str = "label_id", score: str = "score") -> DataFrame:
    """H-2: best label and score per sample (partial aggregation, no sort)."""
    best = F.max_by(F.struct(F.col(label).alias("l"), F.col(score).alias("s")),
                    F.struct(F.col(score), -F.col(label_id)))
    return pred.groupBy(sample).agg(best.alias("_b")).select(
        sample, F.col("_b.l").alias("top_label"), F.col("_b.s").alias("top_score"))


def suggest_labels(pred: DataFrame, k: int = 10, threshold: float = 0.3,
                   sample: str = "sample_id", label_id: str = "label_id",
                   score: str = "score") -> DataFrame:
    """H-4: vocabulary labels with score > threshold, best ``k`` per text."""
    cand = pred.filter(F.col(score) > F.lit(float(threshold)))
    order = [F.col(score).desc(), F.col(label_id).asc()]
    return top_k_per_group(cand, [sample], order, k)


def classify_with_threshold(pred: DataFrame, threshold: float = 0.5,
                            sample: str = "sample_id", label: str = "label",
                            label_id: str = "label_id", score: str = "score") -> DataFrame:
    """J-2 / J-3: per text the matched labels (score > threshold, best first),
    their number, and the best label / score."""
    m = F.col(score) > F.lit(float(threshold))
    agg = pred.groupBy(sample).agg(
        F.count_if(m).alias("num_matches"),
        F.max_by(F.col(label), F.struct(F.col(score), -F.col(label_id))).alias("top_label"),
        F.max(score).alias("top_score"),
        F.collect_list(F.when(m, F.struct(F.col(score).alias("s"), (-F.col(label_id)).alias("i"),
                                          F.col(label).alias("l")))).alias("_m"))
    matched = F.transform(F.reverse(F.array_sort(F.col("_m"))), lambda x: x["l"])
    return agg.select(sample, matched.alias("matched_labels"), "num_matches", "top_label",
                      "top_score")


def score_own_labels(texts: DataFrame, label_vectors: DataFrame, sample: str = "sample_id",
                     text_vec: str = "text_vec", label_vec: str = "label_vec",
                     scale: float = 2.0) -> DataFrame:
    """D-4 / D-2: every label row gathers its own sample's text vector (equi
    join on the sample id, both sides hash-partitioned on it) and is scored
    with the scaled cosine head, then a sigmoid."""
    t = prepare_text_side(texts.select(sample, text_vec), text_vec)
    lab = prepare_label_side(label_vectors, label_vec)
    j = lab.join(t, on=sample, how="inner")
    j = j.withColumn("logit", score_expr(text_vec, label_vec, "cosine", scale))
    return j.drop(text_vec, label_vec).withColumn("score", sigmoid("logit"))


def regroup_scores(pred: DataFrame, sample: str = "sample_id", label_id: str = "label_id",
                   score: str = "score", out: str = "scores") -> DataFrame:
    """J-12: flat pair scores back to one array per sample in label-id order
    (a sample's labels are one bounded group)."""
    g = pred.groupBy(sample).agg(F.array_sort(F.collect_list(
        F.struct(F.col(label_id).alias("i"), F.col(score).alias("s")))).alias("_a"))
    return g.select(sample, F.transform("_a", lambda x: x["s"]).alias(out))


def score_with_model(pairs: DataFrame, model_factory, text: str = "text",
                     label: str = "label", out: str = "score", model_name: str | None = None,
                     profile=None) -> DataFrame:
    """L-6: score (text, label) pairs with a user model through Arrow batches.

    ``model_factory()`` is called once per task (load weights there); the
    returned callable maps two pandas Series (texts, labels) to a Series of
    floats.  Everything else in ``pairs`` passes through unchanged.

    With ``model_name`` the model is kept in the worker process under that name
    and the factory is called once a worker (:mod:`.placement`); ``profile``, a
    ``ResourceProfile``, is what the executors of this stage must have."""
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType(list(pairs.schema.fields) + [T.StructField(out, T.DoubleType())])

    make = once_per_worker(model_name, model_factory)

    def run(batches):
        model = make()
        for b in batches:
            got = model(b[text], b[label])
            yield b.assign(**{out: pd.Series(got, index=b.index, dtype="float64")})

    return pairs.mapInPandas(run, schema, profile=profile)
