"""Scoring, classification, similarity-head and pooling queries (J-1..J-3,
H-1..H-4, F-7..F-12, E-25, G-4, D-1, D-3) bound to the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import l2_normalize
from ..operators import classify
from ..operators.pruned import find_labels
from ..operators.pooling import pool_tokens, separator_vectors
from .registry import register, with_ctes
from .tables import embedding_vectors, flagship_pred, label_centroids, scored_pairs

DIM = 64  # width of the embedding vectors in the given tables
# Test-head parameters built from a rule (all 64 dimensions are used).
DOT_WEIGHTS = [((i % 8) - 3.5) / 4.0 for i in range(DIM)]
DOT_BIAS = 0.1
BILINEAR = [[((i * DIM + j) % 5 - 2) / 10.0 for j in range(DIM)] for i in range(DIM)]

# ---------------------------------------------------------------- oracle SQL
SQL_EMB = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
SQL_CENT = """u AS (SELECT label, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM e),
cent AS (SELECT label AS cand, list(x ORDER BY d) AS cv
         FROM (SELECT label, d, avg(x) AS x FROM u GROUP BY label, d) GROUP BY label)"""
SQL_PAIRS = """sp AS (SELECT e.vec_id AS sample_id, e.label AS true_label, cent.cand,
                   list_cosine_similarity(e.v, cent.cv) * exp(2.0) AS logit
            FROM e CROSS JOIN cent)"""
SQL_PRED_ROWS = """pred AS (SELECT sample_id, CAST(cand + 1 AS INTEGER) AS label_id,
                     'c' || CAST(cand AS VARCHAR) AS label,
                     CASE WHEN true_label = cand THEN 1 ELSE 0 END AS truth,
                     round(1.0 / (1.0 + exp(-logit)), 6) AS score, logit FROM sp)"""
PRED_CTES = (SQL_EMB, SQL_CENT, SQL_PAIRS, SQL_PRED_ROWS)

SQL_DOT_PAIRS = f"""dp AS (SELECT e.vec_id AS sample_id, e.label AS true_label, cent.cand,
   list_sum(list_transform(range(1, {DIM + 1}),
     lambda i: e.v[i] * cent.cv[i] * ((((i - 1) % 8) - 3.5) / 4.0))) + {DOT_BIAS}
     AS logit FROM e CROSS JOIN cent)"""
SQL_BIL_PAIRS = f"""cproj AS (SELECT cand, list_transform(range(1, {DIM + 1}), lambda i: list_sum(
     list_transform(range(1, {DIM + 1}),
       lambda j: ((((i - 1) * {DIM} + (j - 1)) % 5) - 2) / 10.0 * cv[j]))) AS pv FROM cent),
bp AS (SELECT e.vec_id AS sample_id, e.label AS true_label, cproj.cand,
   list_sum(list_transform(range(1, {DIM + 1}), lambda i: e.v[i] * cproj.pv[i])) AS logit
   FROM e CROSS JOIN cproj)"""


# ---------------------------------------------------------------- queries
@register("zs_flagship_scores", with_ctes(*PRED_CTES, select="""
SELECT sample_id, label_id, label, truth, score FROM pred"""))
def zs_flagship_scores(spark, sf):
    """J-1 / D-1 / F-9 / F-7: every vector against every label centroid."""
    return flagship_pred(spark, sf).drop("logit")


@register("zs_top1", with_ctes(*PRED_CTES, select="""
SELECT sample_id, first(label ORDER BY score DESC, label_id ASC) AS top_label,
       max(score) AS top_score
FROM pred GROUP BY sample_id"""))
def zs_top1(spark, sf):
    """H-2: best label and score per text."""
    return classify.top_label(flagship_pred(spark, sf))


@register("zs_topk3", with_ctes(*PRED_CTES, select="""
SELECT sample_id, label, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT sample_id, label, score,
         row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, label_id ASC) AS rank
  FROM pred) WHERE rank <= 3"""))
def zs_topk3(spark, sf):
    """H-3: top-3 predictions per text."""
    t = classify.top_predictions(flagship_pred(spark, sf), k=3)
    return t.select("sample_id", "label", "score", F.col("rank").cast("int").alias("rank"))


@register("zs_threshold_sorted", with_ctes(*PRED_CTES, select="""
SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id
                  ORDER BY score DESC, label_id ASC) AS INTEGER) AS pos, label, score
FROM pred WHERE score >= 0.3"""))
def zs_threshold_sorted(spark, sf):
    """H-1: labels at or above the threshold, sorted by score, per text."""
    p = classify.predictions(flagship_pred(spark, sf), threshold=0.3)
    return p.select("sample_id", F.posexplode("predictions").alias("pos", "p")).select(
        "sample_id", (F.col("pos") + 1).cast("int").alias("pos"),
        F.col("p.label").alias("label"), F.col("p.score").alias("score"))


@register("zs_softmax", with_ctes(*PRED_CTES, select="""
SELECT sample_id, label_id, ex / sum(ex) OVER (PARTITION BY sample_id) AS score
FROM (SELECT sample_id, label_id,
             exp(logit - max(logit) OVER (PARTITION BY sample_id)) AS ex FROM pred)"""))
def zs_softmax(spark, sf):
    """F-8 / J-1 multi-class: softmax of the logits across a text's labels."""
    s = scored_pairs(spark, sf, activation="softmax")
    return s.select("sample_id", "label_id", "score")


@register("suggest_labels", with_ctes(*PRED_CTES, select="""
SELECT sample_id, label, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT sample_id, label, score,
         row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, label_id ASC) AS rank
  FROM pred WHERE score > 0.3) WHERE rank <= 10"""))
def suggest_labels(spark, sf):
    """H-4: vocabulary labels scoring above 0.3, best 10 per text."""
    s = classify.suggest_labels(flagship_pred(spark, sf), k=10, threshold=0.3)
    return s.select("sample_id", "label", "score", F.col("rank").cast("int").alias("rank"))


def _sides(spark, sf):
    texts = embedding_vectors(spark, sf).select(F.col("vec_id").alias("sample_id"), F.col("v").alias("text_vec"))
    labels = label_centroids(spark, sf).select(
        (F.col("cand") + 1).cast("int").alias("label_id"),
        F.concat(F.lit("c"), F.col("cand").cast("string")).alias("label"), "label_vec")
    return texts, labels


_PRUNED = """SELECT sample_id, label, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT sample_id, label, 1.0 / (1.0 + exp(-logit)) AS score,
         row_number() OVER (PARTITION BY sample_id ORDER BY round(logit, 9) DESC, label_id ASC) AS rank
  FROM pred WHERE {where}) WHERE rank <= {k}"""


@register("topk_pruned", with_ctes(*PRED_CTES, select=_PRUNED.format(where="true", k=3)))
def topk_pruned(spark, sf):
    """H-3 by blocks of labels around pivots: the best 3, no pair is written."""
    return find_labels(*_sides(spark, sf), k=3).select("sample_id", "label", "score", "rank")


@register("suggest_pruned", with_ctes(*PRED_CTES, select=_PRUNED.format(
    where="1.0 / (1.0 + exp(-logit)) > 0.6", k=10)))
def suggest_pruned(spark, sf):
    """H-4 / D-3 by blocks of labels around pivots: scores above 0.6, best 10."""
    return find_labels(*_sides(spark, sf), k=10, threshold=0.6).select("sample_id", "label", "score", "rank")


@register("classify_with_threshold", with_ctes(*PRED_CTES, select="""
SELECT sample_id,
       coalesce(list(label ORDER BY score DESC, label_id ASC) FILTER (WHERE score > 0.5),
                CAST([] AS VARCHAR[])) AS matched_labels,
       count(*) FILTER (WHERE score > 0.5) AS num_matches,
       first(label ORDER BY score DESC, label_id ASC) AS top_label,
       max(score) AS top_score
FROM pred GROUP BY sample_id"""))
def classify_with_threshold_q(spark, sf):
    """J-2 / J-3: matched labels, their count and the best label per text."""
    return classify.classify_with_threshold(flagship_pred(spark, sf), 0.5)


@register("sim_dot", with_ctes(SQL_EMB, SQL_CENT, SQL_DOT_PAIRS, select="""
SELECT sample_id, CAST(cand + 1 AS INTEGER) AS label_id, logit AS score FROM dp"""))
def sim_dot(spark, sf):
    """F-10: weighted dot head w . (t * l) + b."""
    s = scored_pairs(spark, sf, head="dot", activation="none",
                     weights=DOT_WEIGHTS, bias=DOT_BIAS)
    return s.select("sample_id", "label_id", "score")


@register("sim_bilinear", with_ctes(SQL_EMB, SQL_CENT, SQL_BIL_PAIRS, select="""
SELECT sample_id, CAST(cand + 1 AS INTEGER) AS label_id, logit AS score FROM bp"""))
def sim_bilinear(spark, sf):
    """F-11: bilinear head t^T W l (label side projected by W once)."""
    s = scored_pairs(spark, sf, head="bilinear", activation="none", matrix=BILINEAR)
    return s.select("sample_id", "label_id", "score")


@register("l2_normalize", with_ctes(SQL_EMB, select="""
SELECT vec_id, d, x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12) AS x
FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM e)"""))
def l2_normalize_q(spark, sf):
    """F-12: unit vectors, one row per element."""
    e = embedding_vectors(spark, sf)
    u = e.select("vec_id", l2_normalize("v").alias("u"))
    return u.select("vec_id", F.posexplode("u").alias("d", "x")).select(
        "vec_id", (F.col("d") + 1).cast("long").alias("d"), "x")


SQL_TOKENS = """tok AS (SELECT vec_id // 10 AS sample_id, CAST(vec_id % 10 AS INTEGER) AS pos,
                CAST((vec_id % 10) % 4 AS INTEGER) AS lmask, v AS vec FROM e)"""


def _tokens(spark, sf):
    e = embedding_vectors(spark, sf)
    pos = F.pmod(F.col("vec_id"), F.lit(10)).cast("int")
    return e.select((F.col("vec_id") / 10).cast("long").alias("sample_id"), pos.alias("pos"),
                    F.pmod(pos, F.lit(4)).cast("int").alias("lmask"),
                    F.col("v").alias("vec"))


@register("pool_mean", with_ctes(SQL_EMB, SQL_TOKENS, select="""
SELECT sample_id, lmask AS label_id, d, avg(x) AS x FROM (
  SELECT sample_id, lmask, unnest(range(1, len(vec) + 1)) AS d, unnest(vec) AS x FROM tok
  WHERE lmask > 0)
GROUP BY sample_id, lmask, d"""))
def pool_mean(spark, sf):
    """E-25: mean of token vectors per (sample, label id)."""
    p = pool_tokens(_tokens(spark, sf))
    return p.select("sample_id", "label_id", F.posexplode("vec").alias("d", "x")).select(
        "sample_id", "label_id", (F.col("d") + 1).cast("long").alias("d"), "x")


@register("pool_sep_token", with_ctes(SQL_EMB, SQL_TOKENS, select="""
SELECT sample_id, label_id, unnest(range(1, len(vec) + 1)) AS d, unnest(vec) AS x FROM (
  SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS INTEGER)
         AS label_id, vec FROM tok WHERE pos % 3 = 2)"""))
def pool_sep_token(spark, sf):
    """G-4: label vector = vector at its separator token, labels numbered by position."""
    t = _tokens(spark, sf).withColumn("is_sep", F.pmod(F.col("pos"), F.lit(3)) == 2)
    s = separator_vectors(t)
    return s.select("sample_id", "label_id", F.posexplode("vec").alias("d", "x")).select(
        "sample_id", "label_id", (F.col("d") + 1).cast("long").alias("d"), "x")
