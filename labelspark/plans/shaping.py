"""Sampling / split / union / vocabulary / pair queries (H-5 .. H-9, I-1 .. I-4,
B-10 .. B-12, E-30 .. E-32, J-4 .. J-7, G-3, D-9, D-11, A-10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.permute import PRIME, ROUNDS, turn_keys
from ..operators import pairs as P
from ..operators import permutation as PM
from ..operators import sampling as SM
from ..operators import sketches as SK
from ..operators.normalize import checked_vocab
from ..operators.prefix import global_row_number, materialize, running_sums
from ..session import scratch_path
from . import sqlfn as S
from .registry import register, with_ctes
from .tables import read

SEED = 42


def triplets(spark, sf):
    """Triplet corpus from part: positives [brand, type], negatives = the
    other part types in sorted order."""
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    types = checked_vocab(p, "p_type")
    t = p.crossJoin(F.broadcast(types))
    return t.select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("text"),
                    F.array("p_brand", "p_type").alias("labels"),
                    F.array_except("vocab", F.array("p_type")).alias("not_labels"))


TRIPLETS = """voc AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS vocab FROM part),
t AS (SELECT p_partkey AS sample_id, p_name AS text, [p_brand, p_type] AS labels,
             list_filter(voc.vocab, lambda v: v <> p_type) AS not_labels FROM part, voc)"""
EXPLODED = """ex AS (SELECT sample_id, text, not_labels, unnest(labels) AS positive,
                     CAST(unnest(range(0, len(labels))) AS INTEGER) AS pos FROM t)"""


@register("sample_exact", f"""
SELECT doc_id, lang FROM documents ORDER BY {S.num_key('doc_id', str(SEED))}, doc_id LIMIT 300""")
def sample_exact(spark, sf):
    """H-5 / H-6: exactly 300 documents by seeded hash order."""
    d = read(spark, sf, "documents").select("doc_id", "lang")
    return SM.sample_exact(d, 300, "doc_id", SEED)


@register("global_shuffle_head", f"""
SELECT doc_id, row_number() OVER (ORDER BY {S.num_key('doc_id', str(SEED))}, doc_id) AS position
FROM documents""")
def global_shuffle_head(spark, sf):
    """H-7: seeded global shuffle of every document, as positions."""
    d = read(spark, sf, "documents").select("doc_id")
    return SM.shuffled_positions(d, "doc_id", SEED)


@register("split_90_10", f"""
SELECT doc_id, CASE WHEN {S.uniform('doc_id', str(SEED), "'split'")} < 0.1 THEN 'validation'
                    ELSE 'train' END AS split FROM documents""")
def split_90_10(spark, sf):
    """H-9: hash split 90 / 10."""
    d = read(spark, sf, "documents").select("doc_id")
    return SM.split_train_validation(d, "doc_id", 0.1, SEED)


@register("union_capped", f"""
SELECT doc_id AS id, 'documents' AS source FROM documents
UNION ALL
SELECT id, 'benchmark' FROM (SELECT item_id AS id FROM benchmark
                             ORDER BY {S.num_key('item_id', str(SEED))}, item_id LIMIT 50000)
UNION ALL
SELECT id, 'pages' FROM (SELECT page_id AS id FROM pages
                         ORDER BY {S.num_key('page_id', str(SEED))}, page_id LIMIT 50000)""")
def union_capped(spark, sf):
    """I-1: base corpus plus extra corpora capped at 50 000 rows each."""
    parts = {
        "documents": read(spark, sf, "documents").select(F.col("doc_id").alias("id")),
        "benchmark": read(spark, sf, "benchmark").select(F.col("item_id").alias("id")),
        "pages": read(spark, sf, "pages").select(F.col("page_id").alias("id")),
    }
    return SM.union_capped(parts, "id", cap=50_000, seed=SEED, base="documents")


@register("row_slice", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS rn
                           FROM conversations) WHERE rn > 100 AND rn <= 300""")
def row_slice(spark, sf):
    """B-11: rows [100, 300) of the conversations in (conv_id, turn) order."""
    c = read(spark, sf, "conversations").select("conv_id", "turn")
    return SM.row_slice(c, [("conv_id", True), ("turn", True)], 100, 200)


@register("min_length", "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 100")
def min_length(spark, sf):
    """B-10: texts of at least 100 characters."""
    d = read(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return SM.min_length(d, "text", 100).drop("text")


@register("contrastive_pairs", with_ctes(TRIPLETS, EXPLODED, """c AS (
  SELECT *, row_number() OVER (ORDER BY sample_id, pos) AS n FROM ex WHERE len(not_labels) > 0)""",
                                         select="""
SELECT sample_id, text, pos, positive, not_labels[((n - 1) % len(not_labels)) + 1] AS negative FROM c"""))
def contrastive_pairs(spark, sf):
    """J-4 / G-3: positives with the corpus-wide cycled negative."""
    return P.contrastive_pairs(triplets(spark, sf))


@register("n_negative_tuples", with_ctes(TRIPLETS, EXPLODED, select="""
SELECT sample_id, text, pos, positive, not_labels[1] AS negative_1, not_labels[2] AS negative_2,
       not_labels[3] AS negative_3 FROM ex WHERE len(not_labels) >= 3"""))
def n_negative_tuples(spark, sf):
    """J-5 / B-12: (text, positive, first three negatives)."""
    return P.negative_tuples(triplets(spark, sf), 3)


@register("eval_triplets_random", with_ctes(TRIPLETS, EXPLODED, f"""voc2 AS (
  SELECT v, row_number() OVER (ORDER BY {S.num_key('v', str(SEED))}, v) - 1 AS vi
  FROM (SELECT DISTINCT positive AS v FROM ex)),
vn AS (SELECT count(*) AS n FROM voc2),
j AS (SELECT ex.sample_id, ex.text, ex.pos, ex.positive, voc2.vi AS own,
             {S.hash_int('vn.n - 1', 'ex.sample_id', 'ex.pos', str(SEED))} AS jj
      FROM ex JOIN voc2 ON ex.positive = voc2.v, vn WHERE vn.n >= 2)""", select="""
SELECT j.sample_id, j.text, j.pos, j.positive, w.v AS negative
FROM j JOIN voc2 w ON w.vi = CASE WHEN j.jj >= j.own THEN j.jj + 1 ELSE j.jj END"""))
def eval_triplets_random(spark, sf):
    """J-6 / D-9: no negatives given -> a random other positive."""
    pairs = P.contrastive_pairs(triplets(spark, sf), not_labels=None)
    return P.random_other_negatives(pairs, SEED)


@register("eval_pairs_dedup", with_ctes(TRIPLETS, EXPLODED, """c AS (
  SELECT *, row_number() OVER (ORDER BY sample_id, pos) AS n FROM ex WHERE len(not_labels) > 0),
cp AS (SELECT text, positive, not_labels[((n - 1) % len(not_labels)) + 1] AS negative FROM c)""",
                                        select="""
SELECT text, label, max(flag) AS flag FROM (
  SELECT text, positive AS label, 1 AS flag FROM cp UNION ALL SELECT text, negative, 0 FROM cp)
GROUP BY text, label"""))
def eval_pairs_dedup(spark, sf):
    """J-7 / E-32: evaluation pairs, positive wins over a duplicate negative."""
    return P.evaluation_pairs(P.contrastive_pairs(triplets(spark, sf)))


@register("pairs_union", with_ctes(TRIPLETS, EXPLODED, """c AS (
  SELECT *, row_number() OVER (ORDER BY sample_id, pos) AS n FROM ex WHERE len(not_labels) > 0),
cp AS (SELECT text, positive, not_labels[((n - 1) % len(not_labels)) + 1] AS negative FROM c)""",
                                   select="""
SELECT text, positive AS label, 1 AS flag FROM cp UNION ALL SELECT text, negative, 0 FROM cp"""))
def pairs_union(spark, sf):
    """I-3: positives (1) union negatives (0), duplicates kept."""
    return P.pairs_union(P.contrastive_pairs(triplets(spark, sf)))


@register("label_vocab", with_ctes(TRIPLETS, select="""
SELECT DISTINCT unnest(list_concat(labels, not_labels)) AS label FROM t"""))
def label_vocab(spark, sf):
    """E-30: distinct labels over positives and negatives."""
    return P.label_vocabulary(triplets(spark, sf))


SPLIT = f"""ts AS (SELECT *, CASE WHEN {S.uniform('sample_id', str(SEED), "'split'")} < 0.1
                  THEN 'validation' ELSE 'train' END AS split FROM t)"""


@register("vocab_overlap", with_ctes(TRIPLETS, SPLIT, """va AS (
  SELECT DISTINCT unnest(list_concat(labels, not_labels)) AS label FROM ts WHERE split = 'train'),
vb AS (SELECT DISTINCT unnest(list_concat(labels, not_labels)) AS label FROM ts WHERE split = 'validation')""",
                                     select="""
SELECT (SELECT count(*) FROM va) AS n_first, (SELECT count(*) FROM vb) AS n_second,
       (SELECT count(*) FROM va JOIN vb USING (label)) AS n_overlap,
       (SELECT count(*) FROM (SELECT label FROM va UNION SELECT label FROM vb)) AS n_union"""))
def vocab_overlap(spark, sf):
    """D-11 / I-2: train vs validation vocabulary overlap."""
    t = SM.split_train_validation(triplets(spark, sf), "sample_id", 0.1, SEED)
    a = P.label_vocabulary(t.filter(F.col("split") == "train"))
    b = P.label_vocabulary(t.filter(F.col("split") == "validation"))
    return P.vocabulary_overlap(a, b)


@register("dataset_stats", with_ctes(TRIPLETS, SPLIT, """agg AS (
  SELECT split, count(*) AS n_samples, CAST(sum(len(labels)) AS BIGINT) AS n_positives,
         count(*) FILTER (WHERE len(not_labels) > 0) AS n_with_negatives
  FROM ts GROUP BY ROLLUP (split)),
lab AS (SELECT split, count(DISTINCT label) AS n_unique_labels FROM (
  SELECT split, unnest(list_concat(labels, not_labels)) AS label FROM ts) GROUP BY ROLLUP (split))""",
                                     select="""
SELECT a.split, a.n_samples, a.n_positives, a.n_with_negatives,
       coalesce(l.n_unique_labels, 0) AS n_unique_labels
FROM agg a LEFT JOIN lab l ON a.split IS NOT DISTINCT FROM l.split"""))
def dataset_stats(spark, sf):
    """E-31: per-split sizes and label counts plus the total row."""
    t = SM.split_train_validation(triplets(spark, sf), "sample_id", 0.1, SEED)
    return P.dataset_statistics(t)


@register("dataset_sketches", with_ctes(TRIPLETS, SPLIT, """agg AS (
  SELECT split, count(*) AS n_samples, CAST(sum(len(labels)) AS BIGINT) AS n_positives,
         count(*) FILTER (WHERE len(not_labels) > 0) AS n_with_negatives
  FROM ts GROUP BY ROLLUP (split)),
lab AS (SELECT split, count(DISTINCT label) AS n_exact FROM (
  SELECT split, unnest(list_concat(labels, not_labels)) AS label FROM ts) GROUP BY ROLLUP (split))""",
                                        select="""
SELECT a.split, a.n_samples, a.n_positives, a.n_with_negatives, coalesce(l.n_exact, 0) AS n_exact, true AS within
FROM agg a LEFT JOIN lab l ON a.split IS NOT DISTINCT FROM l.split"""))
def dataset_sketches(spark, sf):
    """E-30 / E-31: statistics from the stored sketches of two loads, and
    whether their label counts lie within four standard errors of the exact ones."""
    t = SM.split_train_validation(triplets(spark, sf), "sample_id", 0.1, SEED)
    path = scratch_path(spark, f"sketches-{uuid.uuid4().hex}")
    for load in (0, 1):
        SK.add_load(t.where(F.pmod("sample_id", F.lit(2)) == load), path, str(load))
    got = SK.sketch_statistics(SK.stored(spark, path)).withColumnRenamed("split", "_split")
    exact = P.dataset_statistics(t).select("split", F.col("n_unique_labels").alias("n_exact"))
    near = F.abs(F.col("n_unique_labels") - F.col("n_exact")) <= 4 * F.col("std_error")
    return exact.join(got, F.col("split").eqNullSafe(F.col("_split"))).select(
        "split", "n_samples", "n_positives", "n_with_negatives", "n_exact", near.alias("within"))


@register("word_sketches", with_ctes("""w AS (
  SELECT lang AS split, list_distinct(string_split(text, ' ')) AS labels, [source] AS not_labels FROM documents)""", """agg AS (
  SELECT split, count(*) AS n_samples, CAST(sum(len(labels)) AS BIGINT) AS n_positives,
         count(*) FILTER (WHERE len(not_labels) > 0) AS n_with_negatives FROM w GROUP BY ROLLUP (split)),
lab AS (SELECT split, count(DISTINCT label) AS n_exact FROM (
  SELECT split, unnest(list_concat(labels, not_labels)) AS label FROM w) GROUP BY ROLLUP (split))""", select="""
SELECT a.split, a.n_samples, a.n_positives, a.n_with_negatives, coalesce(l.n_exact, 0) AS n_exact, true AS within
FROM agg a LEFT JOIN lab l ON a.split IS NOT DISTINCT FROM l.split"""))
def word_sketches(spark, sf):
    """E-30 / E-31 over large vocabularies: sketches of every language's words,
    united for the total, within four standard errors of the exact counts."""
    words = F.array_distinct(F.split("text", " "))
    t = read(spark, sf, "documents").select(F.col("lang").alias("split"), words.alias("labels"), F.array("source").alias("not_labels"))
    got = SK.sketch_statistics(materialize(SK.label_sketches(t))).withColumnRenamed("split", "_split")
    exact = P.dataset_statistics(t).select("split", F.col("n_unique_labels").alias("n_exact"))
    near = F.abs(F.col("n_unique_labels") - F.col("n_exact")) <= 4 * F.col("std_error")
    return exact.join(got, F.col("split").eqNullSafe(F.col("_split"))).select(
        "split", "n_samples", "n_positives", "n_with_negatives", "n_exact", near.alias("within"))


@register("dataset_info", with_ctes(TRIPLETS, """src AS (
  SELECT 'part_triplets' AS split, labels, not_labels FROM t
  UNION ALL
  SELECT 'customer_segments', [c_mktsegment], CAST([] AS VARCHAR[]) FROM customer)""", """agg AS (
  SELECT split, count(*) AS n_samples, CAST(sum(len(labels)) AS BIGINT) AS n_positives,
         count(*) FILTER (WHERE len(not_labels) > 0) AS n_with_negatives
  FROM src GROUP BY ROLLUP (split)),
lab AS (SELECT split, count(DISTINCT label) AS n_unique_labels FROM (
  SELECT split, unnest(list_concat(labels, not_labels)) AS label FROM src) GROUP BY ROLLUP (split))""",
                                    select="""
SELECT a.split AS source, a.n_samples, a.n_positives, a.n_with_negatives,
       coalesce(l.n_unique_labels, 0) AS n_unique_labels
FROM agg a LEFT JOIN lab l ON a.split IS NOT DISTINCT FROM l.split"""))
def dataset_info(spark, sf):
    """A-10: per-source record (sizes, has-negatives count, unique labels) and
    the all-sources total row."""
    a = triplets(spark, sf).select(F.lit("part_triplets").alias("split"), "labels", "not_labels")
    c = read(spark, sf, "customer").select(
        F.lit("customer_segments").alias("split"), F.array("c_mktsegment").alias("labels"),
        F.array().cast("array<string>").alias("not_labels"))
    st = P.dataset_statistics(a.unionByName(c))
    return st.withColumnRenamed("split", "source")


# --------------------------------------------- prefix sums over awkward orders
@register("row_slice_null_order", """
SELECT doc_id, rn FROM (SELECT d.doc_id, row_number() OVER (ORDER BY quality ASC NULLS FIRST, d.doc_id) AS rn
                        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def row_slice_null_order(spark, sf):
    """G-3 with an order of two values and NULLs: every document's position."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return global_row_number(d.select("doc_id", "quality"), [("quality", True), ("doc_id", True)]).select("doc_id", "rn")


@register("row_number_string_order", """
SELECT text_key, rn FROM (SELECT o_orderpriority || '-' || o_orderkey AS text_key,
   row_number() OVER (ORDER BY o_orderpriority || '-' || o_orderkey DESC) AS rn FROM orders)""")
def row_number_string_order(spark, sf):
    """G-3 by a text key, descending."""
    key = F.concat_ws("-", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("text_key")
    return global_row_number(read(spark, sf, "orders").select(key), [("text_key", False)])


@register("running_sum_null_key", """
SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY quality ORDER BY doc_id) AS BIGINT) AS total
FROM documents LEFT JOIN labels USING (doc_id)""")
def running_sum_null_key(spark, sf):
    """G-3 within keys that may be NULL."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", "n_chars", "quality")
    return running_sums(d, ["quality"], [("doc_id", True)], {"total": F.col("n_chars")}).select("doc_id", "total")


def _pass_sql(seed: int) -> str:
    """One pass of the permutation over rows (id, step, y, n, a, b) of w."""
    l, r, cols = "l0", "r0", ["y // b AS l0", "y % b AS r0"]
    for t, (k, m) in zip(range(ROUNDS), turn_keys(seed)):
        x = r if t % 2 == 0 else l
        cols += [f"({x} + {k}) % {PRIME} AS u{t}", f"(u{t} * u{t} + {m}) % {PRIME} AS v{t}"]
        if t % 2 == 0:
            cols.append(f"({l} + v{t} * v{t} % {PRIME}) % a AS l{t + 1}")
            l = f"l{t + 1}"
        else:
            cols.append(f"({r} + v{t} * v{t} % {PRIME}) % b AS r{t + 1}")
            r = f"r{t + 1}"
    return f"SELECT id, step + 1 AS step, {l} * b + {r} AS y, n, a, b FROM (SELECT *, {', '.join(cols)} FROM w WHERE step = 0 OR y >= n)"


@register("permuted_split", f"""
WITH RECURSIVE c AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
w AS (SELECT doc_id AS id, 0 AS step, row_number() OVER (ORDER BY doc_id) - 1 AS y, n, a, (n + a - 1) // a AS b
      FROM documents, c
      UNION ALL {_pass_sql(SEED)})
SELECT id AS doc_id, CAST(y AS BIGINT) AS place, y < 300 AS sampled,
       CASE WHEN y < n // 10 THEN 'validation' ELSE 'train' END AS split FROM w WHERE step > 0 AND y < n""")
def permuted_split(spark, sf):
    """H-5 / H-7 / H-9 without a sort: seeded place of every document, an exact
    sample of 300 and an exact tenth, from its dense number."""
    d = materialize(PM.dense_positions(read(spark, sf, "documents").select("doc_id"), [("doc_id", True)]))
    n = PM.count_positions(d, "position")
    taken = PM.sample(d, 300, "position", n, SEED).select("doc_id", F.lit(True).alias("sampled"))
    out = PM.split(PM.shuffled(d, "position", n, SEED), {"validation": 0.1, "train": 0.9}, "position", n, SEED)
    return out.join(taken, "doc_id", "left").select(
        "doc_id", "place", F.coalesce("sampled", F.lit(False)).alias("sampled"), "split")
