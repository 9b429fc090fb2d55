"""Source / sink / annotation / string-function queries and the composite
jobs (A-1 .. A-10, F-1 .. F-6, F-13 .. F-17, F-19, F-21, J-11, J-13, J-14,
D-2, D-4, D-5, D-7, D-10, E-33, I-3, I-4).

Round-trip queries write to a fresh folder under the session's shared
``spark.checkpoint.dir`` and read it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.rand import hash_uniform
from ..operators import annotate as AN
from ..operators import metrics as M
from ..operators import normalize as N
from ..operators import sampling as SM
from ..operators.classify import own_label_pairs
from ..operators.evaluate import evaluate
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.document import read_results_document, write_results_document
from . import sqlfn as S
from .metrics import ACC, CONF, F1, PREC, REC, _C0, _rank_ctes, _topk_cols
from .registry import register, with_ctes
from .scoring import PRED_CTES
from .tables import embedding_vectors, flagship_pred, read


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


_RAW = """CASE event_id % 5
  WHEN 0 THEN '{"sentence": "event ' || event_type || '", "labels": ["' || event_type
              || '"], "not_labels": [], "extra": 1}'
  WHEN 1 THEN '{"sentence": "x", "labels": [1, 2], "not_labels": ["a"]}'
  WHEN 2 THEN props
  WHEN 3 THEN '{"sentence": "broken", "labels": ['
  ELSE '{"sentence": null, "labels": ["a"], "not_labels": ["b"]}' END"""


def _raw_json(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", "props")
    k = F.pmod("event_id", F.lit(5))
    raw = (F.when(k == 0, F.concat(F.lit('{"sentence": "event '), F.col("event_type"),
                                   F.lit('", "labels": ["'), F.col("event_type"),
                                   F.lit('"], "not_labels": [], "extra": 1}')))
           .when(k == 1, F.lit('{"sentence": "x", "labels": [1, 2], "not_labels": ["a"]}'))
           .when(k == 2, F.col("props"))
           .when(k == 3, F.lit('{"sentence": "broken", "labels": ['))
           .otherwise(F.lit('{"sentence": null, "labels": ["a"], "not_labels": ["b"]}')))
    return e.select("event_id", raw.alias("raw"))


def _all_str(path: str) -> str:
    return (f"coalesce(list_bool_and(list_transform(json_extract(raw, '{path}[*]'), "
            f"lambda x: json_type(x) = 'VARCHAR')), true)")


_OK = (f"""CASE WHEN NOT json_valid(raw) THEN false ELSE coalesce(
   json_type(raw, '$.sentence') = 'VARCHAR'
   AND json_type(raw, '$.labels') = 'ARRAY' AND json_type(raw, '$.not_labels') = 'ARRAY'
   AND {_all_str('$.labels')} AND {_all_str('$.not_labels')}, false) END""")


@register("json_validate", f"""
SELECT event_id, ok AS valid,
       CASE WHEN ok THEN json_extract_string(raw, '$.sentence') END AS sentence,
       CASE WHEN ok THEN from_json(json_extract(raw, '$.labels'), '["VARCHAR"]') END AS labels,
       CASE WHEN ok THEN from_json(json_extract(raw, '$.not_labels'), '["VARCHAR"]') END AS not_labels
FROM (SELECT event_id, raw, {_OK} AS ok FROM (SELECT event_id, {_RAW} AS raw FROM events))""")
def json_validate(spark, sf):
    """F-13: strict parse of generated JSON (valid, wrong types, missing keys,
    malformed, null sentence)."""
    g = _raw_json(spark, sf).select("event_id", AN.parse_generated("raw").alias("g"))
    return g.select("event_id", F.col("g").isNotNull().alias("valid"), "g.sentence", "g.labels",
                    "g.not_labels")


def _ok_sql(a: str) -> str:
    return (f"(len({a}) BETWEEN 5 AND 15 AND "
            f"coalesce(list_bool_and(list_transform({a}, lambda x: length({S.strip('x')}) > 0)), true)"
            f" AND len(list_distinct({a})) = len({a}))")


@register("label_conformance", f"""
SELECT doc_id, {_ok_sql('l')} AS labels_ok, {_ok_sql('n')} AS not_labels_ok,
       {_ok_sql('l')} AND {_ok_sql('n')} AS conforms
FROM (SELECT doc_id, string_split(text, chr(10)) AS l, string_split(text, '. ') AS n FROM documents)""")
def label_conformance(spark, sf):
    """F-14: 5..15 distinct non-blank labels and negatives, as flags; the lines
    and the sentences of each whole text stand for them."""
    d = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"), F.split("text", "\\. ").alias("n"))
    return d.select("doc_id", AN.conformance_flags("l", "n").alias("f")).select(
        "doc_id", "f.labels_ok", "f.not_labels_ok", "f.conforms")


_WORDS = f"list_filter(regexp_split_to_array(text, '{TX.PY_WHITESPACE_CLASS}+'), lambda t: t <> '')"


@register("annotate_stub", f"""
SELECT doc_id, text AS sentence, list_filter(w, lambda x: length(x) > 12) AS labels,
       list_filter(w, lambda x: length(x) = 1) AS not_labels
FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents
      WHERE length(text) >= 100 AND length(text) % 7 <> 0)""")
def annotate_stub(spark, sf):
    """J-13 / L-6 / F-15: annotate documents with the deterministic stub
    generator through mapInPandas, parse strictly, skip failures."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    return AN.annotate(d, AN.stub_generator, "text", "doc_id", min_length=100)


@register("batch_numbers", """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 50 + 1 AS BIGINT) AS batch
FROM documents""")
def batch_numbers(spark, sf):
    """A-7: 50 records per numbered batch, in doc_id order."""
    d = read(spark, sf, "documents").select("doc_id")
    return K.batch_numbers(d, "doc_id", 50, 0)


@register("results_roundtrip", with_ctes(*PRED_CTES, CONF, _C0, select=f"""
SELECT {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall, {F1} AS f1, curve.roc_auc,
       (SELECT count(*) FROM pred) AS n_rows
FROM conf, curve"""))
def results_roundtrip(spark, sf):
    """A-8 / A-9 / E-33: pred -> nested results JSON -> read back, flatten,
    recompute metrics."""
    path = _fresh(spark, "results")
    K.write_detail_json(flagship_pred(spark, sf), path)
    p = R.read_results(spark, path)
    b = M.basic_metrics(p, 0.5)
    auc = M.roc_auc(p)
    n = p.agg(F.count(F.lit(1)).alias("n_rows"))
    return b.crossJoin(auc).crossJoin(n)


@register("results_document", with_ctes(*PRED_CTES, select="""
SELECT dense_rank() OVER (ORDER BY sample_id) - 1 AS sample_id,
       CAST(row_number() OVER (PARTITION BY sample_id ORDER BY label_id) AS INTEGER) AS label_id, truth, score FROM pred"""))
def results_document(spark, sf):
    """A-8 / A-9: pred and its metrics as one JSON document in part files, read
    back in ranges of samples."""
    path = _fresh(spark, "document")
    pred = flagship_pred(spark, sf)
    write_results_document(M.basic_metrics(pred, 0.5), pred, path)
    return read_results_document(spark, path)


@register("load_triplets", f"""
SELECT p_partkey AS sample_id, p_name AS text,
       list_concat(
         list_filter(list_transform([p_brand, ' ' || p_type || chr(10)], lambda x: {S.strip('x')}),
                     lambda x: length(x) > 3),
         list_filter(list_transform([p_name, 'ab'], lambda x: {S.strip('x')}), lambda x: length(x) > 3))
         AS ltext,
       list_concat(
         list_transform(list_filter(list_transform([p_brand, ' ' || p_type || chr(10)],
                        lambda x: {S.strip('x')}), lambda x: length(x) > 3), lambda x: 1),
         list_transform(list_filter(list_transform([p_name, 'ab'], lambda x: {S.strip('x')}),
                        lambda x: length(x) > 3), lambda x: 0)) AS lint
FROM part""")
def load_triplets(spark, sf):
    """A-1 / A-2 / B-3 / C-1: triplets written as JSON (text key 'sentence'),
    read back and normalised (min label length 3)."""
    p = read(spark, sf, "part")
    path = _fresh(spark, "triplets")
    p.select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("sentence"),
             F.array("p_brand", F.concat(F.lit(" "), F.col("p_type"), F.lit("\n"))).alias("labels"),
             F.array("p_name", F.lit("ab")).alias("not_labels")).write.json(path)
    return R.load_triplets(spark, path, "json", min_label_length=3)


@register("hierarchy_scan", """
SELECT lower(replace(r.r_name, ' ', '_')) AS "group", n.n_name AS fine
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def hierarchy_scan(spark, sf):
    """A-6 / D-7: region -> nations written as one JSON object file, read back
    as a (group, fine) dimension."""
    nation = read(spark, sf, "nation")
    region = read(spark, sf, "region")
    h = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("g"), "n_name")
    obj = h.groupBy("g").agg(F.sort_array(F.collect_list("n_name")).alias("f")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("g", "f")))).alias("value"))
    path = _fresh(spark, "hierarchy")
    obj.coalesce(1).write.text(path)
    return R.read_hierarchy(spark, path)


@register("pairs_exploded", f"""
SELECT p_partkey AS sample_id, CAST(unnest(range(1, 4)) AS INTEGER) AS label_id,
       unnest(list_transform([p_brand, p_type || '_kind', p_name], lambda c: {S.ensure('c')})) AS label,
       unnest(list_transform(['A', 'B', 'C'], lambda l: CASE WHEN l = (['A', 'B', 'C'])[p_size % 3 + 1]
              THEN 1 ELSE 0 END)) AS truth
FROM part""")
def pairs_exploded(spark, sf):
    """D-2: text x own labels, one row per (sample, label) from MCQ samples."""
    from .normalizers import norm_mcq_struct
    return own_label_pairs(norm_mcq_struct(spark, sf))


@register("argmax_array", """
SELECT vec_id, CAST(list_position(CAST(embedding AS DOUBLE[]),
       list_max(CAST(embedding AS DOUBLE[]))) - 1 AS BIGINT) AS argmax
FROM embeddings""")
def argmax_array(spark, sf):
    """F-17: position of the largest embedding value (first on ties)."""
    e = embedding_vectors(spark, sf).select("vec_id", F.col("v").alias("a"))
    return e.select("vec_id", (F.array_position("a", F.array_max("a")) - 1).alias("argmax"))


_CAMEL_SQL = ("list_aggr(list_transform(string_split(p_name, ' '), "
              "lambda w: upper(w[1]) || w[2:]), 'string_agg', '')")


@register("camel_clean_strings", f"""
SELECT p_partkey,
       {S.strip("'  ' || p_type || chr(10)")} AS stripped,
       {S.ensure("'_' || p_brand || '_ '")} AS ensured,
       lower(regexp_replace({_CAMEL_SQL}, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS snake,
       lower(replace(replace(p_type || ' & ' || p_brand, '&', 'and'), ' ', '_')) AS cleaned_and,
       replace(replace(replace(lower(p_type || ' - ' || p_name), ' ', '_'), '-', 'and'), '&', 'and')
         AS cleaned_multi,
       p_name || chr(10) || p_brand || chr(10) || p_type AS joined,
       ascii(p_type) - 65 AS letter_index,
       {S.uniform('p_partkey', '42')} AS draw
FROM part""")
def camel_clean_strings(spark, sf):
    """F-1 .. F-6 and F-21 on part columns."""
    p = read(spark, sf, "part")
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return p.select(
        "p_partkey",
        TX.py_strip(F.concat(F.lit("  "), "p_type", F.lit("\n"))).alias("stripped"),
        TX.ensure_string(F.concat(F.lit("_"), "p_brand", F.lit("_ "))).alias("ensured"),
        TX.camel_to_snake(camel).alias("snake"),
        TX.clean_name_and(F.concat("p_type", F.lit(" & "), "p_brand")).alias("cleaned_and"),
        TX.clean_label_multi(F.concat("p_type", F.lit(" - "), "p_name")).alias("cleaned_multi"),
        TX.join_fields("p_name", "p_brand", "p_type").alias("joined"),
        TX.letter_index("p_type").alias("letter_index"),
        hash_uniform(F.col("p_partkey"), F.lit(42)).alias("draw"))


_NEG7 = f"""base AS (SELECT p_partkey AS id, {S.ensure('p_name')} AS t, {S.ensure('p_brand')} AS s FROM part),
voc AS (SELECT v, row_number() OVER (ORDER BY {S.num_key('v', '7')}, v) - 1 AS vi
        FROM (SELECT DISTINCT s AS v FROM base WHERE s <> '')),
vn AS (SELECT count(*) AS n FROM voc),
{S.sampled_negatives('7')}"""


@register("vocab_sampled_negatives", with_ctes(_NEG7, select=f"""
SELECT id AS sample_id, t AS text, list(l ORDER BY {S.md5_key('id', 'i', '7')}) AS ltext,
       list(CASE WHEN l = s THEN 1 ELSE 0 END ORDER BY {S.md5_key('id', 'i', '7')}) AS lint
FROM ex GROUP BY id, t, s"""))
def vocab_sampled_negatives(spark, sf):
    """I-4 / F-21: members drawn from the global brand vocabulary (seed 7)."""
    p = read(spark, sf, "part")
    return N.sampled_negatives(p, "p_partkey", "p_name", "p_brand", seed=7)


@register("evaluate_dataset", with_ctes(*PRED_CTES, CONF, _C0, _rank_ctes([1, 3]), select=f"""
SELECT {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall, {F1} AS f1, curve.roc_auc,
       curve.avg_precision,
       (SELECT {_topk_cols(1)['hr']} FROM ss) AS hr_at_1, (SELECT {_topk_cols(3)['hr']} FROM ss) AS hr_at_3,
       (SELECT {_topk_cols(3)['mrr']} FROM ss) AS mrr_at_3,
       (SELECT {_topk_cols(3)['ndcg']} FROM ss) AS ndcg_at_3
FROM conf, curve"""))
def evaluate_dataset(spark, sf):
    """J-11: one scoring pass -> metrics and top-k (only aggregates leave the
    cluster)."""
    return evaluate(flagship_pred(spark, sf).drop("logit"), ks=(1, 3)).select(
        "accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision", "hr_at_1", "hr_at_3", "mrr_at_3", "ndcg_at_3")


@register("assemble_training_corpus", f"""
WITH base AS (SELECT doc_id AS id, CASE WHEN {S.uniform('doc_id', '42', "'split'")} < 0.1
                     THEN 'validation' ELSE 'train' END AS split, 'documents' AS source FROM documents),
extra AS (SELECT id, 'train' AS split, 'benchmark' AS source FROM (SELECT item_id AS id FROM benchmark
               ORDER BY {S.num_key('item_id', '42')}, item_id LIMIT 50000)
          UNION ALL
          SELECT id, 'train', 'pages' FROM (SELECT page_id AS id FROM pages
               ORDER BY {S.num_key('page_id', '42')}, page_id LIMIT 50000))
SELECT split, source, count(*) AS n_rows FROM (SELECT * FROM base UNION ALL SELECT * FROM extra)
GROUP BY ROLLUP (split, source)""")
def assemble_training_corpus(spark, sf):
    """J-14: base corpus split 90/10, extra corpora capped at 50 000 appended to
    train, sizes per (split, source) with totals."""
    docs = SM.split_train_validation(
        read(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id", 0.1, 42)
    docs = docs.withColumn("source", F.lit("documents"))
    extras = SM.union_capped({
        "benchmark": read(spark, sf, "benchmark").select(F.col("item_id").alias("id")),
        "pages": read(spark, sf, "pages").select(F.col("page_id").alias("id"))},
        "id", cap=50_000, seed=42).withColumn("split", F.lit("train"))
    allr = docs.unionByName(extras)
    return allr.rollup("split", "source").agg(F.count(F.lit(1)).alias("n_rows"))


@register("training_corpus", f"""
WITH allr AS (
  SELECT doc_id AS id, CASE WHEN {S.uniform('doc_id', '42', "'split'")} < 0.1 THEN 'validation' ELSE 'train' END AS split,
         'documents' AS source FROM documents
  UNION ALL
  SELECT id, 'train', 'benchmark' FROM (SELECT item_id AS id FROM benchmark ORDER BY {S.num_key('item_id', '42')}, item_id LIMIT 50000)
  UNION ALL
  SELECT id, 'train', 'pages' FROM (SELECT page_id AS id FROM pages ORDER BY {S.num_key('page_id', '42')}, page_id LIMIT 50000))
SELECT row_number() OVER (ORDER BY {S.num_key('source', 'id', '42')}, source, id) - 1 AS sample_id, id, split, source FROM allr""")
def training_corpus(spark, sf):
    """J-14 / A-2: the assembled corpus itself, re-keyed in one seeded order."""
    ids = {t: read(spark, sf, t).select(F.col(c).alias("id"))
           for t, c in (("documents", "doc_id"), ("benchmark", "item_id"), ("pages", "page_id"))}
    return SM.assemble_corpus(ids.pop("documents"), ids, "id", "documents", 0.1, 50_000, 42).select("sample_id", "id", "split", "source")
