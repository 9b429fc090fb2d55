"""Queries for API surfaces that the other plan modules reach only inside
composites: validated load (A-3), the corpus registry (A-4 / A-5), the fine
hierarchy (C-21), own-label gathering (D-4), the threshold grid (F-18),
score regrouping (J-12), multi-class best metrics (E-3 / E-23) and the
auto-mode bundle (E-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import normalize as N
from ..operators.classify import regroup_scores, score_own_labels
from ..operators.metrics.threshold import threshold_grid
from ..sources.readers import Registry, load_validated
from .normalizers import _val_src, norm_mcq_index
from .registry import register, with_ctes
from .scoring import PRED_CTES, SQL_EMB
from .tables import embedding_vectors, flagship_pred, read
from .metrics import SAMPLE_ARGMAX, PER_CLASS, _div
from .training import _NLI, _nli_pairs, ENTAIL
from . import sqlfn as S


@register("load_validated", with_ctes("""src AS (SELECT doc_id AS sample_id,
   CASE WHEN doc_id % 7 = 0 THEN ' _ ' ELSE text END AS text,
   CASE WHEN doc_id % 5 = 0 THEN [source, '_'] WHEN doc_id % 13 = 0 THEN CAST([] AS VARCHAR[])
        ELSE [source, lang] END AS ltext,
   CASE WHEN doc_id % 11 = 0 THEN [1] ELSE [1, 0] END AS lint FROM documents)""", select=f"""
SELECT sample_id, text, ltext, lint FROM src
WHERE {S.ensure('text')} <> '' AND len(ltext) > 0
  AND list_bool_and(list_transform(ltext, lambda x: {S.ensure('x')} <> ''))
  AND len(lint) = len(ltext)"""))
def load_validated_q(spark, sf):
    """A-3: read -> map -> canonical columns -> validate, through the reader."""
    return load_validated(spark, lambda: _val_src(spark, sf))


def _registry():
    reg = Registry()

    @reg.register("part_mcq", role="train")
    def _mcq(spark, sf):
        return norm_mcq_index(spark, sf)

    @reg.register("doc_source", role="eval")
    def _src(spark, sf):
        d = read(spark, sf, "documents").select("doc_id", "text", "source")
        return N.vocab_onehot(d, "doc_id", "text", "source", clean=False)
    return reg


@register("registry_union", """
SELECT 'doc_source' AS corpus, 'eval' AS role, count(*) AS n_samples,
       CAST(sum((SELECT count(DISTINCT source) FROM documents)) AS BIGINT) AS n_pairs FROM documents
UNION ALL
SELECT 'part_mcq', 'train', count(*), CAST(sum(3) AS BIGINT) FROM part""")
def registry_union(spark, sf):
    """A-4 / A-5: load every registered corpus by name and role, union them."""
    reg = _registry()
    out = None
    for role in ("train", "eval"):
        for name in reg.names(role):
            d = reg.load(spark, name, sf).select(
                F.lit(name).alias("corpus"), F.lit(role).alias("role"), "ltext")
            out = d if out is None else out.unionByName(d)
    return out.groupBy("corpus", "role").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.size("ltext")).cast("long").alias("n_pairs"))


@register("norm_hierarchy_fine", """
WITH voc AS (SELECT list(DISTINCT n_name ORDER BY n_name) AS vocab FROM nation n
             JOIN customer c ON c.c_nationkey = n.n_nationkey)
SELECT c.c_custkey AS sample_id, c.c_name AS text, vocab AS ltext, """ + S.onehot("vocab", "n.n_name") + """ AS lint
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey, voc""")
def norm_hierarchy_fine(spark, sf):
    """C-21 with grouped=False: the labels of the data are the classes."""
    nation = read(spark, sf, "nation")
    region = read(spark, sf, "region")
    hier = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("group"), F.col("n_name").alias("fine"))
    cust = read(spark, sf, "customer").join(
        nation.select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey"))
    return N.hierarchy_rollup(cust, "c_custkey", "c_name", "n_name", hier, grouped=False)


@register("score_own_labels", with_ctes(SQL_EMB, """tv AS (SELECT vec_id // 10 AS sample_id, v FROM e
    WHERE vec_id % 10 = 0),
lv AS (SELECT vec_id // 10 AS sample_id, CAST(vec_id % 10 AS INTEGER) AS label_id, v FROM e
    WHERE vec_id % 10 <> 0)""", select="""
SELECT lv.sample_id, lv.label_id,
       1.0 / (1.0 + exp(-(list_cosine_similarity(tv.v, lv.v) * exp(2.0)))) AS score
FROM lv JOIN tv ON lv.sample_id = tv.sample_id"""))
def score_own_labels_q(spark, sf):
    """D-4: label rows gather their own text vector by sample id, then score."""
    e = embedding_vectors(spark, sf)
    sid = (F.col("vec_id") / 10).cast("long").alias("sample_id")
    pos = F.pmod("vec_id", F.lit(10))
    texts = e.filter(pos == 0).select(sid, F.col("v").alias("text_vec"))
    labels = e.filter(pos != 0).select(sid, pos.cast("int").alias("label_id"),
                                       F.col("v").alias("label_vec"))
    return score_own_labels(texts, labels).select("sample_id", "label_id", "score")


@register("threshold_grid", with_ctes(*PRED_CTES, select="""
SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99.0) + lo END AS threshold
FROM (SELECT min(score) AS lo, max(score) AS hi FROM pred), range(100) r(i)"""))
def threshold_grid_q(spark, sf):
    """F-18: 100 evenly spaced thresholds from min to max score."""
    p = flagship_pred(spark, sf)
    g = p.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return g.select(F.posexplode(threshold_grid(F.col("lo"), F.col("hi"), 100)).alias("i", "threshold"))


@register("nli_regrouped", with_ctes(SQL_EMB, _NLI, select=f"""
SELECT sample_id, list(score ORDER BY label_id) AS scores FROM (
  SELECT sample_id, label_id, ex / sum(ex) OVER (PARTITION BY sample_id) AS score
  FROM (SELECT sample_id, label_id,
               exp(lg[{ENTAIL + 1}] - max(lg[{ENTAIL + 1}]) OVER (PARTITION BY sample_id)) AS ex FROM nli))
GROUP BY sample_id"""))
def nli_regrouped(spark, sf):
    """J-12: flat per-pair scores regrouped into one array per sample."""
    from ..functions.activation import nli_pair_score, softmax_over
    p = _nli_pairs(spark, sf).withColumn("logit", nli_pair_score("logits", "softmax", ENTAIL))
    return regroup_scores(softmax_over(p, ["sample_id"], "logit", "score"))


@register("best_metrics_multi", with_ctes(*PRED_CTES, SAMPLE_ARGMAX, PER_CLASS, select="""
SELECT (SELECT avg(CASE WHEN true_class = pred_class THEN 1.0 ELSE 0.0 END) FROM sa) AS accuracy,
       sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
       sum(f1 * support) / sum(support) AS f1 FROM rep"""))
def best_metrics_multi(spark, sf):
    """E-23 multi=True / E-3: argmax classes, accuracy and weighted P/R/F1."""
    return M.weighted_metrics(M.sample_argmax(flagship_pred(spark, sf)))


@register("metric_bundle_auto", with_ctes(*PRED_CTES, """ps AS (SELECT sample_id,
   count(*) FILTER (WHERE (score > 0.5) <> (truth = 1)) AS wrong,
   first(label_id ORDER BY truth DESC, label_id ASC) AS tc,
   first(label_id ORDER BY score DESC, label_id ASC) AS pc FROM pred GROUP BY sample_id)""",
                                         """conf AS (SELECT count(*) FILTER (WHERE score > 0.5 AND truth = 1) AS tp,
   count(*) FILTER (WHERE score > 0.5 AND truth <> 1) AS fp,
   count(*) FILTER (WHERE score <= 0.5 AND truth = 1) AS fn FROM pred)""", select=f"""
SELECT 'multiclass' AS problem_type,
       (SELECT avg(CASE WHEN wrong = 0 THEN 1.0 ELSE 0.0 END) FROM ps) AS accuracy,
       {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
       {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
       (SELECT avg(CASE WHEN tc = pc THEN 1.0 ELSE 0.0 END) FROM ps) AS match_accuracy,
       (SELECT count(*) FROM pred) AS support, CAST(0.5 AS DOUBLE) AS threshold,
       (SELECT CAST(sum(truth) AS BIGINT) FROM pred) AS num_positive,
       (SELECT avg(score) FROM pred) AS avg_probability
FROM conf"""))
def metric_bundle_auto(spark, sf):
    """E-16 mode='auto': one-hot truth is detected as multi-class; the
    columns of the other problem types are NULL (dropped here)."""
    b = M.metric_bundle(flagship_pred(spark, sf).drop("logit"), 0.5, mode="auto")
    return b.select("problem_type", "accuracy", "precision", "recall", "f1", "match_accuracy",
                    "support", "threshold", "num_positive", "avg_probability")


def _length_ratio_model():
    """Stand-in for a user model (e.g. a pair classifier): score =
    len(label) / (len(label) + len(text)).  Built once per task."""
    def model(texts, labels):
        lt, ll = texts.str.len(), labels.str.len()
        return ll / (ll + lt)
    return model


@register("external_scorer", """
SELECT p_partkey AS sample_id, CAST(unnest(range(1, 3)) AS INTEGER) AS label_id,
       unnest([length(p_brand) / (length(p_brand) + length(p_name)),
               length(p_type) / (length(p_type) + length(p_name))]) AS score
FROM part""")
def external_scorer(spark, sf):
    """L-6: pair scores from a user model through Arrow batches (mapInPandas)."""
    from ..operators.classify import own_label_pairs, score_with_model
    p = read(spark, sf, "part").select(
        F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("text"),
        F.array("p_brand", "p_type").alias("ltext"),
        F.array(F.lit(1), F.lit(0)).alias("lint"))
    pairs = own_label_pairs(p).join(p.select("sample_id", "text"), on="sample_id")
    return score_with_model(pairs, _length_ratio_model).select("sample_id", "label_id", "score")


def _ml_bundle_sql() -> str:
    from .metrics import CONF, F1, HL, JAC, ML_PRED, PREC, REC, _curve_sql
    curve, _ = _curve_sql("label_id")
    return with_ctes(ML_PRED, "pred AS (SELECT * FROM mlpred)", CONF, curve, """ps AS (
  SELECT sample_id, count(*) FILTER (WHERE score > 0.5 AND truth = 1) AS inter,
         count(*) FILTER (WHERE score > 0.5 OR truth = 1) AS uni,
         count(*) FILTER (WHERE (score > 0.5) <> (truth = 1)) AS wrong FROM pred GROUP BY sample_id),
cov AS (SELECT sample_id, count(*) FILTER (WHERE lo IS NOT NULL AND score >= lo) AS c FROM (
  SELECT sample_id, score, min(CASE WHEN truth = 1 THEN score END) OVER (PARTITION BY sample_id) AS lo
  FROM pred) GROUP BY sample_id),
lr AS (SELECT sample_id, CASE WHEN np = 0 OR np = n THEN 1.0 ELSE ap END AS v FROM (
  SELECT sample_id, avg(CASE WHEN truth = 1 THEN p_above / CAST(n_above AS DOUBLE) END) AS ap,
         count(*) FILTER (WHERE truth = 1) AS np, count(*) AS n FROM (
    SELECT sample_id, truth,
      count(*) OVER (PARTITION BY sample_id ORDER BY score DESC
                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_above,
      sum(truth) OVER (PARTITION BY sample_id ORDER BY score DESC
                       RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_above FROM pred)
  GROUP BY sample_id))""", select=f"""
SELECT 'multilabel' AS problem_type,
       (SELECT avg(CASE WHEN wrong = 0 THEN 1.0 ELSE 0.0 END) FROM ps) AS accuracy,
       {PREC} AS precision, {REC} AS recall, {F1} AS f1,
       CAST(NULL AS DOUBLE) AS jaccard, CAST(NULL AS DOUBLE) AS hamming_loss,
       CAST(NULL AS DOUBLE) AS matthews_corrcoef, CAST(NULL AS DOUBLE) AS roc_auc,
       CAST(NULL AS DOUBLE) AS avg_precision, CAST(NULL AS DOUBLE) AS match_accuracy,
       (SELECT avg(CASE WHEN uni = 0 THEN 1.0 ELSE inter / CAST(uni AS DOUBLE) END) FROM ps)
         AS hamming_score,
       (SELECT avg(CASE WHEN uni = 0 THEN 0.0 ELSE inter / CAST(uni AS DOUBLE) END) FROM ps)
         AS jaccard_samples,
       (SELECT avg(c) FROM cov) AS coverage_error,
       (SELECT avg(v) FROM lr) AS label_ranking_avg_precision,
       (SELECT avg(roc_auc) FROM curve) AS roc_auc_macro,
       (SELECT avg(avg_precision) FROM curve) AS avg_precision_macro,
       {JAC} AS jaccard_micro, {HL} AS hamming_loss_multilabel,
       tp + fp + fn + tn AS support, CAST(0.5 AS DOUBLE) AS threshold,
       tp + fn AS num_positive, (SELECT avg(score) FROM pred) AS avg_probability
FROM conf""")


@register("metric_bundle_multilabel", _ml_bundle_sql())
def metric_bundle_multilabel(spark, sf):
    """E-16 mode='auto' on the multi-hot quality / toxic fixture: the
    multilabel branch (samples metrics, ranking metrics, macro curves)."""
    from .tables import multilabel_pred
    return M.metric_bundle(multilabel_pred(spark, sf), 0.5, mode="auto")


def _bin_bundle_sql() -> str:
    from .metrics import ACC, CONF, F1, HL, JAC, MCC, PREC, REC, _C0
    return with_ctes("""pred AS (SELECT l.doc_id AS sample_id, 1 AS label_id, l.quality AS truth,
                    round(d.n_chars / (d.n_chars + 2000.0), 6) AS score
             FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""", CONF, _C0, select=f"""
SELECT 'binary' AS problem_type, {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall,
       {F1} AS f1, {JAC} AS jaccard, {HL} AS hamming_loss, {MCC} AS matthews_corrcoef,
       curve.roc_auc, curve.avg_precision, CAST(NULL AS DOUBLE) AS match_accuracy,
       CAST(NULL AS DOUBLE) AS hamming_score, CAST(NULL AS DOUBLE) AS jaccard_samples,
       CAST(NULL AS DOUBLE) AS coverage_error, CAST(NULL AS DOUBLE) AS label_ranking_avg_precision,
       CAST(NULL AS DOUBLE) AS roc_auc_macro, CAST(NULL AS DOUBLE) AS avg_precision_macro,
       CAST(NULL AS DOUBLE) AS jaccard_micro, CAST(NULL AS DOUBLE) AS hamming_loss_multilabel,
       tp + fp + fn + tn AS support, CAST(0.5 AS DOUBLE) AS threshold, tp + fn AS num_positive,
       (SELECT avg(score) FROM pred) AS avg_probability
FROM conf, curve""")


@register("metric_bundle_binary", _bin_bundle_sql())
def metric_bundle_binary(spark, sf):
    """E-16 mode='auto' on a binary task (document quality vs a length score):
    one label per sample, so the binary columns are filled."""
    from .tables import multilabel_pred
    p = multilabel_pred(spark, sf).filter(F.col("label_id") == 1)
    return M.metric_bundle(p, 0.5, mode="auto")


_CAL = """s AS (SELECT label, truth, score, least(floor(score * 10), 9) AS bin,
                  least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM pred),
b AS (SELECT label, bin, abs(sum(score) - sum(truth)) AS gap FROM s GROUP BY label, bin)"""


@register("user_metrics", with_ctes(*PRED_CTES, _CAL, select="""
SELECT s.label, avg((score - truth) * (score - truth)) AS brier,
       -avg(CASE WHEN truth = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss,
       any_value(g.gap) / count(*) AS ece
FROM s JOIN (SELECT label, sum(gap) AS gap FROM b GROUP BY label) g ON g.label = s.label GROUP BY s.label"""))
def user_metrics_q(spark, sf):
    """L-5: Brier score, log loss and calibration error by name, per label."""
    return M.user_metrics(flagship_pred(spark, sf), ["brier", "log_loss", "ece"], ["label"])


@register("numbered_files", """
SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // 50 + 1 AS BIGINT) AS batch, doc_id, text, lang FROM documents""")
def numbered_files(spark, sf):
    """A-7 / A-8: documents written to files batch_0001.json ... of 50 records
    each, and read back with the number of their file."""
    import uuid

    from ..session import scratch_path
    from ..sources.numbered import read_numbered, write_numbered
    d = read(spark, sf, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, f"numbered-{uuid.uuid4().hex}")
    write_numbered(d, path, "doc_id", 50)
    return read_numbered(spark, path, d.schema).select("batch", "doc_id", "text", "lang")


#: Corpora over the given tables, as configuration.
SPECS = [
    {"name": "part_choices", "table": "part", "shape": "mcq_index", "role": "train", "columns": {
        "sample_id": "p_partkey", "question": "p_name", "choices": "array(p_brand, p_type, p_name)", "answer": "p_size % 3"}},
    {"name": "part_letters", "table": "part", "shape": "letter_answer", "role": "train", "columns": {
        "sample_id": "p_partkey", "question": "p_name", "article": "p_type", "options": "array(p_brand, p_type)",
        "answer": "if(p_size % 2 = 0, 'A', 'B')"}},
    {"name": "doc_origin", "table": "documents", "shape": "triplets", "role": "train", "options": {"min_label_length": 2},
     "columns": {"sample_id": "doc_id", "text": "text", "positives": "array(source)", "negatives": "array(lang, 'unknown')"}},
    {"name": "item_parity", "table": "benchmark", "shape": "binary_answer", "role": "train", "columns": {
        "sample_id": "item_id", "question": "text", "answer": "item_id % 2"}},
    {"name": "doc_quality", "table": "labels", "shape": "binary_names", "role": "eval", "options": {"names": ["poor", "good"]},
     "columns": {"sample_id": "doc_id", "text": "concat('document ', doc_id)", "label": "quality"}},
    {"name": "turn_roles", "table": "conversations", "shape": "all_positive", "role": "eval", "columns": {
        "sample_id": "conv_id * 1000 + turn", "text": "text", "labels": "array(role)"}},
    {"name": "doc_languages", "table": "documents", "shape": "vocab_onehot", "role": "eval", "options": {"clean": False},
     "columns": {"sample_id": "doc_id", "text": "source", "target": "lang"}},
]


def _stripped(labels: str) -> str:
    return f"list_filter(list_transform({labels}, lambda x: {S.strip('x')}), lambda x: length(x) > 2)"


_POS, _NEG = _stripped("[source]"), _stripped("[lang, 'unknown']")


@register("spec_corpus", f"""
SELECT 'part_choices' AS corpus, 'train' AS role, p_partkey AS sample_id, {S.ensure('p_name')} AS text,
       list_transform([p_brand, p_type, p_name], lambda x: {S.ensure('x')}) AS ltext,
       list_transform([0, 1, 2], lambda i: CASE WHEN i = p_size % 3 THEN 1 ELSE 0 END) AS lint FROM part
UNION ALL
SELECT 'part_letters', 'train', p_partkey, {S.ensure("p_name || chr(10) || p_type")},
       list_transform([p_brand, p_type], lambda x: {S.ensure('x')}),
       CASE WHEN p_size % 2 = 0 THEN [1, 0] ELSE [0, 1] END FROM part
UNION ALL
SELECT 'doc_origin', 'train', doc_id, text, list_concat({_POS}, {_NEG}),
       list_concat(list_transform({_POS}, lambda x: 1), list_transform({_NEG}, lambda x: 0)) FROM documents
UNION ALL
SELECT 'item_parity', 'train', item_id, {S.ensure('text')}, ['false', 'true'],
       [CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN item_id % 2 = 1 THEN 1 ELSE 0 END] FROM benchmark
UNION ALL
SELECT 'doc_quality', 'eval', doc_id, 'document ' || CAST(doc_id AS VARCHAR), ['poor', 'good'],
       [CASE WHEN quality = 0 THEN 1 ELSE 0 END, CASE WHEN quality = 1 THEN 1 ELSE 0 END] FROM labels
UNION ALL
SELECT 'turn_roles', 'eval', conv_id * 1000 + turn, {S.ensure('text')}, [{S.ensure('role')}], [1] FROM conversations
UNION ALL
SELECT 'doc_languages', 'eval', doc_id, source, v.vocab, list_transform(v.vocab, lambda x: CASE WHEN x = lang THEN 1 ELSE 0 END)
FROM documents, (SELECT list(DISTINCT lang ORDER BY lang) AS vocab FROM documents) v""")
def spec_corpus(spark, sf):
    """A-4 / A-5: corpora from configuration, all samples of both roles."""
    from ..sources.specs import corpus, load_specs
    return corpus(load_specs(SPECS), lambda name: read(spark, sf, name))


@register("quarantined_load", """
SELECT reason, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
  SELECT CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END AS id,
         CASE WHEN doc_id % 5 = 0 THEN 'corrupt_record' WHEN doc_id % 7 = 0 THEN 'empty_text'
              WHEN doc_id % 3 = 0 THEN 'no_labels' WHEN doc_id % 11 = 0 THEN 'truth_length' ELSE 'valid' END AS reason
  FROM documents) GROUP BY reason""")
def quarantined_load(spark, sf):
    """A-3 / B-7: documents written as JSON lines, a fifth of them cut off, read
    back with a reason for every line that gives no sample."""
    import uuid

    from ..session import scratch_path
    from ..sources.quarantine import load_quarantined
    from ..sources.readers import SAMPLE_SCHEMA
    d = read(spark, sf, "documents")
    at = lambda n: F.col("doc_id") % n == 0
    line = F.to_json(F.struct(
        F.col("doc_id").alias("sample_id"), F.when(at(7), F.lit(" ")).otherwise(F.concat(F.lit("x "), F.coalesce("text", F.lit("")))).alias("text"),
        F.when(at(3), F.array().cast("array<string>")).otherwise(F.array("source", "lang")).alias("ltext"),
        F.when(at(11), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0))).alias("lint")))
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    d.select(F.when(at(5), F.substring(line, 1, 25)).otherwise(line).alias("value")).write.text(path)
    got = load_quarantined(spark, path, SAMPLE_SCHEMA)
    ids = F.get_json_object("record", "$.sample_id").cast("long")
    return got.samples.select(F.lit("valid").alias("reason"), F.col("sample_id").alias("id")).unionAll(
        got.rejected.select("reason", F.coalesce(F.when(F.col("reason") != "corrupt_record", ids), F.lit(0)))
    ).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@register("expand_choices", """
SELECT p_partkey, p_name, CAST(unnest(range(1, 4)) AS INTEGER) AS label_id, unnest([p_brand, p_type, p_name]) AS label,
       unnest(list_transform([0, 1, 2], lambda i: CASE WHEN i = p_size % 3 THEN 1 ELSE 0 END)) AS truth FROM part""")
def expand_choices(spark, sf):
    """L-2: rows to samples by a table function that SQL calls with PARTITION BY."""
    from ..sources.expander import register_expander
    name = register_expander(spark)
    p = read(spark, sf, "part").selectExpr("p_partkey", "p_name", "array(p_brand, p_type, p_name) AS choices", "p_size % 3 AS answer")
    return spark.sql(f"SELECT * FROM {name}(TABLE({{p}}) PARTITION BY (p_partkey), 'choices', 'answer')", p=p)
