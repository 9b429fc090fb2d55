"""Metric queries (E-1 .. E-24, D-6) on the ``pred`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.evaluate import evaluate
from ..operators.classify import attach_scores
from .registry import register, with_ctes
from .scoring import (BILINEAR, DOT_WEIGHTS, DOT_BIAS, PRED_CTES, SQL_BIL_PAIRS, SQL_DOT_PAIRS)
from .tables import flagship_pred, multilabel_pred, scored_pairs

CONF = """conf AS (SELECT count(*) FILTER (WHERE score > 0.5 AND truth = 1) AS tp,
                      count(*) FILTER (WHERE score > 0.5 AND truth <> 1) AS fp,
                      count(*) FILTER (WHERE score <= 0.5 AND truth = 1) AS fn,
                      count(*) FILTER (WHERE score <= 0.5 AND truth <> 1) AS tn FROM pred)"""


def _div(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN 0.0 ELSE ({n}) / CAST(({d}) AS DOUBLE) END"


ACC = _div("tp + tn", "tp + fp + fn + tn")
PREC = _div("tp", "tp + fp")
REC = _div("tp", "tp + fn")
F1 = _div("2 * tp", "2 * tp + fp + fn")
JAC = _div("tp", "tp + fp + fn")
HL = _div("fp + fn", "tp + fp + fn + tn")
MCC_DEN = ("CAST(tp + fp AS DOUBLE) * CAST(tp + fn AS DOUBLE) * CAST(tn + fp AS DOUBLE)"
           " * CAST(tn + fn AS DOUBLE)")
MCC = (f"CASE WHEN {MCC_DEN} = 0 THEN 0.0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)"
       f" / sqrt({MCC_DEN}) END")


def pred(spark, sf):
    return flagship_pred(spark, sf).drop("logit")


@register("confusion", with_ctes(*PRED_CTES, CONF, select="SELECT tp, fp, fn, tn FROM conf"))
def confusion(spark, sf):
    """E-1: TP / FP / FN / TN at 0.5."""
    return M.confusion_counts(pred(spark, sf), 0.5)


@register("basic_binary", with_ctes(*PRED_CTES, CONF, select=f"""
SELECT {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall, {F1} AS f1 FROM conf"""))
def basic_binary(spark, sf):
    """E-2: accuracy / precision / recall / F1 over all cells."""
    return M.basic_metrics(pred(spark, sf), 0.5)


SAMPLE_ARGMAX = """sa AS (SELECT sample_id,
   first(label_id ORDER BY truth DESC, label_id ASC) AS true_class,
   first(label_id ORDER BY score DESC, label_id ASC) AS pred_class FROM pred GROUP BY sample_id)"""
PER_CLASS = """pc AS (SELECT class, sum(t) AS support, sum(p) AS n_pred, sum(h) AS tp FROM (
   SELECT CAST(true_class AS VARCHAR) AS class, 1 AS t, 0 AS p,
          CASE WHEN true_class = pred_class THEN 1 ELSE 0 END AS h FROM sa
   UNION ALL
   SELECT CAST(pred_class AS VARCHAR), 0, 1, 0 FROM sa) GROUP BY class),
rep AS (SELECT class, """ + _div("tp", "n_pred") + """ AS precision, """ + _div("tp", "support") + """
          AS recall, """ + _div("2 * tp", "support + n_pred") + """ AS f1,
          CAST(support AS BIGINT) AS support FROM pc)"""


@register("weighted_report", with_ctes(*PRED_CTES, SAMPLE_ARGMAX, PER_CLASS, select="""
SELECT class, precision, recall, f1, support FROM rep
UNION ALL
SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM rep
UNION ALL
SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM rep"""))
def weighted_report(spark, sf):
    """E-3: per-class report with macro and weighted averages (argmax class)."""
    s = M.sample_argmax(pred(spark, sf))
    return M.classification_report(s)


@register("jaccard", with_ctes(*PRED_CTES, CONF, select=f"SELECT {JAC} AS jaccard FROM conf"))
def jaccard(spark, sf):
    """E-4 binary Jaccard."""
    return M.jaccard(pred(spark, sf), 0.5)


@register("hamming_loss", with_ctes(*PRED_CTES, select="""
SELECT avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) <> truth THEN 1.0 ELSE 0.0 END)
       AS hamming_loss FROM pred"""))
def hamming_loss(spark, sf):
    """E-5."""
    return M.hamming_loss(pred(spark, sf), 0.5)


@register("mcc", with_ctes(*PRED_CTES, CONF, select=f"SELECT {MCC} AS matthews_corrcoef FROM conf"))
def mcc(spark, sf):
    """E-6: Matthews correlation."""
    return M.matthews(pred(spark, sf), 0.5)


@register("diag_stats", with_ctes(*PRED_CTES, select="""
SELECT count(*) AS support, CAST(0.5 AS DOUBLE) AS threshold, CAST(sum(truth) AS BIGINT) AS num_positive,
       avg(score) AS avg_probability FROM pred"""))
def diag_stats(spark, sf):
    """E-14: support, threshold, positives, mean probability."""
    return M.diagnostic_stats(pred(spark, sf), 0.5)


@register("match_accuracy", with_ctes(*PRED_CTES, SAMPLE_ARGMAX, select="""
SELECT avg(CASE WHEN true_class = pred_class THEN 1.0 ELSE 0.0 END) AS match_accuracy FROM sa"""))
def match_accuracy(spark, sf):
    """E-13: argmax(score) == argmax(truth) per sample."""
    return M.match_accuracy(pred(spark, sf))


def _curve_sql(keys: str) -> tuple[str, str]:
    """CTEs computing per-key roc_auc / avg_precision with plain windows."""
    k = (keys + ", ") if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    on = " AND ".join(f"r.{x.strip()} = t.{x.strip()}" for x in keys.split(",")) if keys else "TRUE"
    grp = f"GROUP BY {', '.join('r.' + x.strip() for x in keys.split(','))}, t.tp, t.tn" \
        if keys else "GROUP BY t.tp, t.tn"
    sel = ", ".join("r." + x.strip() for x in keys.split(",")) + ", " if keys else ""
    ctes = f"""cc AS (SELECT {k}score, sum(truth) AS pos, sum(1 - truth) AS neg FROM pred
        GROUP BY {k}score),
rr AS (SELECT {k}score, pos, neg,
   coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
   coalesce(sum(pos) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb
   FROM cc),
tt AS (SELECT {k}sum(pos) AS tp, sum(neg) AS tn FROM cc {"GROUP BY " + keys if keys else ""}),
curve AS (SELECT {sel}
   CASE WHEN t.tp > 0 AND t.tn > 0 THEN sum(r.pos * (r.nb + r.neg / 2.0)) / (CAST(t.tp AS DOUBLE) * t.tn) END
     AS roc_auc,
   CASE WHEN t.tp > 0 THEN sum(r.pos * ((t.tp - r.pb) / CAST(t.tp + t.tn - r.pb - r.nb AS DOUBLE)))
     / t.tp ELSE 0.0 END AS avg_precision
   FROM rr r JOIN tt t ON {on} {grp})"""
    return ctes, "curve"


_C0, _ = _curve_sql("")
_CL, _ = _curve_sql("label_id")


@register("roc_auc", with_ctes(*PRED_CTES, _C0, select="SELECT roc_auc FROM curve"))
def roc_auc(spark, sf):
    """E-8: binary ROC-AUC with mid-rank ties."""
    return M.roc_auc(pred(spark, sf))


@register("avg_precision", with_ctes(*PRED_CTES, _C0, select="SELECT avg_precision FROM curve"))
def avg_precision(spark, sf):
    """E-10: average precision."""
    return M.average_precision(pred(spark, sf))


@register("roc_auc_macro", with_ctes(*PRED_CTES, _CL, select="""
SELECT avg(roc_auc) AS roc_auc_macro FROM curve"""))
def roc_auc_macro(spark, sf):
    """E-9: macro ROC-AUC over label columns."""
    return M.macro_curve(pred(spark, sf)).select("roc_auc_macro")


@register("avg_precision_macro", with_ctes(*PRED_CTES, _CL, select="""
SELECT avg(avg_precision) AS avg_precision_macro FROM curve"""))
def avg_precision_macro(spark, sf):
    """E-10 macro."""
    return M.macro_curve(pred(spark, sf)).select("avg_precision_macro")


ML_PRED = """docs AS (SELECT doc_id, n_chars FROM documents),
mlj AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN docs d ON l.doc_id = d.doc_id),
mlpred AS (
  SELECT doc_id AS sample_id, 1 AS label_id, 'quality' AS label, quality AS truth,
         round(n_chars / (n_chars + 2000.0), 6) AS score FROM mlj
  UNION ALL
  SELECT doc_id, 2, 'toxic', toxic, round(((doc_id * 37 + n_chars) % 1000) / 1000.0, 6) FROM mlj)"""
SETS = """ps AS (SELECT sample_id,
   count(*) FILTER (WHERE score > 0.5 AND truth = 1) AS inter,
   count(*) FILTER (WHERE score > 0.5 OR truth = 1) AS uni,
   count(*) FILTER (WHERE (score > 0.5) <> (truth = 1)) AS wrong FROM mlpred GROUP BY sample_id)"""


@register("hamming_score", with_ctes(ML_PRED, SETS, select="""
SELECT avg(CASE WHEN uni = 0 THEN 1.0 ELSE inter / CAST(uni AS DOUBLE) END) AS hamming_score,
       avg(CASE WHEN wrong = 0 THEN 1.0 ELSE 0.0 END) AS subset_accuracy FROM ps"""))
def hamming_score(spark, sf):
    """E-7 (and exact-match accuracy) on the multi-hot quality/toxic fixture."""
    return M.sample_set_metrics(multilabel_pred(spark, sf), 0.5).select(
        "hamming_score", "subset_accuracy")


@register("jaccard_samples", with_ctes(ML_PRED, SETS, select="""
SELECT avg(CASE WHEN uni = 0 THEN 0.0 ELSE inter / CAST(uni AS DOUBLE) END) AS jaccard_samples
FROM ps"""))
def jaccard_samples(spark, sf):
    """E-4 samples-average Jaccard (both empty -> 0)."""
    return M.sample_set_metrics(multilabel_pred(spark, sf), 0.5).select("jaccard_samples")


@register("coverage_error", with_ctes(*PRED_CTES, select="""
SELECT avg(cov) AS coverage_error FROM (
  SELECT sample_id, count(*) FILTER (WHERE lo IS NOT NULL AND score >= lo) AS cov FROM (
    SELECT sample_id, score,
           min(CASE WHEN truth = 1 THEN score END) OVER (PARTITION BY sample_id) AS lo FROM pred)
  GROUP BY sample_id)"""))
def coverage_error(spark, sf):
    """E-11."""
    return M.coverage_error(pred(spark, sf))


@register("lrap", with_ctes(*PRED_CTES, select="""
SELECT avg(CASE WHEN np = 0 OR np = n THEN 1.0 ELSE ap END) AS label_ranking_avg_precision FROM (
  SELECT sample_id, avg(CASE WHEN truth = 1 THEN p_above / CAST(n_above AS DOUBLE) END) AS ap,
         count(*) FILTER (WHERE truth = 1) AS np, count(*) AS n FROM (
    SELECT sample_id, truth,
      count(*) OVER (PARTITION BY sample_id ORDER BY score DESC
                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_above,
      sum(truth) OVER (PARTITION BY sample_id ORDER BY score DESC
                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_above FROM pred)
  GROUP BY sample_id)"""))
def lrap(spark, sf):
    """E-12: label-ranking average precision."""
    return M.label_ranking_ap(pred(spark, sf))


@register("problem_type", with_ctes(*PRED_CTES, select="""
SELECT max(n) AS max_labels, max(rt) AS max_row_truth, max(n) > 1 AS is_multilabel,
       max(n) > 1 AND max(rt) = 1 AS is_onehot,
       CASE WHEN max(n) > 1 AND max(rt) = 1 THEN 'multiclass' WHEN max(n) > 1 THEN 'multilabel'
            ELSE 'binary' END AS problem_type
FROM (SELECT sample_id, count(*) AS n, CAST(sum(truth) AS BIGINT) AS rt FROM pred GROUP BY sample_id)"""))
def problem_type(spark, sf):
    """E-15: problem-type detection."""
    return M.problem_type(pred(spark, sf))


def _rank_ctes(ks):
    cols = []
    for k in ks:
        cols += [
            f"max(CASE WHEN pos <= {k} AND truth = 1 THEN 1 ELSE 0 END) AS hit_{k}",
            f"min(CASE WHEN pos <= {k} AND truth = 1 THEN pos END) AS best_{k}",
            f"max(CASE WHEN pos <= {k} AND truth = 1 THEN pos END) AS worst_{k}",
            f"count(*) FILTER (WHERE pos <= {k} AND truth = 1) AS hits_{k}",
            f"sum(CASE WHEN pos <= {k} THEN gain / log2(pos + 1) ELSE 0.0 END) AS dcg_{k}",
        ]
    return f"""rk AS (SELECT sample_id, label_id, truth, score,
   row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, label_id DESC) AS pos,
   avg(truth) OVER (PARTITION BY sample_id, score) AS gain FROM pred),
ss AS (SELECT sample_id, sum(truth) AS npos, count(*) AS nlab, {", ".join(cols)}
   FROM rk GROUP BY sample_id)"""


def _idcg(k: int) -> str:
    return (f"coalesce(list_sum(list_transform(range(1, CAST(least(npos, {k}) AS BIGINT) + 1), "
            f"lambda i: 1.0 / log2(i + 1))), 0.0)")


def _topk_cols(k: int, mrr: str = "standard") -> dict[str, str]:
    rr = (f"coalesce(1.0 / best_{k}, 0.0)" if mrr == "standard"
          else f"coalesce(1.0 / ({k} + 1 - worst_{k}), 0.0)")
    return {
        "hr": f"avg(CAST(hit_{k} AS DOUBLE))",
        "mrr": f"avg({rr})",
        "precision": f"coalesce(avg(CASE WHEN npos > 0 THEN hits_{k} / {float(k)} END), 0.0)",
        "ndcg": f"avg(CASE WHEN {_idcg(k)} > 0 THEN dcg_{k} / {_idcg(k)} ELSE 0.0 END)",
    }


K = 3


@register("hr_at_k", with_ctes(*PRED_CTES, _rank_ctes([K]), select=f"""
SELECT {_topk_cols(K)['hr']} AS hr_at_{K} FROM ss"""))
def hr_at_k(spark, sf):
    """E-17: hit rate @3."""
    return M.hit_rate_at_k(pred(spark, sf), K)


@register("mrr_at_k", with_ctes(*PRED_CTES, _rank_ctes([K]), select=f"""
SELECT {_topk_cols(K)['mrr']} AS mrr_at_{K} FROM ss"""))
def mrr_at_k(spark, sf):
    """E-18 standard MRR @3."""
    return M.mrr_at_k(pred(spark, sf), K, mode="standard")


@register("mrr_at_k_reference", with_ctes(*PRED_CTES, _rank_ctes([K]), select=f"""
SELECT {_topk_cols(K, 'reference')['mrr']} AS mrr_at_{K} FROM ss"""))
def mrr_at_k_reference(spark, sf):
    """E-18 in the reference's (inverted) form."""
    return M.mrr_at_k(pred(spark, sf), K, mode="reference")


@register("precision_at_k", with_ctes(*PRED_CTES, _rank_ctes([K]), select=f"""
SELECT {_topk_cols(K)['precision']} AS precision_at_{K} FROM ss"""))
def precision_at_k(spark, sf):
    """E-19: precision @3 over samples with a true label."""
    return M.precision_at_k(pred(spark, sf), K)


@register("ndcg_at_k", with_ctes(*PRED_CTES, _rank_ctes([K]), select=f"""
SELECT {_topk_cols(K)['ndcg']} AS ndcg_at_{K} FROM ss"""))
def ndcg_at_k(spark, sf):
    """E-20: NDCG @3 with tie-averaged gains."""
    return M.ndcg_at_k(pred(spark, sf), K)


def _suite_sql(ks=(1, 3, 5, 10)) -> str:
    parts = []
    for k in ks:
        c = _topk_cols(k)
        parts.append(f"""SELECT {k} AS k, {c['hr']} AS hr_at_k, {c['mrr']} AS mrr_at_k,
  {c['precision']} AS precision_at_k, {c['ndcg']} AS ndcg_at_k, max(nfirst) AS nfirst
  FROM ss2""")
    return with_ctes(*PRED_CTES, _rank_ctes(ks), """first_n AS (
  SELECT first(nlab ORDER BY sample_id) AS nfirst FROM ss)""",
                     "ss2 AS (SELECT ss.*, f.nfirst FROM ss, first_n f WHERE ss.nlab = f.nfirst)",
                     select=f"""SELECT CAST(k AS INTEGER) AS k, hr_at_k, mrr_at_k, precision_at_k,
       ndcg_at_k FROM ({' UNION ALL '.join(parts)}) WHERE k <= nfirst AND nfirst > 1""")


@register("topk_suite", _suite_sql())
def topk_suite(spark, sf):
    """E-21: HR / MRR / P / NDCG for k in 1, 3, 5, 10 in one ranked pass."""
    return M.topk_suite(pred(spark, sf))


def _threshold_ctes(metric: str, n: int = 100) -> str:
    expr = {"f1": F1, "accuracy": ACC, "precision": PREC, "recall": REC}[metric]
    return f"""rng AS (SELECT min(score) AS lo, max(score) AS hi FROM pred),
grid AS (SELECT i, CASE WHEN i = {n - 1} THEN hi ELSE i * ((hi - lo) / {float(n - 1)}) + lo END AS t
         FROM rng, range({n}) r(i)),
gc AS (SELECT g.i, g.t,
   count(*) FILTER (WHERE p.score > g.t AND p.truth = 1) AS tp,
   count(*) FILTER (WHERE p.score > g.t AND p.truth <> 1) AS fp,
   count(*) FILTER (WHERE p.score <= g.t AND p.truth = 1) AS fn,
   count(*) FILTER (WHERE p.score <= g.t AND p.truth <> 1) AS tn
   FROM grid g, pred p GROUP BY g.i, g.t),
gm AS (SELECT i, t, {expr} AS v FROM gc)"""


def _threshold_sql(metric: str, n: int = 100) -> str:
    return with_ctes(*PRED_CTES, _threshold_ctes(metric, n), select="""
SELECT CASE WHEN max(v) > 0 THEN first(t ORDER BY v DESC, i ASC) ELSE 0.5 END AS best_threshold,
       CASE WHEN max(v) > 0 THEN max(v) ELSE 0.0 END AS best_score FROM gm""")


def _best_threshold_query(metric):
    def fn(spark, sf):
        return M.best_threshold(pred(spark, sf), metric, 100)
    fn.__doc__ = f"E-22: best grid threshold for {metric}."
    return fn


for _m in ("f1", "accuracy", "precision", "recall"):
    register(f"best_threshold_{_m}", _threshold_sql(_m))(_best_threshold_query(_m))

@register("best_metrics", with_ctes(
    *PRED_CTES, _threshold_ctes("f1"),
    """bt AS (SELECT CASE WHEN max(v) > 0 THEN first(t ORDER BY v DESC, i ASC) ELSE 0.5 END AS th
              FROM gm),
bc AS (SELECT bt.th,
   count(*) FILTER (WHERE p.score > bt.th AND p.truth = 1) AS tp,
   count(*) FILTER (WHERE p.score > bt.th AND p.truth <> 1) AS fp,
   count(*) FILTER (WHERE p.score <= bt.th AND p.truth = 1) AS fn,
   count(*) FILTER (WHERE p.score <= bt.th AND p.truth <> 1) AS tn FROM bt, pred p GROUP BY bt.th)""",
    select=f"SELECT th AS threshold, {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall, "
           f"{F1} AS f1 FROM bc"))
def best_metrics(spark, sf):
    """E-23: metrics at the F1-best threshold."""
    return M.best_metrics(pred(spark, sf), 100)


@register("metric_bundle", with_ctes(*PRED_CTES, CONF, _C0, select=f"""
SELECT {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall, {F1} AS f1, {JAC} AS jaccard,
       {HL} AS hamming_loss, {MCC} AS matthews_corrcoef, curve.roc_auc, curve.avg_precision,
       (SELECT count(*) FROM pred) AS support, CAST(0.5 AS DOUBLE) AS threshold,
       (SELECT CAST(sum(truth) AS BIGINT) FROM pred) AS num_positive,
       (SELECT avg(score) FROM pred) AS avg_probability
FROM conf, curve"""))
def metric_bundle(spark, sf):
    """E-16 (flat mode, the reference's effective behaviour)."""
    return M.metric_bundle(pred(spark, sf), 0.5, mode="flat")


def grid_pred(spark, sf):
    """Three similarity heads as three 'models'; label parity as 'dataset'."""
    cos = flagship_pred(spark, sf).drop("logit").withColumn("model", F.lit("cosine"))
    dot = scored_pairs(spark, sf, head="dot", weights=DOT_WEIGHTS, bias=DOT_BIAS)
    bil = scored_pairs(spark, sf, head="bilinear", matrix=BILINEAR)
    parts = [cos]
    for name, d in (("dot", dot), ("bilinear", bil)):
        parts.append(d.select("sample_id", "label_id", "label", "truth",
                              F.round("score", 6).alias("score"), F.lit(name).alias("model")))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.withColumn("dataset", F.concat(F.lit("d"), F.pmod("label_id", F.lit(2)).cast("string")))


GRID_SQL = with_ctes(*PRED_CTES, SQL_DOT_PAIRS, SQL_BIL_PAIRS, """gp AS (
  SELECT sample_id, label_id, truth, score, 'cosine' AS model FROM pred
  UNION ALL
  SELECT sample_id, CAST(cand + 1 AS INTEGER), CASE WHEN true_label = cand THEN 1 ELSE 0 END,
         round(1.0 / (1.0 + exp(-logit)), 6), 'dot' FROM dp
  UNION ALL
  SELECT sample_id, CAST(cand + 1 AS INTEGER), CASE WHEN true_label = cand THEN 1 ELSE 0 END,
         round(1.0 / (1.0 + exp(-logit)), 6), 'bilinear' FROM bp),
gd AS (SELECT *, 'd' || CAST(label_id % 2 AS VARCHAR) AS dataset FROM gp),
ga AS (SELECT model, dataset,
   count(*) FILTER (WHERE score > 0.5 AND truth = 1) AS tp,
   count(*) FILTER (WHERE score > 0.5 AND truth <> 1) AS fp,
   count(*) FILTER (WHERE score <= 0.5 AND truth = 1) AS fn,
   count(*) FILTER (WHERE score <= 0.5 AND truth <> 1) AS tn,
   avg(score) AS avg_probability, count(DISTINCT sample_id) AS n_samples
   FROM gd GROUP BY ROLLUP (model, dataset))""", select=f"""
SELECT model, dataset, n_samples, tp + fp + fn + tn AS support, tp + fn AS num_positive,
       avg_probability, {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall, {F1} AS f1
FROM ga""")


@register("eval_grid", GRID_SQL)
def eval_grid(spark, sf):
    """E-24: model x dataset grid with per-model and overall totals (ROLLUP)."""
    return M.evaluation_grid(grid_pred(spark, sf))


@register("score_truth_join", with_ctes(*PRED_CTES, select="""
SELECT t.sample_id, t.label_id, t.truth, coalesce(s.score, 0.0) AS score
FROM (SELECT sample_id, label_id, truth FROM pred) t
LEFT JOIN (SELECT sample_id, label_id, score FROM pred WHERE label_id <> 10) s
  ON t.sample_id = s.sample_id AND t.label_id = s.label_id"""))
def score_truth_join(spark, sf):
    """D-6 / D-5: truth left-joined to scores by (sample, label id); a missing
    score counts as 0.0."""
    p = pred(spark, sf)
    truth = p.select("sample_id", "label_id", "truth")
    scores = p.filter(F.col("label_id") != 10).select("sample_id", "label_id", "score")
    return attach_scores(truth, scores)


def _by_cell(sql: str) -> str:
    """Ranking CTEs over ``pred`` as CTEs over every cell of the grid ``gd``."""
    return (sql.replace("FROM pred", "FROM gd").replace("SELECT sample_id", "SELECT model, dataset, sample_id")
            .replace("PARTITION BY sample_id", "PARTITION BY model, dataset, sample_id")
            .replace("GROUP BY sample_id", "GROUP BY model, dataset, sample_id"))


GRID_FULL_SQL = GRID_SQL[:GRID_SQL.index("ga AS")] + _by_cell(_rank_ctes([1, 3])) + f""",
conf AS (SELECT model, dataset, count(DISTINCT sample_id) AS n_samples, count(*) AS n_pairs,
   count(*) FILTER (WHERE score > 0.5 AND truth = 1) AS tp, count(*) FILTER (WHERE score > 0.5 AND truth <> 1) AS fp,
   count(*) FILTER (WHERE score <= 0.5 AND truth = 1) AS fn, count(*) FILTER (WHERE score <= 0.5 AND truth <> 1) AS tn
   FROM gd GROUP BY model, dataset),
ar AS (SELECT *, rank() OVER (PARTITION BY model, dataset ORDER BY score)
              + (count(*) OVER (PARTITION BY model, dataset, score) - 1) / 2.0::DOUBLE AS r FROM gd),
auc AS (SELECT model, dataset, (sum(r) FILTER (WHERE truth = 1) - sum(truth) * (sum(truth) + 1) / 2.0::DOUBLE)
              / (sum(truth) * (count(*) - sum(truth))) AS roc_auc FROM ar GROUP BY model, dataset),
st AS (SELECT model, dataset, score, sum(truth) AS p, count(*) AS n FROM gd GROUP BY model, dataset, score),
cu AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model, dataset) AS tp
       FROM st WINDOW w AS (PARTITION BY model, dataset ORDER BY score DESC)),
ap AS (SELECT model, dataset, sum(p * (cp / CAST(cn AS DOUBLE))) / max(tp) AS avg_precision FROM cu GROUP BY model, dataset),
tk AS (SELECT model, dataset, {", ".join(f"{_topk_cols(k)[m]} AS {m}_at_{k}" for k in (1, 3) for m in ("hr", "mrr", "precision", "ndcg"))}
       FROM ss GROUP BY model, dataset)
SELECT model, dataset, n_samples, n_pairs, {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall, {F1} AS f1,
       roc_auc, avg_precision, tk.* EXCLUDE (model, dataset)
FROM conf JOIN auc USING (model, dataset) JOIN ap USING (model, dataset) JOIN tk USING (model, dataset)"""


@register("eval_grid_full", GRID_FULL_SQL)
def eval_grid_full(spark, sf):
    """E-24: every metric of every (model, dataset) cell from one scoring pass."""
    return evaluate(grid_pred(spark, sf), ["model", "dataset"], ks=(1, 3))


TOTALS_SQL = GRID_SQL[:GRID_SQL.index("ga AS")] + f"""
plan AS (SELECT DISTINCT model, 'd' || CAST(label_id % 3 AS VARCHAR) AS dataset FROM gd),
tasks AS (SELECT model, dataset, (model, dataset) IN (SELECT (model, dataset) FROM gd) AS ok FROM plan),
cells AS (SELECT CAST(grouping(model, dataset) AS BIGINT) AS level, model, dataset, count(*) AS n_tasks,
                 count(*) FILTER (WHERE ok) AS n_succeeded FROM tasks GROUP BY CUBE (model, dataset)),
st AS (SELECT CAST(grouping(model, dataset) AS BIGINT) AS level, model, dataset, score,
              sum(truth) AS p, count(*) - sum(truth) AS q FROM gd GROUP BY CUBE (model, dataset), score),
cu AS (SELECT *, sum(p) OVER w AS cp, sum(p + q) OVER w AS cn, sum(q) OVER w - q AS above,
              sum(p) OVER c AS tot_p, sum(q) OVER c AS tot_q, min(score) OVER c AS lo, max(score) OVER c AS hi
       FROM st WINDOW w AS (PARTITION BY level, model, dataset ORDER BY score DESC),
                      c AS (PARTITION BY level, model, dataset)),
agg AS (SELECT level, model, dataset, max(tot_p) AS num_positive, max(tot_p + tot_q) AS support, max(lo) AS lo, max(hi) AS hi,
               sum(score * (p + q)) / sum(p + q) AS avg_probability,
               sum(CASE WHEN score > 0.5 THEN p ELSE 0 END) AS tp, sum(CASE WHEN score > 0.5 THEN q ELSE 0 END) AS fp,
               sum(CASE WHEN score > 0.5 THEN 0 ELSE p END) AS fn, sum(CASE WHEN score > 0.5 THEN 0 ELSE q END) AS tn,
               sum(p * (tot_q - above - q / 2.0::DOUBLE)) / (max(tot_p) * max(tot_q)) AS roc_auc,
               sum(p * (cp / CAST(cn AS DOUBLE))) / max(tot_p) AS avg_precision
        FROM cu GROUP BY level, model, dataset),
grid AS (SELECT level, model, dataset, i, CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99.0::DOUBLE) + lo END AS t
         FROM agg, range(100) r(i)),
tat AS (SELECT g.level, g.model, g.dataset, g.i, g.t, coalesce(sum(s.p), 0) AS tp, coalesce(sum(s.q), 0) AS fp,
              any_value(a.num_positive) - coalesce(sum(s.p), 0) AS fn
       FROM grid g JOIN agg a ON a.level = g.level AND a.model IS NOT DISTINCT FROM g.model AND a.dataset IS NOT DISTINCT FROM g.dataset
       LEFT JOIN st s ON s.level = g.level AND s.model IS NOT DISTINCT FROM g.model
                     AND s.dataset IS NOT DISTINCT FROM g.dataset AND s.score > g.t
       GROUP BY g.level, g.model, g.dataset, g.i, g.t),
best AS (SELECT level, model, dataset, arg_max(t, (f1, -i)) AS t, max(f1) AS f1
         FROM (SELECT *, {F1} AS f1 FROM tat) GROUP BY level, model, dataset)
SELECT c.level, c.model, c.dataset, n_tasks, n_succeeded, n_succeeded / CAST(n_tasks AS DOUBLE) AS success_rate,
       CAST(support AS BIGINT) AS support, CAST(num_positive AS BIGINT) AS num_positive, avg_probability,
       CASE WHEN support IS NOT NULL THEN {ACC} END AS accuracy, CASE WHEN support IS NOT NULL THEN {PREC} END AS precision,
       CASE WHEN support IS NOT NULL THEN {REC} END AS recall, CASE WHEN support IS NOT NULL THEN {F1} END AS f1,
       roc_auc, avg_precision, CASE WHEN best.f1 > 0 THEN best.t WHEN best.f1 = 0 THEN 0.5 END AS best_threshold, best.f1 AS best_f1
FROM cells c
LEFT JOIN agg a ON a.level = c.level AND a.model IS NOT DISTINCT FROM c.model AND a.dataset IS NOT DISTINCT FROM c.dataset
LEFT JOIN best ON best.level = c.level AND best.model IS NOT DISTINCT FROM c.model AND best.dataset IS NOT DISTINCT FROM c.dataset"""


@register("eval_totals", TOTALS_SQL)
def eval_totals(spark, sf):
    """E-24: cells, per-model, per-dataset and overall totals with curves, best
    thresholds and success counts; the planned data set d2 has no scores."""
    p = grid_pred(spark, sf)
    plan = p.select("model", F.concat(F.lit("d"), (F.col("label_id") % 3).cast("string")).alias("dataset"))
    return M.evaluation_totals(p, planned=plan)
