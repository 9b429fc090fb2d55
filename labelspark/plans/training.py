"""Packing, loss and NLI-activation queries (J-8 .. J-10, G-2, E-26 .. E-29,
D-8, F-20, J-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.activation import nli_pair_score, softmax_over
from ..functions.text import PY_WHITESPACE_CLASS
from ..operators import losses as L
from ..operators import pack as PK
from ..sources.sinks import batch_numbers
from . import sqlfn as S
from .registry import register, with_ctes
from .scoring import PRED_CTES, SQL_EMB
from .tables import embedding_vectors, flagship_pred, read

LONG_LABEL = "a much longer label made of several words"
UNDERSCORE_LABEL = "label_with_underscores here"


def _pack_src(spark, sf, third: str, truth: list[int]):
    d = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return d.select(F.col("doc_id").alias("sample_id"), "text",
                    F.array("lang", "source", F.lit(third)).alias("ltext"),
                    F.array(*[F.lit(x) for x in truth]).alias("lint"))


def _tok_sql(e: str, cap: int) -> str:
    return (f"list_slice(list_filter(regexp_split_to_array({S.strip(e)}, '{PY_WHITESPACE_CLASS}+'),"
            f" lambda t: t <> ''), 1, {cap})")


def _pack_sql(src: str, max_length: int, extra_cols: str = "") -> tuple[str, str]:
    avail = max_length - 2
    tb = max(avail // 2, 10)
    lb = avail - tb
    ctes = f"""{src},
tok AS (SELECT sample_id, {_tok_sql('text', max_length)} AS tt,
               list_transform(ltext, lambda l: {_tok_sql('l', 128)}) AS lt{extra_cols} FROM src),
cst AS (SELECT *, list_transform(lt, lambda x: len(x) + 1) AS costs FROM tok),
ov AS (SELECT *, len(tt) + coalesce(list_sum(costs), 0) + 2 > {max_length} AS over FROM cst),
fit AS (SELECT *, CASE WHEN over THEN len(list_filter(range(1, len(costs) + 1),
            lambda i: list_sum(list_slice(costs, 1, i)) <= {lb})) ELSE len(lt) END AS n_fit FROM ov),
f AS (SELECT *, CASE WHEN over THEN list_slice(tt, 1, {tb}) ELSE tt END AS tt2,
             list_slice(lt, 1, n_fit) AS lt2 FROM fit),
pk AS (SELECT *,
   list_concat(list_concat(list_concat(['[CLS]'], tt2), ['[SEP]']),
               flatten(list_transform(lt2, lambda x: list_concat(x, ['[LAB]'])))) AS input_tokens,
   list_concat(list_transform(range(len(tt2) + 2), lambda i: 0),
               flatten(list_transform(range(1, len(lt2) + 1),
                 lambda i: list_concat(list_transform(lt2[i], lambda t: CAST(i AS INTEGER)), [0]))))
     AS lmask FROM f)"""
    return ctes, "pk"


_SRC1 = f"""src AS (SELECT doc_id AS sample_id, text, [lang, source, '{LONG_LABEL}'] AS ltext,
                [1, 0, 0] AS lint FROM documents)"""


@register("pack_budget", with_ctes(_pack_sql(_SRC1, 64)[0], select="""
SELECT sample_id, input_tokens, lmask, CAST(n_fit AS INTEGER) AS n_fit FROM pk"""))
def pack_budget(spark, sf):
    """J-8 / G-2: [CLS] text [SEP] labels [LAB]... under a 64-token budget."""
    p = PK.pack(_pack_src(spark, sf, LONG_LABEL, [1, 0, 0]), 64)
    return p.select("sample_id", "input_tokens", "lmask", "n_fit")


@register("pack_padded", with_ctes(_pack_sql(_SRC1, 64)[0], select="""
SELECT sample_id,
       list_slice(list_concat(input_tokens, list_transform(range(greatest(64 - len(input_tokens), 0)),
                  lambda i: '[PAD]')), 1, 64) AS input_tokens,
       list_slice(list_concat(lmask, list_transform(range(greatest(64 - len(lmask), 0)), lambda i: 0)),
                  1, 64) AS lmask,
       list_slice(list_concat(list_transform(input_tokens, lambda t: 1),
                  list_transform(range(greatest(64 - len(input_tokens), 0)), lambda i: 0)), 1, 64)
         AS attention_mask
FROM pk"""))
def pack_padded(spark, sf):
    """J-9: packed rows padded to 64 with attention mask."""
    p = PK.pad(PK.pack(_pack_src(spark, sf, LONG_LABEL, [1, 0, 0]), 64), 64)
    return p.select("sample_id", "input_tokens", "lmask", "attention_mask")


@register("pack_padded_max", with_ctes(_pack_sql(_SRC1, 64)[0], """ml AS (
  SELECT least(max(len(input_tokens)), 48) AS m FROM pk)""", select="""
SELECT sample_id,
       list_slice(list_concat(input_tokens, list_transform(range(greatest(m - len(input_tokens), 0)),
                  lambda i: '[PAD]')), 1, m) AS input_tokens,
       list_slice(list_concat(lmask, list_transform(range(greatest(m - len(lmask), 0)), lambda i: 0)),
                  1, m) AS lmask,
       list_slice(list_concat(list_transform(input_tokens, lambda t: 1),
                  list_transform(range(greatest(m - len(input_tokens), 0)), lambda i: 0)), 1, m)
         AS attention_mask
FROM pk, ml"""))
def pack_padded_max(spark, sf):
    """J-9: pad to the longest packed row of the corpus, capped at 48."""
    p = PK.pad_to_max(PK.pack(_pack_src(spark, sf, LONG_LABEL, [1, 0, 0]), 64), 48)
    return p.select("sample_id", "input_tokens", "lmask", "attention_mask")


@register("pack_batches", with_ctes(_pack_sql(_SRC1, 64)[0], """nb AS (
  SELECT *, CAST((row_number() OVER (ORDER BY sample_id) - 1) // 32 + 1 AS BIGINT) AS batch FROM pk),
ml AS (SELECT *, least(max(len(input_tokens)) OVER (PARTITION BY batch), 48) AS m FROM nb)""", select="""
SELECT sample_id, batch,
       list_slice(list_concat(input_tokens, list_transform(range(greatest(m - len(input_tokens), 0)),
                  lambda i: '[PAD]')), 1, m) AS input_tokens,
       list_slice(list_concat(lmask, list_transform(range(greatest(m - len(lmask), 0)), lambda i: 0)),
                  1, m) AS lmask,
       list_slice(list_concat(list_transform(input_tokens, lambda t: 1),
                  list_transform(range(greatest(m - len(input_tokens), 0)), lambda i: 0)), 1, m)
         AS attention_mask
FROM ml"""))
def pack_batches(spark, sf):
    """J-9: batches of 32 documents, each padded to its own longest row (cap 48)."""
    src = batch_numbers(_pack_src(spark, sf, LONG_LABEL, [1, 0, 0]), "sample_id", 32)
    p = PK.pad_batches(PK.pack(src, 64), 48)
    return p.select("sample_id", "batch", "input_tokens", "lmask", "attention_mask")


_SRC2 = f"""src0 AS (SELECT doc_id AS sample_id, text, [lang, source, '{UNDERSCORE_LABEL}'] AS l,
                 [1, 0, 1] AS t FROM documents),
ex0 AS (SELECT sample_id, text, unnest(l) AS l, unnest(t) AS t, unnest(range(0, 3)) AS i FROM src0),
u0 AS (SELECT sample_id, text, i, t, CASE WHEN {S.uniform('sample_id', 'i', '42', "'u'")} < 0.9
              THEN replace(l, '_', ' ') ELSE l END AS l FROM ex0),
src AS (SELECT sample_id, text, list_slice(list(l ORDER BY {S.md5_key('sample_id', 'i', '42')}), 1, 2)
                 AS ltext,
               list_slice(list(t ORDER BY {S.md5_key('sample_id', 'i', '42')}), 1, 2) AS lint
        FROM u0 GROUP BY sample_id, text)"""


@register("pack_training", with_ctes(_pack_sql(_SRC2, 24, ", lint")[0], select="""
SELECT sample_id, input_tokens, lmask, list_slice(lint, 1, n_fit) AS lint,
       CAST(n_fit AS INTEGER) AS n_fit FROM pk"""))
def pack_training(spark, sf):
    """J-10: limit to 2 shuffled labels, pack under 24 tokens, cut the truth."""
    s = _pack_src(spark, sf, UNDERSCORE_LABEL, [1, 0, 1])
    p = PK.pack_training(s, 24, 2, shuffle=True, remove_underscores=0.9, seed=42)
    return p.select("sample_id", "input_tokens", "lmask", "lint", "n_fit")


def _pairs(spark, sf):
    return flagship_pred(spark, sf)


_BCE = """bce AS (SELECT avg(greatest(z, 0.0) - z * truth + ln(1 + exp(-abs(z)))) AS bce_loss
        FROM (SELECT logit / exp(2.0) * 1.0 AS z, truth FROM pred WHERE isfinite(logit)))"""
_SUPCON = """sup AS (SELECT coalesce(avg(-(sp - np * (m + ln(se))) / np) FILTER (WHERE np > 0), 0.0)
               AS supcon_loss FROM (
  SELECT sample_id, max(m) AS m, sum(exp(logit - m)) AS se,
         sum(CASE WHEN truth = 1 THEN logit END) AS sp, count(*) FILTER (WHERE truth = 1) AS np
  FROM (SELECT *, max(logit) OVER (PARTITION BY sample_id) AS m FROM pred) GROUP BY sample_id))"""
_LV = """lv AS (SELECT vec_id // 10 AS sample_id, CAST(vec_id % 10 + 1 AS INTEGER) AS label_id,
                v AS vec FROM e),
rep AS (SELECT coalesce(avg(greatest(list_cosine_similarity(a.vec, b.vec) - 0.3, 0.0)), 0.0)
               AS repulsion_loss
        FROM lv a JOIN lv b ON a.sample_id = b.sample_id AND a.label_id <> b.label_id)"""


@register("bce_loss", with_ctes(*PRED_CTES, _BCE, select="SELECT bce_loss FROM bce"))
def bce_loss(spark, sf):
    """E-26: BCE with decoupled temperature over scored pairs."""
    return L.bce_loss(_pairs(spark, sf))


@register("supcon_loss", with_ctes(*PRED_CTES, _SUPCON, select="SELECT supcon_loss FROM sup"))
def supcon_loss(spark, sf):
    """E-27: supervised contrastive loss per sample, averaged."""
    return L.supcon_loss(_pairs(spark, sf))


def _label_vectors(spark, sf):
    e = embedding_vectors(spark, sf)
    return e.select((F.col("vec_id") / 10).cast("long").alias("sample_id"),
                    (F.pmod("vec_id", F.lit(10)) + 1).cast("int").alias("label_id"),
                    F.col("v").alias("vec"))


@register("repulsion_loss", with_ctes(SQL_EMB, _LV, select="SELECT repulsion_loss FROM rep"))
def repulsion_loss(spark, sf):
    """E-28 / D-8: label repulsion inside each sample (10 vectors per sample)."""
    return L.repulsion_loss(_label_vectors(spark, sf))


@register("total_loss", with_ctes(*PRED_CTES, _BCE, _SUPCON, _LV, select="""
SELECT supcon_loss, repulsion_loss, bce_loss,
       supcon_loss * 1.0 + repulsion_loss * 0.1 + bce_loss * 1.0 AS total_loss FROM sup, rep, bce"""))
def total_loss(spark, sf):
    """E-29: weighted total of the three losses."""
    p = _pairs(spark, sf)
    return L.total_loss(L.supcon_loss(p), L.repulsion_loss(_label_vectors(spark, sf)),
                        L.bce_loss(p))


_NLI = """nli AS (SELECT vec_id // 10 AS sample_id, CAST(vec_id % 10 + 1 AS INTEGER) AS label_id,
                 v AS lg FROM e)"""
ENTAIL = 2


def _nli_pairs(spark, sf):
    e = embedding_vectors(spark, sf)
    return e.select((F.col("vec_id") / 10).cast("long").alias("sample_id"),
                    (F.pmod("vec_id", F.lit(10)) + 1).cast("int").alias("label_id"),
                    F.col("v").alias("logits"))


@register("nli_softmax", with_ctes(SQL_EMB, _NLI, select=f"""
SELECT sample_id, label_id, ex / sum(ex) OVER (PARTITION BY sample_id) AS score
FROM (SELECT sample_id, label_id,
             exp(lg[{ENTAIL + 1}] - max(lg[{ENTAIL + 1}]) OVER (PARTITION BY sample_id)) AS ex FROM nli)"""))
def nli_softmax(spark, sf):
    """F-20 softmax mode: entailment logits normalised across a sample's labels."""
    p = _nli_pairs(spark, sf).withColumn("logit", nli_pair_score("logits", "softmax", ENTAIL))
    return softmax_over(p, ["sample_id"], "logit", "score").select("sample_id", "label_id", "score")


@register("nli_sigmoid", with_ctes(SQL_EMB, _NLI, select=f"""
SELECT sample_id, label_id,
       exp(lg[{ENTAIL + 1}] - list_max(lg)) / list_sum(list_transform(lg, lambda x: exp(x - list_max(lg))))
         AS score FROM nli"""))
def nli_sigmoid(spark, sf):
    """F-20 sigmoid mode: per-pair softmax across classes at the entailment column."""
    p = _nli_pairs(spark, sf)
    return p.select("sample_id", "label_id", nli_pair_score("logits", "sigmoid", ENTAIL).alias("score"))
