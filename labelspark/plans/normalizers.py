"""Normaliser queries (B-1 .. B-9, C-2 .. C-21) bound to the given tables.

Source shapes (MCQ structs, option maps, dialogues, wide indicators ...) are
built from part / customer / orders / lineitem / conversations / labels /
documents by expressions, then fed to the library normaliser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalize as N
from . import sqlfn as S
from .registry import register, with_ctes
from .tables import read

SEED = 42


def _part(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    kind = F.concat(F.col("p_type"), F.lit("_kind"))
    return p.withColumn("choices", F.array("p_brand", kind, "p_name")).withColumn(
        "letters", F.array(F.lit("A"), F.lit("B"), F.lit("C"))).withColumn(
        "ans", F.pmod("p_size", F.lit(3)))


P_CHOICES = "[p_brand, p_type || '_kind', p_name]"
P_ENS_CHOICES = f"list_transform({P_CHOICES}, lambda c: {S.ensure('c')})"


@register("norm_mcq_struct", f"""
SELECT p_partkey AS sample_id, {S.ensure('p_name')} AS text, {P_ENS_CHOICES} AS ltext,
       list_transform(['A', 'B', 'C'], lambda l: CASE WHEN l = (['A', 'B', 'C'])[p_size % 3 + 1]
                      THEN 1 ELSE 0 END) AS lint
FROM part""")
def norm_mcq_struct(spark, sf):
    """C-2: choices {text[], label[]} with an answer key."""
    p = _part(spark, sf).withColumn("ch", F.struct(F.col("choices").alias("text"),
                                                   F.col("letters").alias("label")))
    return N.mcq_struct(p, "p_partkey", "p_name", "ch",
                        F.element_at("letters", F.col("ans") + 1))


@register("norm_mcq_index", f"""
SELECT p_partkey AS sample_id, {S.ensure('p_name')} AS text, {P_ENS_CHOICES} AS ltext,
       list_transform(range(0, 3), lambda i: CASE WHEN i = p_size % 3 THEN 1 ELSE 0 END) AS lint
FROM part""")
def norm_mcq_index(spark, sf):
    """C-3: plain choice list, answer by position."""
    return N.mcq_index(_part(spark, sf), "p_partkey", "p_name", "choices", "ans")


@register("norm_mcq_value", f"""
SELECT p_partkey AS sample_id, {S.ensure('p_name')} AS text, {P_ENS_CHOICES} AS ltext,
       list_transform({P_CHOICES}, lambda c: CASE WHEN c = (CASE p_size % 3 WHEN 0 THEN p_brand
            WHEN 1 THEN p_type || '_kind' ELSE p_name END) THEN 1 ELSE 0 END) AS lint
FROM part""")
def norm_mcq_value(spark, sf):
    """C-4: answer is the raw choice value."""
    p = _part(spark, sf)
    return N.mcq_value(p, "p_partkey", "p_name", "choices", F.element_at("choices", F.col("ans") + 1))


@register("norm_letter", f"""
SELECT p_partkey AS sample_id, {S.ensure("p_name || chr(10) || p_brand")} AS text,
       {P_ENS_CHOICES} AS ltext,
       list_transform(range(0, 3), lambda i: CASE WHEN i = p_size % 3 THEN 1 ELSE 0 END) AS lint
FROM part""")
def norm_letter(spark, sf):
    """C-7: answer letter A/B/C."""
    p = _part(spark, sf)
    return N.letter_answer(p, "p_partkey", "p_name", "p_brand", "choices",
                           F.element_at("letters", F.col("ans") + 1))


@register("norm_map", f"""
SELECT p_partkey AS sample_id, {S.ensure("p_name || chr(10) || p_type")} AS text,
       {P_ENS_CHOICES} AS ltext,
       list_transform(['A', 'B', 'C'], lambda k: CASE WHEN k = (['A', 'B', 'C'])[p_size % 3 + 1]
                      THEN 1 ELSE 0 END) AS lint
FROM part""")
def norm_map(spark, sf):
    """C-6: options map (keys out of order on purpose), answer key."""
    p = _part(spark, sf)
    m = F.create_map(F.lit("B"), F.concat("p_type", F.lit("_kind")), F.lit("A"), F.col("p_brand"),
                     F.lit("C"), F.col("p_name"))
    return N.map_options(p.withColumn("m", m), "p_partkey", "p_name", "p_type", "m",
                         F.element_at("letters", F.col("ans") + 1))


@register("norm_map_multi", f"""
SELECT sample_id, text,
       list_transform(list_filter(e, lambda x: x.v IS NOT NULL AND x.v <> ''),
                      lambda x: {S.ensure('x.v')}) AS ltext,
       list_transform(list_filter(e, lambda x: x.v IS NOT NULL AND x.v <> ''),
                      lambda x: CASE WHEN list_contains(correct, x.k) THEN 1 ELSE 0 END) AS lint
FROM (SELECT p_partkey AS sample_id, {S.ensure("p_name || chr(10) || p_brand")} AS text,
        [{{'k': 'a', 'v': p_brand}}, {{'k': 'b', 'v': CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END}},
         {{'k': 'c', 'v': p_name}}] AS e,
        CASE WHEN p_size % 2 = 0 THEN ['a', 'c'] ELSE ['b'] END AS correct FROM part)""")
def norm_map_multi(spark, sf):
    """C-11: multi-answer option map, empty options dropped."""
    p = _part(spark, sf)
    m = F.create_map(F.lit("c"), F.col("p_name"), F.lit("a"), F.col("p_brand"), F.lit("b"),
                     F.when(F.pmod("p_size", F.lit(4)) == 0, F.lit("")).otherwise(F.col("p_type")))
    correct = F.when(F.pmod("p_size", F.lit(2)) == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(
        F.array(F.lit("b")))
    return N.multi_answer_map(p.withColumn("m", m).withColumn("ok", correct), "p_partkey",
                              "p_name", "p_brand", "m", "ok")


@register("norm_dialogue", f"""
WITH conv AS (SELECT conv_id, list(text ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, turn, role,
             row_number() OVER (ORDER BY conv_id, turn, text, role) - 1 AS n FROM conversations)
SELECT q.n AS sample_id,
       {S.ensure("'turn ' || CAST(q.turn AS VARCHAR) || chr(10) || array_to_string(c.turns, chr(10))")}
         AS text,
       ['user', 'assistant', 'system'] AS ltext,
       list_transform(['user', 'assistant', 'system'], lambda r: CASE WHEN r = q.role THEN 1 ELSE 0 END)
         AS lint
FROM q JOIN conv c ON q.conv_id = c.conv_id""")
def norm_dialogue(spark, sf):
    """C-5: one sample per nested query of a dialogue."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "text", "role"))).alias("t"))
    d = g.select("conv_id", F.transform("t", lambda x: x["text"]).alias("turns"),
                 F.transform("t", lambda x: F.struct(
                     F.concat(F.lit("turn "), x["turn"].cast("string")).alias("question"),
                     roles.alias("choice"), x["role"].alias("answer"))).alias("queries"))
    return N.dialogue(d, "conv_id", "turns", "queries")


@register("norm_bool", """
SELECT doc_id AS sample_id, text, ['false', 'true'] AS ltext,
       [1 - quality, quality] AS lint FROM labels JOIN documents USING (doc_id)""")
def norm_bool(spark, sf):
    """C-9: boolean answer -> [false, true]."""
    lab = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return N.binary_answer(lab, "doc_id", "text",
                           "quality")


@register("norm_all_pos", f"""
SELECT p_partkey AS sample_id, {S.ensure('p_name')} AS text,
       [{S.ensure('p_brand')}, {S.ensure('p_type')}] AS ltext, [1, 1] AS lint FROM part""")
def norm_all_pos(spark, sf):
    """C-12: all labels positive."""
    p = _part(spark, sf).withColumn("labels", F.array("p_brand", "p_type"))
    return N.all_positive(p, "p_partkey", "p_name", "labels")


_NEG = f"""base AS (SELECT p_partkey AS id, {S.ensure('p_name')} AS t, {S.ensure('p_type')} AS s FROM part),
voc AS (SELECT v, row_number() OVER (ORDER BY {S.num_key('v', str(SEED))}, v) - 1 AS vi
        FROM (SELECT DISTINCT s AS v FROM base WHERE s <> '')),
vn AS (SELECT count(*) AS n FROM voc),
{S.sampled_negatives(str(SEED))}"""


@register("norm_sampled_neg", with_ctes(_NEG, select=f"""
SELECT id AS sample_id, t AS text, list(l ORDER BY {S.md5_key('id', 'i', str(SEED))}) AS ltext,
       list(CASE WHEN l = s THEN 1 ELSE 0 END ORDER BY {S.md5_key('id', 'i', str(SEED))}) AS lint
FROM ex GROUP BY id, t, s"""))
def norm_sampled_neg(spark, sf):
    """C-8: own summary + 1..4 sampled vocabulary negatives, shuffled."""
    return N.sampled_negatives(_part(spark, sf), "p_partkey", "p_name", "p_type", SEED)


@register("norm_attach_vocab", f"""
WITH voc AS (SELECT list(v ORDER BY v) AS vocab FROM (
   SELECT DISTINCT {S.ensure('p_brand')} AS v FROM part WHERE {S.ensure('p_brand')} <> ''))
SELECT p_partkey AS sample_id, {S.ensure('p_name')} AS text, vocab AS ltext,
       {S.onehot('vocab', S.ensure('p_brand'))} AS lint FROM part, voc""")
def norm_attach_vocab(spark, sf):
    """C-10: every row gets the corpus vocabulary, one-hot truth."""
    return N.vocab_onehot(_part(spark, sf), "p_partkey", "p_name", "p_brand", clean=True)


@register("norm_onehot_text", f"""
WITH voc AS (SELECT list(v ORDER BY v) AS vocab FROM (SELECT DISTINCT source AS v FROM documents))
SELECT doc_id AS sample_id, vocab AS ltext, {S.onehot('vocab', 'source')} AS lint
FROM documents, voc""")
def norm_onehot_text(spark, sf):
    """C-15: class text (document source) against the sorted distinct vocabulary."""
    d = read(spark, sf, "documents").select("doc_id", "text", "source")
    return N.vocab_onehot(d, "doc_id", "text", "source", clean=False).drop("text")


@register("norm_binary", """
SELECT doc_id AS sample_id, text, ['not_toxic', 'toxic'] AS ltext,
       [1 - toxic, toxic] AS lint FROM labels JOIN documents USING (doc_id)""")
def norm_binary(spark, sf):
    """C-13: binary label with a fixed name pair."""
    lab = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return N.binary_names(lab, "doc_id", "text",
                          "toxic", ("not_toxic", "toxic"))


@register("norm_multihot", """
SELECT doc_id AS sample_id, text, ['quality', 'toxic'] AS ltext,
       [CASE WHEN quality = 1 THEN 1 ELSE 0 END, CASE WHEN toxic = 1 THEN 1 ELSE 0 END] AS lint
FROM labels JOIN documents USING (doc_id)""")
def norm_multihot(spark, sf):
    """C-16: wide indicator columns -> multi-hot."""
    lab = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return N.wide_indicators(lab, "doc_id", "text",
                             ["quality", "toxic"])


SIZE_NAMES = [f"size_{i:02d}" for i in range(1, 51)]


@register("norm_index", """
SELECT p_partkey AS sample_id, p_name AS text,
       list_transform(range(1, 51), lambda i: 'size_' || lpad(CAST(i AS VARCHAR), 2, '0')) AS ltext,
       list_transform(range(0, 50), lambda i: CASE WHEN i = p_size - 1 THEN 1 ELSE 0 END) AS lint
FROM part""")
def norm_index(spark, sf):
    """C-14: class index into a class-name list (size_01 .. size_50)."""
    p = _part(spark, sf)
    return N.class_index(p, "p_partkey", "p_name", F.col("p_size") - 1, SIZE_NAMES)


@register("norm_hierarchy", """
WITH h AS (SELECT lower(replace(r.r_name, ' ', '_')) || '_intent' AS y, n.n_name AS f, n.n_nationkey
           FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
voc AS (SELECT list(DISTINCT y ORDER BY y) AS vocab FROM h)
SELECT c.c_custkey AS sample_id, c.c_name AS text, vocab AS ltext, """ + S.onehot("vocab", "h.y") + """ AS lint
FROM customer c JOIN h ON c.c_nationkey = h.n_nationkey, voc""")
def norm_hierarchy(spark, sf):
    """C-21: nation -> region roll-up (group + '_intent'), one-hot over regions."""
    nation = read(spark, sf, "nation")
    region = read(spark, sf, "region")
    hier = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("group"),
        F.col("n_name").alias("fine"))
    cust = read(spark, sf, "customer").join(
        nation.select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey"))
    return N.hierarchy_rollup(cust, "c_custkey", "c_name", "n_name", hier, grouped=True)


_CAMEL_SQL = ("list_aggr(list_transform(string_split(p_name, ' '), "
              "lambda w: upper(w[1]) || w[2:]), 'string_agg', '')")
_SNAKE = f"lower(regexp_replace({_CAMEL_SQL}, '([a-z])([A-Z])', '\\1_\\2', 'g'))"


@register("norm_camel", f"""
WITH b AS (SELECT p_partkey, p_brand || chr(10) || p_type AS text, {_SNAKE} AS y FROM part),
voc AS (SELECT list(DISTINCT y ORDER BY y) AS vocab FROM b)
SELECT p_partkey AS sample_id, text, vocab AS ltext, {S.onehot('vocab', 'y')} AS lint FROM b, voc""")
def norm_camel(spark, sf):
    """C-18: CamelCase class names (from part names) -> snake case."""
    p = _part(spark, sf).withColumn("camel", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    return N.camel_class_names(p, "p_partkey", "p_brand", "p_type", "camel")


_CLEAN = "lower(replace(replace(c_mktsegment || ' & Co', '&', 'and'), ' ', '_'))"


@register("norm_clean_names", f"""
WITH b AS (SELECT c_custkey, c_name || chr(10) || c_mktsegment AS text, {_CLEAN} AS y FROM customer),
voc AS (SELECT list(DISTINCT y ORDER BY y) AS vocab FROM b)
SELECT c_custkey AS sample_id, text, vocab AS ltext, {S.onehot('vocab', 'y')} AS lint FROM b, voc""")
def norm_clean_names(spark, sf):
    """C-17: class names with '&' and spaces cleaned; text = title\\ncontent."""
    c = read(spark, sf, "customer").withColumn(
        "seg", F.concat(F.col("c_mktsegment"), F.lit(" & Co")))
    return N.clean_class_names(c, "c_custkey", "c_name", "c_mktsegment", "seg")


# Order-status names of the test binding.
STATUS_NAMES = {"F": "Fulfilled", "O": "Open", "P": "Partial"}


@register("norm_dict_suffix", """
SELECT o_orderkey AS sample_id, o_orderpriority AS text,
       ['fulfilled_status', 'open_status', 'partial_status'] AS ltext,
       list_transform(['F', 'O', 'P'], lambda k: CASE WHEN k = o_orderstatus THEN 1 ELSE 0 END) AS lint
FROM orders""")
def norm_dict_suffix(spark, sf):
    """C-20: class id through a fixed dict, lower-case + suffix."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return N.dict_suffix(o, "o_orderkey", "o_orderpriority", "o_orderstatus", STATUS_NAMES,
                         "_status")


# Return-flag names of the test binding.
FLAG_NAMES = {"A": "Accepted & Billed", "N": "Not-Returned", "R": "Returned Item"}
_FLAG_SQL = ("CASE l_returnflag WHEN 'A' THEN 'Accepted & Billed' WHEN 'N' THEN 'Not-Returned' "
             "WHEN 'R' THEN 'Returned Item' END")


@register("norm_multilabel_vocab", f"""
WITH fl AS (SELECT l_orderkey, list(DISTINCT {_FLAG_SQL}) AS ls FROM lineitem GROUP BY l_orderkey),
voc AS (SELECT list(DISTINCT v ORDER BY v) AS vocab FROM (SELECT unnest(ls) AS v FROM fl))
SELECT o.o_orderkey AS sample_id,
       o.o_orderpriority || chr(10) || o.o_orderstatus || chr(10) || 'Customer: '
         || CAST(o.o_custkey AS VARCHAR) AS text,
       list_transform(vocab, lambda v: replace(replace(replace(lower(v), ' ', '_'), '-', 'and'), '&', 'and'))
         AS ltext,
       list_transform(vocab, lambda v: CASE WHEN list_contains(fl.ls, v) THEN 1 ELSE 0 END) AS lint
FROM orders o JOIN fl ON o.o_orderkey = fl.l_orderkey, voc""")
def norm_multilabel_vocab(spark, sf):
    """C-19: multi-label arrays (distinct return flags per order) against the
    union vocabulary, cleaned names; 3-part text."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    names = F.create_map(*[x for k, v in FLAG_NAMES.items() for x in (F.lit(k), F.lit(v))])
    fl = li.groupBy("l_orderkey").agg(
        F.collect_set(F.element_at(names, F.col("l_returnflag"))).alias("ls"))
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus",
                                         "o_custkey")
    j = o.join(fl, o.o_orderkey == fl.l_orderkey)
    return N.multilabel_vocab(j, "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", "ls",
                              third_name="Customer: ")


# ------------------------------------------------------------------ B-*
def _build_src(spark, sf):
    p = _part(spark, sf)
    return p.withColumn("pos", F.array("p_brand", F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")),
                                       F.lit("x"))).withColumn(
        "neg", F.array("p_name", F.lit(""), F.concat(F.lit("\t"), F.lit("ab"))))


@register("build_labels", f"""
SELECT p_partkey AS sample_id, p_name AS text,
       list_concat(list_filter(list_transform([p_brand, '  ' || p_type || ' ', 'x'], lambda x: {S.strip('x')}),
                               lambda x: length(x) > 1),
                   list_filter(list_transform([p_name, '', chr(9) || 'ab'], lambda x: {S.strip('x')}),
                               lambda x: length(x) > 1)) AS ltext,
       list_concat(list_transform(list_filter(list_transform([p_brand, '  ' || p_type || ' ', 'x'],
                         lambda x: {S.strip('x')}), lambda x: length(x) > 1), lambda x: 1),
                   list_transform(list_filter(list_transform([p_name, '', chr(9) || 'ab'],
                         lambda x: {S.strip('x')}), lambda x: length(x) > 1), lambda x: 0)) AS lint
FROM part""")
def build_labels(spark, sf):
    """B-1 / C-1 / B-2: strip, length filter (> 1), positives then negatives."""
    return N.drop_empty(N.build_labels(_build_src(spark, sf), "p_partkey", "p_name", "pos", "neg", 1))


def _val_src(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    text = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit(" _ ")).otherwise(F.col("text"))
    lt = (F.when(F.pmod("doc_id", F.lit(5)) == 0, F.array("source", F.lit("_")))
          .when(F.pmod("doc_id", F.lit(13)) == 0, F.array().cast("array<string>"))
          .otherwise(F.array("source", "lang")))
    li = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.array(F.lit(1))).otherwise(
        F.array(F.lit(1), F.lit(0)))
    return d.select(F.col("doc_id").alias("sample_id"), text.alias("text"), lt.alias("ltext"),
                    li.alias("lint"))


_VAL_SRC = """src AS (SELECT doc_id AS sample_id,
   CASE WHEN doc_id % 7 = 0 THEN ' _ ' ELSE text END AS text,
   CASE WHEN doc_id % 5 = 0 THEN [source, '_'] WHEN doc_id % 13 = 0 THEN CAST([] AS VARCHAR[])
        ELSE [source, lang] END AS ltext,
   CASE WHEN doc_id % 11 = 0 THEN [1] ELSE [1, 0] END AS lint FROM documents)"""
_REASON = f"""CASE WHEN {S.ensure('text')} = '' THEN 'empty_text'
     WHEN ltext IS NULL OR len(ltext) = 0 THEN 'no_labels'
     WHEN NOT list_bool_and(list_transform(ltext, lambda x: {S.ensure('x')} <> '')) THEN 'blank_label'
     WHEN lint IS NULL OR len(lint) <> len(ltext) THEN 'truth_length' END"""


@register("validate", with_ctes(_VAL_SRC, select=f"""
SELECT sample_id, text, ltext, lint FROM src WHERE ({_REASON}) IS NULL"""))
def validate(spark, sf):
    """B-6: keep valid samples (blank text / labels and length mismatches injected)."""
    return N.validate(_val_src(spark, sf))


@register("reject_reasons", with_ctes(_VAL_SRC, select=f"""
SELECT coalesce({_REASON}, 'valid') AS reason, count(*) AS n FROM src GROUP BY 1"""))
def reject_reasons(spark, sf):
    """B-7: first failing rule per sample, counted."""
    return N.reject_summary(_val_src(spark, sf))


@register("limit_labels", f"""
WITH src AS (SELECT p_partkey AS id, [p_brand, p_type || '_X', 'a_b_c', p_name] AS l, [1, 0, 0, 1] AS t
             FROM part),
ex AS (SELECT id, unnest(l) AS l, unnest(t) AS t, unnest(range(0, 4)) AS i FROM src),
u AS (SELECT id, i, t, CASE WHEN {S.uniform('id', 'i', str(SEED), "'u'")} < 0.9
                          THEN replace(l, '_', ' ') ELSE l END AS l FROM ex)
SELECT id AS sample_id, list_slice(list(l ORDER BY {S.md5_key('id', 'i', str(SEED))}), 1, 3) AS ltext,
       list_slice(list(t ORDER BY {S.md5_key('id', 'i', str(SEED))}), 1, 3) AS lint
FROM u GROUP BY id""")
def limit_labels(spark, sf):
    """B-9: hash-drawn underscore removal (p=0.9), shuffle, first 3."""
    p = _part(spark, sf).select(
        F.col("p_partkey").alias("sample_id"),
        F.array("p_brand", F.concat("p_type", F.lit("_X")), F.lit("a_b_c"), "p_name").alias("ltext"),
        F.array(F.lit(1), F.lit(0), F.lit(0), F.lit(1)).alias("lint"))
    return N.limit_labels(p, 3, shuffle=True, remove_underscores=0.9, seed=SEED)


@register("shuffle_labels", f"""
WITH ex AS (SELECT p_partkey AS id, unnest([p_brand, p_type, p_name]) AS l, unnest([1, 0, 0]) AS t,
                   unnest(range(0, 3)) AS i FROM part)
SELECT id AS sample_id, list(l ORDER BY {S.md5_key('id', 'i', str(SEED))}) AS ltext,
       list(t ORDER BY {S.md5_key('id', 'i', str(SEED))}) AS lint FROM ex GROUP BY id""")
def shuffle_labels(spark, sf):
    """B-8: partition-independent label shuffle (truth moves with label)."""
    p = _part(spark, sf).select(F.col("p_partkey").alias("sample_id"),
                                F.array("p_brand", "p_type", "p_name").alias("ltext"),
                                F.array(F.lit(1), F.lit(0), F.lit(0)).alias("lint"))
    return N.shuffle_labels(p, SEED)


# ---------------------------------------------------- long forms, given classes
@register("norm_attach_vocab_long", f"""
WITH b AS (SELECT p_partkey, {S.ensure('p_brand')} AS y FROM part WHERE {S.ensure('p_brand')} <> ''),
voc AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS label_id FROM (SELECT DISTINCT y FROM b))
SELECT b.p_partkey AS sample_id, voc.label_id, voc.y AS label FROM b JOIN voc ON b.y = voc.y""")
def norm_attach_vocab_long(spark, sf):
    """C-10 in long form: the true label of every row, by number in the vocabulary."""
    p = read(spark, sf, "part").select("p_partkey", N.ensure_string(F.col("p_brand")).alias("y"))
    return N.vocab_long(p.where("y != ''"), "p_partkey", "y")[0]


@register("norm_onehot_long", """
WITH voc AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS label_id FROM (SELECT DISTINCT p_type AS y FROM part))
SELECT p_partkey AS sample_id, label_id, y AS label FROM part JOIN voc ON p_type = y""")
def norm_onehot_long(spark, sf):
    """C-15 in long form."""
    return N.vocab_long(read(spark, sf, "part"), "p_partkey", "p_type")[0]


@register("norm_multilabel_long", """
WITH b AS (SELECT DISTINCT l_orderkey, l_linestatus AS y FROM lineitem),
voc AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS label_id FROM (SELECT DISTINCT y FROM b))
SELECT l_orderkey AS sample_id, label_id, voc.y AS label FROM b JOIN voc ON b.y = voc.y""")
def norm_multilabel_long(spark, sf):
    """C-19 in long form: every order's distinct line states."""
    o = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("ls"))
    return N.vocab_long(o, "l_orderkey", "ls")[0]


_SEGMENTS = ["MACHINERY & Co", "NOT SEEN & Co", "BUILDING & Co", "HOUSEHOLD & Co", "AUTOMOBILE & Co", "FURNITURE & Co"]


@register("norm_clean_names_given", f"""
WITH b AS (SELECT c_custkey, c_name || chr(10) || c_mktsegment AS text, {_CLEAN} AS y FROM customer),
voc AS (SELECT ['machinery_and_co', 'not_seen_and_co', 'building_and_co', 'household_and_co', 'automobile_and_co',
                'furniture_and_co'] AS vocab)
SELECT c_custkey AS sample_id, text, vocab AS ltext, {S.onehot('vocab', 'y')} AS lint FROM b, voc""")
def norm_clean_names_given(spark, sf):
    """C-17 with a given class list: in its order, with a class no row has."""
    c = read(spark, sf, "customer").withColumn(
        "seg", F.concat(F.col("c_mktsegment"), F.lit(" & Co")))
    return N.clean_class_names(c, "c_custkey", "c_name", "c_mktsegment", "seg", names=_SEGMENTS)


@register("norm_null_answer", """
SELECT p_partkey AS sample_id, p_name AS text, ['A', 'B'] AS ltext,
       [CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN p_size % 3 = 1 THEN 1 ELSE 0 END] AS lint FROM part""")
def norm_null_answer(spark, sf):
    """C-4 where a third of the answers are missing: their labels are all false."""
    p = read(spark, sf, "part")
    answer = F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "B")
    return N.mcq_value(p, "p_partkey", "p_name", F.array(F.lit("A"), F.lit("B")), answer)


@register("norm_hierarchy_unmapped", """
WITH h AS (SELECT lower(replace(r.r_name, ' ', '_')) || '_intent' AS y, n.n_nationkey
           FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 5 <> 0),
voc AS (SELECT list(DISTINCT y ORDER BY y) AS vocab FROM h)
SELECT c.c_custkey AS sample_id, c.c_name AS text, vocab AS ltext,
       list_transform(vocab, lambda v: CASE WHEN coalesce(h.y, '') = v THEN 1 ELSE 0 END) AS lint
FROM customer c LEFT JOIN h ON c.c_nationkey = h.n_nationkey, voc""")
def norm_hierarchy_unmapped(spark, sf):
    """C-21 with labels that the hierarchy lacks: kept, without a true label."""
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    hier = nation.where("n_nationkey % 5 <> 0").join(region, nation.n_regionkey == region.r_regionkey).select(
        F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("group"), F.col("n_name").alias("fine"))
    cust = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return N.hierarchy_rollup(cust, "c_custkey", "c_name", "n_name", hier, on_unmapped="keep")
