"""Label-schema normalisers (B-1 .. B-9, C-1 .. C-21).

Every normaliser maps a source shape to the canonical sample table
``(sample_id LONG, text STRING, ltext ARRAY<STRING>, lint ARRAY<INT>)`` with
column expressions only (row-local, streaming-safe) except where a corpus
vocabulary is needed (C-8, C-10, C-15, C-19, C-21).  Vocabularies are one-row
aggregates whose size is checked before they are attached to every row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash_int, hash_key, hash_uniform
from .prefix import global_row_number, materialize, running_sums
from ..functions.text import (camel_to_snake, clean_label_multi, clean_name_and,
                              ensure_string, is_blank, join_fields, letter_index, py_strip)

MAX_VOCAB = 100_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical(df: DataFrame, sample_id, text, ltext, lint) -> DataFrame:
    return df.select(_c(sample_id).cast("long").alias("sample_id"),
                     _c(text).cast("string").alias("text"),
                     _c(ltext).cast("array<string>").alias("ltext"),
                     _c(lint).cast("array<int>").alias("lint"))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL: a missing
    answer makes every label false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def onehot(values: Column, target: Column) -> Column:
    """F-16: 1 where the vocabulary entry equals the target, else 0."""
    return F.transform(values, lambda v: flag(v == target))


def multihot(values: Column, targets: Column) -> Column:
    """F-16 (set form): 1 where the entry is contained in the target array."""
    return F.transform(values, lambda v: flag(F.array_contains(targets, v)))


def choose_text_column(df: DataFrame, preferred: str | None = None) -> str:
    """B-3: an explicit column wins; else 'text' if present, else 'sentence'."""
    if preferred and preferred in df.columns:
        return preferred
    return "text" if "text" in df.columns else "sentence"


def build_labels(df: DataFrame, sample_id: str, text: str, positives: str, negatives: str,
                 min_label_length: int = 0) -> DataFrame:
    """B-1 / C-1: strip labels, keep those longer than ``min_label_length``
    (strictly), positives then negatives with truth 1 ... 0."""
    def keep(a):
        stripped = F.transform(F.coalesce(_c(a), F.array().cast("array<string>")), py_strip)
        return F.filter(stripped, lambda x: F.length(x) > min_label_length)
    pos, neg = keep(positives), keep(negatives)
    lint = F.concat(F.array_repeat(F.lit(1), F.size(pos)), F.array_repeat(F.lit(0), F.size(neg)))
    return canonical(df, sample_id, text, F.concat(pos, neg), lint)


def drop_empty(samples: DataFrame) -> DataFrame:
    """B-2: samples with no labels left are removed."""
    return samples.filter(F.size("ltext") > 0)


def reject_reason(text="text", ltext="ltext", lint="lint") -> Column:
    """B-7: the first failing validity rule, NULL when the sample is valid."""
    lt, li = _c(ltext), _c(lint)
    return (F.when(is_blank(ensure_string(_c(text))), F.lit("empty_text"))
            .when(lt.isNull() | (F.size(lt) == 0), F.lit("no_labels"))
            .when(~F.forall(lt, lambda x: ~is_blank(ensure_string(x))), F.lit("blank_label"))
            .when(li.isNull() | (F.size(li) != F.size(lt)), F.lit("truth_length"))
            .when(F.exists(li, lambda x: x.isNull()), F.lit("null_truth")))


def validate(samples: DataFrame, text="text", ltext="ltext", lint="lint") -> DataFrame:
    """B-6: keep valid samples; values stay as they are."""
    return samples.filter(reject_reason(text, ltext, lint).isNull())


def reject_summary(samples: DataFrame, text="text", ltext="ltext", lint="lint") -> DataFrame:
    """B-7: counts per reject reason ('valid' for kept samples)."""
    r = F.coalesce(reject_reason(text, ltext, lint), F.lit("valid"))
    return samples.groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def shuffle_labels(samples: DataFrame, seed: int = 42, sample_id="sample_id",
                   ltext="ltext", lint="lint") -> DataFrame:
    """B-8: reorder (label, truth) pairs by md5(sample | position | seed):
    reproducible under any partitioning, unlike ``shuffle(col, seed)``."""
    z = F.arrays_zip(_c(ltext).alias("l"), _c(lint).alias("t"))
    keyed = F.transform(z, lambda s, i: F.struct(
        hash_key(_c(sample_id), i, F.lit(seed)).alias("k"), s["l"].alias("l"), s["t"].alias("t")))
    srt = F.array_sort(keyed)
    return samples.withColumn(ltext, F.transform(srt, lambda s: s["l"])).withColumn(
        lint, F.transform(srt, lambda s: s["t"]))


def limit_labels(samples: DataFrame, max_labels: int, shuffle: bool = True,
                 remove_underscores: float = 0.9, seed: int = 42, sample_id="sample_id",
                 ltext="ltext", lint="lint") -> DataFrame:
    """B-9: each label loses its underscores with probability p (hash draw per
    sample and position), optional B-8 shuffle, then the first ``max_labels``."""
    p = F.lit(float(remove_underscores))
    lab = F.transform(_c(ltext), lambda x, i: F.when(
        hash_uniform(_c(sample_id), i, F.lit(seed), F.lit("u")) < p,
        F.replace(x, F.lit("_"), F.lit(" "))).otherwise(x))
    out = samples.withColumn(ltext, lab)
    if shuffle:
        out = shuffle_labels(out, seed, sample_id, ltext, lint)
    return out.withColumn(ltext, F.slice(ltext, 1, max_labels)).withColumn(
        lint, F.slice(lint, 1, max_labels))


# --------------------------------------------------------------- C-2 .. C-7
def mcq_struct(df: DataFrame, sample_id, question, choices, answer_key,
               text_key: str = "text", label_key: str = "label") -> DataFrame:
    """C-2: choices {text[], label[]}; truth = label[i] == answerKey."""
    ch = _c(choices)
    labels = F.coalesce(ch[label_key], F.array().cast("array<string>"))
    texts = F.coalesce(ch[text_key], F.array().cast("array<string>"))
    return canonical(df, sample_id, ensure_string(question), F.transform(texts, lambda x: ensure_string(x)),
                     onehot(labels, _c(answer_key)))


def mcq_index(df: DataFrame, sample_id, question, choices, answer) -> DataFrame:
    """C-3: plain list of choices, the answer is a position."""
    ch = _c(choices)
    return canonical(df, sample_id, ensure_string(question), F.transform(ch, lambda x: ensure_string(x)),
                     F.transform(ch, lambda c, i: flag(i == _c(answer))))


def mcq_value(df: DataFrame, sample_id, question, choices, answer) -> DataFrame:
    """C-4: the answer is the raw (un-normalised) choice value."""
    ch = _c(choices)
    return canonical(df, sample_id, ensure_string(question), F.transform(ch, lambda x: ensure_string(x)),
                     onehot(ch, _c(answer)))


def dialogue(df: DataFrame, sample_id, turns, queries) -> DataFrame:
    """C-5: one sample per nested query; text = question + '\\n' + turns
    joined by newlines.  Samples are numbered 0, 1, ... over all queries in the
    order of (dialogue id, position in the dialogue), so ids never collide."""
    src = df.select(_c(sample_id).alias("_id"), _c(turns).alias("_turns"), _c(queries).alias("_q"))
    counted = running_sums(src.withColumn("_k", F.greatest(F.size("_q"), F.lit(0)).cast("long")), [], [("_id", True)],
                           {"_first": F.col("_k")}, inclusive=False)
    ex = counted.select("_first", "_turns", F.posexplode("_q").alias("_qi", "_q"))
    text = ensure_string(F.concat(ex["_q.question"], F.lit("\n"),
                                  F.array_join(F.col("_turns"), "\n")))
    choice = F.col("_q.choice")
    return canonical(ex, F.col("_first") + F.col("_qi"), text,
                     F.transform(choice, lambda x: ensure_string(x)), onehot(choice, F.col("_q.answer")))


def map_options(df: DataFrame, sample_id, question, story, options, answer) -> DataFrame:
    """C-6: labels = map values (ordered by key), truth = key == answer."""
    ent = F.array_sort(F.map_entries(_c(options)))
    text = ensure_string(F.concat(_c(question), F.lit("\n"), _c(story)))
    return canonical(df, sample_id, text,
                     F.transform(ent, lambda e: ensure_string(e["value"].cast("string"))),
                     F.transform(ent, lambda e: flag(e["key"] == _c(answer))))


def letter_answer(df: DataFrame, sample_id, question, article, options, answer) -> DataFrame:
    """C-7: answer letter -> index ord(answer) - ord('A')."""
    text = ensure_string(F.concat(_c(question), F.lit("\n"), _c(article)))
    idx = letter_index(_c(answer))
    return canonical(df, sample_id, text, F.transform(_c(options), lambda x: ensure_string(x)),
                     F.transform(_c(options), lambda o, i: flag(i == idx)))


# --------------------------------------------------------------- vocabularies
def checked_vocab(values: DataFrame, col: str, max_size: int = MAX_VOCAB) -> DataFrame:
    """One-row DataFrame holding the sorted distinct ``col`` values as an array.

    The distinct set is computed distributed; its size is checked (a bounded
    count) before it is gathered into one row and broadcast to every sample.
    """
    d = materialize(values.select(F.col(col).alias("v")).filter(F.col("v").isNotNull()).distinct())
    n = d.limit(max_size + 1).count()
    if n > max_size:
        raise ValueError(f"vocabulary has more than {max_size} entries; "
                         "use the long (exploded) form instead")
    return d.agg(F.sort_array(F.collect_list("v")).alias("vocab"))


def attach_vocab(df: DataFrame, vocab: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(vocab))


def sampled_negatives(df: DataFrame, sample_id, text, summary, seed: int = 42,
                      max_negatives: int = 4) -> DataFrame:
    """C-8: label set = the sample's own summary plus 1..4 vocabulary entries
    drawn independently per row and without replacement (may include the
    summary itself, which then also has truth 1), shuffled.

    Each draw is a hash of the row and the draw's number.  Draw m of k takes a
    number up to n - k + m; one that is taken already becomes n - k + m itself,
    which makes every set of k numbers equally likely."""
    base = df.select(_c(sample_id).cast("long").alias("_id"), ensure_string(text).alias("_t"),
                     ensure_string(summary).alias("_s"))
    vocab = materialize(base.filter(F.col("_s") != "").select(F.col("_s").alias("_v")).distinct()
             .withColumn("_vk", F.conv(F.substring(hash_key(F.col("_v"), F.lit(seed)), 1, 15),
                                       16, 10).cast("long")))
    # dense index in hash order, distributed (no single-partition window)
    vix = global_row_number(vocab, [("_vk", True), ("_v", True)], out="_vi").select(
        "_v", (F.col("_vi") - 1).alias("_vi"))
    size = vocab.agg(F.count(F.lit(1)).alias("_n"))
    b = base.crossJoin(F.broadcast(size))
    n_neg = F.least(F.lit(1) + hash_int(max_negatives, F.col("_id"), F.lit(seed), F.lit("n")),
                    F.col("_n"))
    b = b.withColumn("_k", n_neg.cast("long"))
    drawn: list[Column] = []
    for m in range(max_negatives):
        top = F.col("_n") - F.col("_k") + m
        t = hash_int(top + 1, F.col("_id"), F.lit(seed), F.lit(f"s{m}"))
        taken = F.array_contains(F.array(*drawn), t) if drawn else F.lit(False)
        b = b.withColumn(f"_d{m}", F.when(F.col("_k") > m, F.when(taken, top).otherwise(t)))
        drawn.append(F.col(f"_d{m}"))
    picks = b.select("_id", F.posexplode(F.array(*drawn)).alias("_m", "_vi")).where("_vi is not null")
    negs = picks.join(vix, on="_vi", how="inner").groupBy("_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_m", "_v"))), lambda s: s["_v"])
        .alias("_negs"))
    j = base.join(negs, on="_id", how="left")
    labels = F.concat(F.array(F.col("_s")), F.coalesce(F.col("_negs"),
                                                       F.array().cast("array<string>")))
    out = canonical(j, "_id", "_t", labels, onehot(labels, F.col("_s")))
    return shuffle_labels(out, seed)


def binary_answer(df: DataFrame, sample_id, question, answer) -> DataFrame:
    """C-9: labels ['false', 'true'], truth [1 - a, a]; [0, 0] without an answer."""
    a = _c(answer).cast("int")
    return canonical(df, sample_id, ensure_string(question),
                     F.array(F.lit("false"), F.lit("true")), F.array(flag(a == 0), flag(a == 1)))


def vocab_onehot(df: DataFrame, sample_id, text, target, clean: bool = True,
                 max_size: int = MAX_VOCAB) -> DataFrame:
    """C-10 (clean=True: ensure_string, empty excluded) and C-15 (raw class
    text): every row gets the sorted distinct vocabulary, one-hot truth."""
    t = ensure_string(target) if clean else _c(target)
    base = df.select(_c(sample_id).alias("_id"),
                     (ensure_string(text) if clean else _c(text)).alias("_t"), t.alias("_y"))
    src = base.filter(F.col("_y") != "") if clean else base
    vocab = checked_vocab(src, "_y", max_size)
    j = attach_vocab(base, vocab)
    return canonical(j, "_id", "_t", F.col("vocab"), onehot(F.col("vocab"), F.col("_y")))


def multi_answer_map(df: DataFrame, sample_id, question, explanation, choices,
                     correct) -> DataFrame:
    """C-11: drop empty options, labels = normalised values (key order),
    truth = key in the correct-answers array."""
    ent = F.filter(F.array_sort(F.map_entries(_c(choices))),
                   lambda e: e["value"].isNotNull() & (e["value"] != ""))
    text = ensure_string(F.concat(_c(question), F.lit("\n"), _c(explanation)))
    return canonical(df, sample_id, text,
                     F.transform(ent, lambda e: ensure_string(e["value"])),
                     F.transform(ent, lambda e: flag(F.array_contains(_c(correct), e["key"]))))


def all_positive(df: DataFrame, sample_id, text, labels) -> DataFrame:
    """C-12: every label is true."""
    return canonical(df, sample_id, ensure_string(text), F.transform(_c(labels), lambda x: ensure_string(x)),
                     F.array_repeat(F.lit(1), F.size(_c(labels))))


def binary_names(df: DataFrame, sample_id, text, label, names: Sequence[str]) -> DataFrame:
    """C-13: a 0/1 label with a fixed name pair."""
    y = _c(label).cast("int")
    return canonical(df, sample_id, text, F.array(*[F.lit(n) for n in names]),
                     F.array(flag(y == 0), flag(y == 1)))


def class_index(df: DataFrame, sample_id, text, label, names: Sequence[str]) -> DataFrame:
    """C-14: class index into a fixed class-name list, one-hot."""
    idx = F.sequence(F.lit(0), F.lit(len(names) - 1))
    return canonical(df, sample_id, text, F.array(*[F.lit(n) for n in names]),
                     F.transform(idx, lambda i: flag(i == _c(label))))


def wide_indicators(df: DataFrame, sample_id, text, columns: Sequence[str]) -> DataFrame:
    """C-16: indicator columns -> multi-hot over their names."""
    return canonical(df, sample_id, text, F.array(*[F.lit(c) for c in columns]),
                     F.array(*[flag(F.col(c) == 1) for c in columns]))


def clean_class_names(df: DataFrame, sample_id, title, content, label,
                      names: Sequence[str] | None = None, max_size: int = MAX_VOCAB) -> DataFrame:
    """C-17: class names '&' -> 'and', ' ' -> '_', lower; text title\\ncontent."""
    base = df.select(_c(sample_id).alias("_id"), join_fields(title, content).alias("_t"),
                     clean_name_and(_c(label)).alias("_y"))
    if names is not None:  # the given classes, seen or not, in the given order
        given = F.transform(F.array(*[F.lit(n) for n in names]), clean_name_and)
        return canonical(base.withColumn("vocab", given), "_id", "_t", F.col("vocab"), onehot(F.col("vocab"), F.col("_y")))
    vocab = checked_vocab(base, "_y", max_size)
    j = attach_vocab(base, vocab)
    return canonical(j, "_id", "_t", F.col("vocab"), onehot(F.col("vocab"), F.col("_y")))


def camel_class_names(df: DataFrame, sample_id, title, content, label,
                      names: Sequence[str] | None = None, max_size: int = MAX_VOCAB) -> DataFrame:
    """C-18: CamelCase class names -> lower snake case; text title\\ncontent."""
    base = df.select(_c(sample_id).alias("_id"), join_fields(title, content).alias("_t"),
                     camel_to_snake(_c(label)).alias("_y"))
    if names is not None:  # the given classes, seen or not, in the given order
        given = F.transform(F.array(*[F.lit(n) for n in names]), camel_to_snake)
        return canonical(base.withColumn("vocab", given), "_id", "_t", F.col("vocab"), onehot(F.col("vocab"), F.col("_y")))
    vocab = checked_vocab(base, "_y", max_size)
    j = attach_vocab(base, vocab)
    return canonical(j, "_id", "_t", F.col("vocab"), onehot(F.col("vocab"), F.col("_y")))


def multilabel_vocab(df: DataFrame, sample_id, title, content, third, all_labels,
                     third_name: str = "", max_size: int = MAX_VOCAB) -> DataFrame:
    """C-19: vocabulary = union of every row's label array (sorted by raw
    label); shown cleaned; truth = raw label in the row's set.  ``third_name``
    introduces the third field of the text."""
    base = df.select(_c(sample_id).alias("_id"),
                     F.concat(join_fields(title, content), F.lit(f"\n{third_name}"),
                              F.coalesce(_c(third).cast("string"), F.lit(""))).alias("_t"),
                     _c(all_labels).alias("_ls"))
    vocab = checked_vocab(base.select(F.explode("_ls").alias("_v")), "_v", max_size)
    j = attach_vocab(base, vocab)
    return canonical(j, "_id", "_t", F.transform(F.col("vocab"), clean_label_multi),
                     multihot(F.col("vocab"), F.col("_ls")))


def dict_suffix(df: DataFrame, sample_id, text, label, mapping: Mapping, suffix: str) -> DataFrame:
    """C-20: class id through a fixed dict, names lower-cased + suffix."""
    keys = list(mapping.keys())
    names = [str(mapping[k]).lower() + suffix for k in keys]
    kl = F.array(*[F.lit(k) for k in keys])
    return canonical(df, sample_id, text, F.array(*[F.lit(n) for n in names]),
                     F.transform(kl, lambda k: flag(k == _c(label))))


def hierarchy_rollup(df: DataFrame, sample_id, text, label, hierarchy: DataFrame,
                     grouped: bool = True, suffix: str = "_intent", on_unmapped: str = "raise",
                     max_size: int = MAX_VOCAB) -> DataFrame:
    """C-21: fine label -> group label + suffix through a (group, fine)
    dimension table, one-hot over all groups of the hierarchy; with
    ``grouped=False`` the labels of the data are the classes.

    A label that the hierarchy lacks fails the job, or with
    ``on_unmapped='keep'`` gives a sample without a true label; no row is
    dropped."""
    base = df.select(_c(sample_id).alias("_id"), _c(text).alias("_t"), _c(label).alias("_f"))
    if not grouped:
        vocab = checked_vocab(base, "_f", max_size)
        return canonical(attach_vocab(base, vocab), "_id", "_t", F.col("vocab"), onehot(F.col("vocab"), F.col("_f")))
    dim = hierarchy.select(F.col("fine").alias("_f"), F.concat(F.col("group"), F.lit(suffix)).alias("_y"))
    vocab = checked_vocab(dim, "_y", max_size)
    j = base.join(dim, on="_f", how="left")
    if on_unmapped == "raise":
        message = F.concat(F.lit("label is not in the hierarchy: "), F.coalesce("_f", F.lit("NULL")))
        j = j.withColumn("_y", F.when(F.col("_y").isNull(), F.raise_error(message)).otherwise(F.col("_y")))
    j = attach_vocab(j, vocab)
    return canonical(j, "_id", "_t", F.col("vocab"), onehot(F.col("vocab"), F.col("_y")))


def vocab_table(values: DataFrame, col: str) -> DataFrame:
    """(label_id, label): the sorted distinct non-NULL values, numbered from 0.
    Of any size: nothing is gathered in one place."""
    d = values.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return global_row_number(d, [("label", True)], out="_n").select((F.col("_n") - 1).alias("label_id"), "label")


def vocab_long(df: DataFrame, sample_id, target) -> tuple[DataFrame, DataFrame]:
    """Long form of C-10, C-15 and C-19 for a vocabulary of any size: the true
    labels as (sample_id, label_id, label), and the vocabulary itself.  Every
    other (sample, label) pair is false.  ``target`` is a value or an array."""
    t = _c(target)
    base = df.select(_c(sample_id).cast("long").alias("sample_id"), t.alias("label"))
    if dict(base.dtypes)["label"].startswith("array"):
        base = base.select("sample_id", F.explode("label").alias("label"))
    vocab = vocab_table(base, "label")
    return base.join(vocab, "label").select("sample_id", "label_id", "label"), vocab
