"""Training / evaluation pair construction (J-4 .. J-7, G-3, D-9, E-32,
E-30, E-31, I-2, I-3, D-11, A-10).

Input is a triplet corpus ``(sample_id, text, labels[], not_labels[])``.
The cycled-negative rule needs a running counter over every emitted pair of
the whole corpus: it is a distributed prefix sum over per-sample pair counts
(one row per sample), never a single-partition window over the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash_int, hash_key
from .prefix import global_row_number, materialize, running_sums


def contrastive_pairs(df: DataFrame, sample_id: str = "sample_id", text: str = "text",
                      labels: str = "labels", not_labels: str | None = "not_labels") -> DataFrame:
    """J-4: one (text, positive[, negative]) row per positive label.  With
    negatives, the n-th emitted pair of the corpus (samples by id, positives
    in order, n from 1) takes ``not_labels[(n - 1) mod L]``; samples without
    negatives emit nothing."""
    if not_labels is None or not_labels not in df.columns:
        return df.select(sample_id, text, F.posexplode(labels).alias("pos", "positive")) \
                 .select(sample_id, text, "pos", "positive")
    d = df.filter(F.size(not_labels) > 0)
    counts = d.select(sample_id, F.size(labels).cast("long").alias("_k"))
    offs = running_sums(counts, [], [(sample_id, True)], {"_off": F.col("_k")},
                        inclusive=False).select(sample_id, "_off")
    j = d.join(offs, on=sample_id, how="inner")
    ex = j.select(sample_id, text, not_labels, "_off",
                  F.posexplode(labels).alias("pos", "positive"))
    n = F.col("_off") + F.col("pos") + 1
    neg = F.element_at(F.col(not_labels), (F.pmod(n - 1, F.size(not_labels)) + 1).cast("int"))
    return ex.select(sample_id, text, "pos", "positive", neg.alias("negative"))


def negative_tuples(df: DataFrame, num_negatives: int = 3, sample_id: str = "sample_id",
                    text: str = "text", labels: str = "labels",
                    not_labels: str = "not_labels") -> DataFrame:
    """J-5 / B-12: samples with at least ``num_negatives`` negatives; one row
    per positive with the first negatives as columns."""
    d = df.filter(F.size(not_labels) >= num_negatives)
    ex = d.select(sample_id, text, not_labels, F.posexplode(labels).alias("pos", "positive"))
    return ex.select(sample_id, text, "pos", "positive",
                     *[F.element_at(not_labels, i + 1).alias(f"negative_{i + 1}")
                       for i in range(num_negatives)])


def random_other_negatives(pairs: DataFrame, seed: int = 42, sample_id: str = "sample_id",
                           pos: str = "pos", positive: str = "positive") -> DataFrame:
    """J-6 / D-9: for pairs without negatives, a random *other* positive.

    Distinct positives are numbered 0..V-1 (distributed prefix sum); each pair
    draws j in [0, V-2] from a hash of its key and takes entry j, shifted by
    one when j reaches its own positive's number.  Two equi-joins, no
    pair x vocabulary product.  Pairs are dropped when V < 2.
    """
    vocab = materialize(pairs.select(F.col(positive).alias("_v")).distinct())
    h = F.conv(F.substring(hash_key(F.col("_v"), F.lit(seed)), 1, 15), 16, 10).cast("long")
    vocab = global_row_number(vocab.withColumn("_h", h),
                              [("_h", True), ("_v", True)], out="_vi").select(
        "_v", (F.col("_vi") - 1).alias("_vi"))
    size = vocab.agg(F.count(F.lit(1)).alias("_n"))
    p = (pairs.join(vocab.withColumnRenamed("_v", positive).withColumnRenamed("_vi", "_own"),
                    on=positive, how="inner")
         .crossJoin(F.broadcast(size)).filter(F.col("_n") >= 2))
    j = hash_int(F.col("_n") - 1, F.col(sample_id), F.col(pos), F.lit(seed))
    p = p.withColumn("_vi", F.when(j >= F.col("_own"), j + 1).otherwise(j))
    out = p.join(vocab.withColumnRenamed("_v", "negative"), on="_vi", how="inner")
    return out.drop("_vi", "_own", "_n")


def evaluation_pairs(triplets: DataFrame, text: str = "text", positive: str = "positive",
                     negative: str = "negative") -> DataFrame:
    """J-7 / I-3 / E-32: (text, positive, 1) and (text, negative, 0), de-duplicated
    on (text, label); the first occurrence wins, i.e. a positive beats a negative."""
    u = pairs_union(triplets, text, positive, negative)
    return u.groupBy(text, "label").agg(F.max("flag").alias("flag"))


def pairs_union(triplets: DataFrame, text: str = "text", positive: str = "positive",
                negative: str = "negative") -> DataFrame:
    """I-3: positives labelled 1 union negatives labelled 0 (no de-duplication),
    emitted in one pass per input row."""
    both = F.array(F.struct(F.col(positive).alias("label"), F.lit(1).alias("flag")),
                   F.struct(F.col(negative).alias("label"), F.lit(0).alias("flag")))
    return triplets.select(text, F.inline(both))


def label_vocabulary(df: DataFrame, labels: str = "labels",
                     not_labels: str | None = "not_labels") -> DataFrame:
    """E-30 / I-2: distinct labels over both arrays (one row per label)."""
    cols = [labels] + ([not_labels] if not_labels and not_labels in df.columns else [])
    arr = F.concat(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    return df.select(F.explode(arr).alias("label")).distinct()


def vocabulary_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """D-11 / I-2: sizes of two vocabularies, their intersection and union."""
    both = a.select("label", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select("label", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    g = both.groupBy("label").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return g.agg(F.sum("_a").alias("n_first"), F.sum("_b").alias("n_second"),
                 F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_overlap"),
                 F.count(F.lit(1)).alias("n_union"))


def dataset_statistics(df: DataFrame, split: str = "split", labels: str = "labels",
                       not_labels: str | None = "not_labels") -> DataFrame:
    """E-31 / A-10: per split row counts, pair counts, has-negatives flag and
    distinct labels, plus an 'all' row (ROLLUP)."""
    cols = [labels] + ([not_labels] if not_labels and not_labels in df.columns else [])
    arr = F.concat(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    has_neg = (F.size(not_labels) > 0) if len(cols) > 1 else F.lit(False)
    rows = df.select(split, F.size(labels).alias("_np"), has_neg.alias("_hn"), arr.alias("_all"))
    per = rows.rollup(split).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("_np").cast("long").alias("n_positives"),
        F.count_if("_hn").alias("n_with_negatives"))
    labs = rows.select(split, F.explode("_all").alias("label")).distinct()
    nl = labs.rollup(split).agg(F.countDistinct("label").alias("n_unique_labels"))
    return per.join(nl, on=per[split].eqNullSafe(nl[split]), how="left").select(
        per[split], "n_samples", "n_positives", "n_with_negatives",
        F.coalesce(nl["n_unique_labels"], F.lit(0)).alias("n_unique_labels"))


def dataset_labels(df: DataFrame, split: str = "split", labels: str = "labels",
                   not_labels: str | None = "not_labels") -> DataFrame:
    """A-10: the label list of every split, one row per (split, label)."""
    cols = [labels] + ([not_labels] if not_labels and not_labels in df.columns else [])
    lists = [df.select(split, F.explode(c).alias("label")) for c in cols]
    out = lists[0].unionByName(lists[1]) if len(lists) > 1 else lists[0]
    return out.distinct()


def dataset_record(df: DataFrame, num_negatives: int = 3, split: str = "split", labels: str = "labels",
                   not_labels: str | None = "not_labels") -> DataFrame:
    """A-10: ``dataset_statistics`` with the pairs a split gives for training
    (J-5: a positive of a sample with ``num_negatives`` negatives or more) and
    the triplets it gives for evaluation (J-4, and J-6 without negatives), as
    rows of the tables those operators build; null lists hold nothing."""
    neg = not_labels if not_labels and not_labels in df.columns else None
    n_pos, n_neg = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) if c else F.lit(0) for c in (labels, neg))
    rows = df.select(split, n_pos.cast("long").alias("_p"), n_neg.alias("_n"))
    counts = rows.rollup(split).agg(
        F.sum(F.when(F.col("_n") >= num_negatives, F.col("_p")).otherwise(0)).alias("n_train_pairs"),
        F.sum(F.when((F.col("_n") > 0) | F.lit(neg is None), F.col("_p")).otherwise(0)).alias("n_eval_triplets"))
    stats = dataset_statistics(df, split, labels, not_labels)
    return stats.join(counts, on=stats[split].eqNullSafe(counts[split]), how="left").select(
        *[stats[c] for c in stats.columns], "n_train_pairs", "n_eval_triplets")
