"""Table access and derived fixtures built from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.classify import score_pairs
from ..operators.pooling import centroids

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round DOUBLE / FLOAT columns (and arrays of them) once, at the end."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), places)
        elif (isinstance(f.dataType, T.ArrayType)
              and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType))):
            c = F.transform(c, lambda x: F.round(x.cast("double"), places))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-label mean embedding: the candidate label vectors."""
    emb = embedding_vectors(spark, sf_dir)
    return centroids(emb, "label", "v").select(
        F.col("label").alias("cand"), F.col("centroid").alias("label_vec"))


def scored_pairs(spark: SparkSession, sf_dir: str, head: str = "cosine",
                 activation: str = "sigmoid", dims: int | None = None,
                 weights=None, matrix=None, bias: float = 0.0) -> DataFrame:
    """Every embedding against every label centroid with one similarity head."""
    emb = embedding_vectors(spark, sf_dir)
    cent = label_centroids(spark, sf_dir)
    tv, lv = F.col("v"), F.col("label_vec")
    if dims:
        tv, lv = F.slice(tv, 1, dims), F.slice(lv, 1, dims)
    texts = emb.select(F.col("vec_id").alias("sample_id"),
                       F.col("label").alias("true_label"), tv.alias("text_vec"))
    labels = cent.select("cand", lv.alias("label_vec"))
    s = score_pairs(texts, labels, "text_vec", "label_vec", head=head, weights=weights,
                    matrix=matrix, bias=bias, activation=activation)
    return s.select(
        "sample_id",
        (F.col("cand") + 1).cast("int").alias("label_id"),
        F.concat(F.lit("c"), F.col("cand").cast("string")).alias("label"),
        (F.col("true_label") == F.col("cand")).cast("int").alias("truth"),
        "logit", "score")


def flagship_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``pred`` fixture: round(sigmoid(cos * e^2), 6) per (vector, label)."""
    s = scored_pairs(spark, sf_dir)
    return s.select("sample_id", "label_id", "label", "truth",
                    F.round("score", 6).alias("score"), "logit")


def multilabel_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-label multi-hot fixture from labels joined to documents: truth =
    (quality, toxic); scores are deterministic functions of the document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = lab.join(docs, on="doc_id", how="inner")
    q = F.round(F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0)), 6)
    t = F.round(F.pmod(F.col("doc_id") * 37 + F.col("n_chars"), F.lit(1000)) / F.lit(1000.0), 6)
    both = F.array(
        F.struct(F.lit(1).alias("label_id"), F.lit("quality").alias("label"),
                 F.col("quality").cast("int").alias("truth"), q.alias("score")),
        F.struct(F.lit(2).alias("label_id"), F.lit("toxic").alias("label"),
                 F.col("toxic").cast("int").alias("truth"), t.alias("score")))
    return j.select(F.col("doc_id").alias("sample_id"), F.inline(both))
