"""Training-corpus pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of
the pipeline writes it as Parquet and hands the reread table to the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm import bpe, neardup, queries, shared, suffixes, templates, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, judged by terms learned from ``labels``."""
    return toxicity.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles and a similarity of 0.8, the
    document with the smallest id stays."""
    return neardup.deduplicate(docs, shingle=5, percent=80)


#: Nearly every passage of over fifty words has more bytes than this; the README
#: has the measured share of those that have fewer and stay.
PASSAGE_BYTES = 250


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of PASSAGE_BYTES that start elsewhere too are
    cut out; ``n_chars`` follows the text."""
    out = suffixes.deduplicate(docs, PASSAGE_BYTES)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, in place of its text."""
    return bpe.round_trip(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminate),
    ("bpe", tokens),
]

#: No SQL can express the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what the one before kept."""
    shared.ensure_shared_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}_{name}")
            docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
