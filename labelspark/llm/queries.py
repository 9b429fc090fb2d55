"""The operators of this subpackage bound to the given tables, with the
parameters meant for production.  Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelspark.llm.oracles import ORACLE  # noqa: F401  (part of this module's interface)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak."""
    from labelspark.llm import templates

    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of equal weight by doc_id."""
    from labelspark.llm import sharding

    return sharding.sharded(table(spark, sf_dir, "documents"), [1.0] * 40)


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 400-byte strings that start elsewhere too."""
    from pyspark.sql import functions as F

    from labelspark.llm import suffixes

    return suffixes.repeats(table(spark, sf_dir, "documents"), 400).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents, learned from nine tenths of them;
    rounded to six places, as sums of logarithms depend on their order."""
    from pyspark.sql import functions as F

    from labelspark.llm import lm

    out = lm.score(table(spark, sf_dir, "documents"), order=2)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@query
def op2_superminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on word pairs."""
    from labelspark.llm import neardup

    return neardup.groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def tokenizer_path() -> str:
    """The vocabulary file of the queries; it is installed with its package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and what they decode to, as digests."""
    from pyspark.sql import functions as F

    from labelspark.llm import bpe

    coded = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op6_boosted_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document statistics, the fixed rules and the trees' verdict."""
    from labelspark.llm import rules

    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op3_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores by votes of labelled neighbours."""
    from labelspark.llm import neighbours

    return neighbours.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents after noisy-channel restoration."""
    from labelspark.llm import toxicity

    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, as files of a tree source/lang/doc_id."""
    from pyspark.sql import functions as F

    from labelspark.llm import licences

    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licences.scan(table(spark, sf_dir, "documents"), "doc_id", path)


@query
def op11_partenum_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling forms of the words of all documents."""
    from labelspark.llm import variants

    return variants.group(table(spark, sf_dir, "documents"))


@query
def op12_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors for each whose id is divisible by 20."""
    from labelspark.llm import maxscore

    return maxscore.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op13_accumulator_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    from labelspark.llm import termtime

    return termtime.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)
