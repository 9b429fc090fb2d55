"""A-3 / B-7 at run time: good samples, quarantined rows and reject counts from
one scan.

Records that can't be parsed and samples that break a validity rule are kept with
their reason instead of failing the job or vanishing.  The counts come from an
observation in the very pass that writes the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import reject_reason
from ..session import scratch_path

CORRUPT, VALID = "corrupt_record", "valid"
REASONS = (CORRUPT, "empty_text", "no_labels", "blank_label", "truth_length", "null_truth")


@dataclass(frozen=True)
class Loaded:
    samples: DataFrame  # canonical, valid
    rejected: DataFrame  # reason, record (as JSON, or as it was read)
    counts: dict[str, int]  # by reason, with "valid"


def load_quarantined(spark: SparkSession, path: str, schema: T.StructType,
                     columns: Callable[[], dict[str, Column]] | None = None, fmt: str = "json",
                     ignore_corrupt_files: bool = False) -> Loaded:
    """Read records of ``schema`` (JSON or CSV), map them to ``sample_id``, ``text``,
    ``ltext``, ``lint`` (``columns()`` gives an expression for each; by default
    columns of these names) and part the valid samples from the others.

    A record that can't be parsed, a truncated last line included, is rejected as
    ``corrupt_record`` and keeps its text.  ``ignore_corrupt_files`` also goes on
    where a compressed file breaks off.  The table is written once, to the shared
    folder; a missing path still fails."""
    raw = (spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]))
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
           .option("ignoreCorruptFiles", ignore_corrupt_files).format(fmt).load(path))
    own = columns() if columns else {c: F.col(c) for c in ("sample_id", "text", "ltext", "lint")}
    broken = F.col("_corrupt").isNotNull()
    mapped = raw.select(
        own["sample_id"].cast("long").alias("sample_id"), own["text"].cast("string").alias("text"),
        own["ltext"].cast("array<string>").alias("ltext"), own["lint"].cast("array<int>").alias("lint"),
        F.when(broken, F.col("_corrupt")).otherwise(F.to_json(F.struct(*schema.fieldNames()))).alias("record"), broken.alias("_broken"))
    reason = F.when(F.col("_broken"), F.lit(CORRUPT)).otherwise(F.coalesce(reject_reason(), F.lit(VALID)))
    marked = mapped.withColumn("reason", reason).drop("_broken")
    good = F.col("reason") == VALID
    marked = marked.withColumn("record", F.when(~good, F.col("record")))
    seen = Observation(f"load-{uuid.uuid4().hex}")
    marked = marked.observe(seen, *[F.count_if(F.col("reason") == r).alias(r) for r in (VALID, *REASONS)])
    out = scratch_path(spark, f"tables/{uuid.uuid4().hex}")
    marked.write.partitionBy("reason").parquet(out)
    counts = {r: n for r, n in seen.get.items() if n}
    table = spark.read.schema(marked.schema).parquet(out)
    return Loaded(table.where(good).select("sample_id", "text", "ltext", "lint"),
                  table.where(~good).select("reason", "record"), counts)
