"""Structured Streaming entry points.

The reference has no streaming, state or event time.  What carries over is
that the row-local operators (normalisers, validation, packing, scoring
against a static label table, JSON parsing) use no sort, window or global
aggregate, so the same functions apply unchanged to a streaming DataFrame.
This module wires them to a file stream and a sink that survives restarts
(checkpointed under the session's shared ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def run_stateless(spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame],
                  sink_path: str, name: str, fmt: str = "parquet",
                  available_now: bool = True) -> StreamingQuery:
    """Apply a row-local operator to a stream and append to ``sink_path``.
    ``availableNow`` processes what is there and stops (batch-like backfill);
    otherwise the query keeps running.  The checkpoint makes the sink
    exactly-once across executor or driver restarts."""
    out = transform(source)
    w = (out.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", scratch_path(spark, f"stream-ckpt-{name}"))
         .option("path", sink_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
