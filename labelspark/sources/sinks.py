"""Sinks (A-7, A-8, A-10).

Outputs go to a shared folder (``spark.checkpoint.dir`` by default): never a
machine-local temporary folder.  Writes are whole-job commits through
Spark's output committer, so a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairs import dataset_labels, dataset_record
from ..operators.prefix import global_row_number


def batch_numbers(df: DataFrame, order_col: str, batch_size: int = 50, start_index: int = 0,
                  out: str = "batch") -> DataFrame:
    """A-7: record n (1-based, along ``order_col``) goes to batch
    ``(n - 1) // batch_size + start_index // batch_size + 1``."""
    r = global_row_number(df, [(order_col, True)], out="_rn")
    first = start_index // batch_size + 1
    return r.withColumn(out, (F.floor((F.col("_rn") - 1) / batch_size) + first).cast("long")) \
            .drop("_rn")


def write_batches(df: DataFrame, path: str, order_col: str, batch_size: int = 50,
                  start_index: int = 0, mode: str = "overwrite") -> None:
    """A-7: JSON lines, one folder per batch number (``batch=0001`` style
    names: at least four digits, more where the number has more); every batch holds at most
    ``batch_size`` records."""
    b = batch_numbers(df, order_col, batch_size, start_index)
    b = b.withColumn("batch", F.format_string("%04d", "batch"))
    b.repartition("batch").write.mode(mode).partitionBy("batch").json(path)


def write_results(metrics: DataFrame, detail: DataFrame | None, path: str,
                  mode: str = "overwrite") -> None:
    """A-8: metrics summary (one small JSON file) plus the per-sample detail
    as parquet next to it."""
    metrics.coalesce(1).write.mode(mode).json(f"{path}/metrics")
    if detail is not None:
        detail.write.mode(mode).parquet(f"{path}/detail")


def write_detail_json(pred: DataFrame, path: str, sample: str = "sample_id",
                      label_id: str = "label_id", score: str = "score", truth: str = "truth",
                      mode: str = "overwrite") -> None:
    """A-8 detail in the reference's nested shape: one JSON line per sample
    with ``predictions`` and ``true_labels`` arrays in label order (each
    sample's labels form one bounded group)."""
    g = pred.groupBy(sample).agg(F.array_sort(F.collect_list(
        F.struct(F.col(label_id).alias("i"), F.col(score).alias("s"),
                 F.col(truth).alias("t")))).alias("_a"))
    g.select(sample, F.transform("_a", lambda x: x["s"]).alias("predictions"),
             F.transform("_a", lambda x: x["t"]).alias("true_labels")) \
     .write.mode(mode).json(path)


def write_dataset_info(df: DataFrame, path: str, num_negatives: int = 3, split: str = "split", labels: str = "labels",
                       not_labels: str | None = "not_labels", mode: str = "overwrite") -> None:
    """A-10: the record of every split and of all (small JSON), and the label
    lists as parquet, one folder per split."""
    dataset_record(df, num_negatives, split, labels, not_labels).coalesce(1).write.mode(mode).json(f"{path}/record")
    dataset_labels(df, split, labels, not_labels).write.mode(mode).partitionBy(split).parquet(f"{path}/labels")
