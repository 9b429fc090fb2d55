"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(text: Column) -> Column:
    """Lower-case A to Z only (other letters stay)."""
    return F.translate(text, UPPER, LOWER)


def words_sql(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(doc_id, n: int) -> int:
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % n


def ensure_shared_dir(spark: SparkSession) -> None:
    """The folder that ``checkpoint()`` writes to: the one the cluster names in
    ``spark.checkpoint.dir``; only where none is named and the session is
    local (tests) a scratch folder is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is not None:
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder (Spark's cleaner
    removes it once the frame is gone) and go on from there."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)



def values(column, rows: int = 256):
    """Values of an Arrow column, a few rows at a time: whole batches of texts
    as Python strings take several times their room."""
    for lo in range(0, len(column), rows):
        yield from column.slice(lo, rows).to_pylist()


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of ``df``: those with the least hash of ``key`` (ties
    by key).  Rows that can't be among them are dropped before the sort, so
    what the driver and the sort see is about ``n`` rows whatever the table."""
    total = df.count()
    share = min(1.0, (n + 8 * n**0.5 + 64) / max(1, total))
    order = F.shiftrightunsigned(F.xxhash64(key), 2)
    return df.where(order <= F.lit(int(share * (1 << 62)))).orderBy(order, key).limit(n)


_kept: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator remembers in a Python worker from task to task.  Spark
    uses a worker for many stages: the first task of another operator drops
    what the one before remembered, so their memory does not add up."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    return _kept.setdefault(owner, {})
