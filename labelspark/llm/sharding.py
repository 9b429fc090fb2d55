"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash u in (0, 1); a record goes to the shard with
the highest score ``-weight / ln(u)``.  The shard depends on nothing but the key
and the list of shards, so adding a shard only moves records into it, and
raising one weight only moves records into that shard.

Only DataFrame functions are used, and choosing the shard needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash cells per shard in which slots are numbered on their own.  A fixed
#: number: 4096 cells of 40 shards keep a cell at 300 000 rows for 5e10 rows.
CELLS = 4096
#: Slots of equal rows that one row expands to at a time.
CHUNK = 100_000


def key_text(key: Column) -> Column:
    """The hashed form of a key; a null key is the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (position in ``weights``) of a key.  A shard of weight 0
    gets nothing; equal scores go to the higher number."""
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights: at least one above 0, none below")
    scored = [F.struct(_score(key, i, w).alias("s"), F.lit(i).alias("i"))
              for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["i"]


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row as column ``out`` (replaced if it is
    there already).  Rows with equal keys share a shard; null keys too."""
    return df.withColumn(out, rendezvous(key_text(F.col(key)), weights).cast("int"))


def expand(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row once for each number from ``first`` to ``last``, as ``slot``.
    Chunks of CHUNK numbers are dealt over the tasks before they are expanded,
    so no row holds more than a chunk, however often it is repeated."""
    chunk = F.explode(F.sequence("first", "last", F.lit(CHUNK).cast("long")))
    rows = rows.withColumn("start", chunk).repartition(*keys, "start")
    return rows.withColumn("slot", F.explode(F.sequence("start", F.least(F.col("start") + CHUNK - 1, "last")))).drop("start")


def sharded(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Manifest of a sharding by key.

    Columns: the key, ``size`` (UTF-8 bytes of the text plus 16; a null text
    has none), ``text_crc32`` (of the empty text for null), ``law`` ('key'),
    ``shard``, ``slot`` (0, 1, ... without gaps within a shard) and
    ``grown_shard`` (the shard with one more of the mean positive weight).
    Other columns of ``df`` are not read.  Equal rows are counted before the
    shuffle and get consecutive slots, so a row that makes up a third of the
    table costs one shuffled row per task and one per CHUNK slots.  An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key).alias("k"),
                     (F.octet_length(body) + 16).cast("long").alias("size"),
                     F.crc32(body).alias("crc"))
    rows = rows.groupBy("k", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    positive = [w for w in weights if w > 0]
    kt = key_text(F.col("k"))
    rows = rows.select(
        "*", rendezvous(kt, weights).cast("int").alias("shard"),
        rendezvous(kt, [*weights, sum(positive) / len(positive)]).cast("int").alias("grown"),
        F.pmod(F.xxhash64(kt, "size", "crc"), F.lit(CELLS)).cast("int").alias("cell"))
    in_cell = Window.partitionBy("shard", "cell").orderBy(F.col("k").asc_nulls_first(), "size", "crc")
    rows = rows.withColumn("upto", F.sum("n").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)))
    cells = rows.groupBy("shard", "cell").agg(F.sum("n").alias("cell_n"))
    # one row per (shard, cell): at most len(weights) * CELLS rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("cell_n").over(before), F.lit(0)).alias("base"))
    rows = rows.join(cells, ["shard", "cell"])
    first = F.col("base") + F.col("upto") - F.col("n")
    rows = expand(rows.withColumns({"first": first, "last": first + F.col("n") - 1}), ["k", "size", "crc"])
    return rows.select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", F.col("grown").alias("grown_shard"))

