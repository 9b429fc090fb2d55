"""Packed exchange of 64-bit keys between batches of documents and key cells.

A batch of documents holds many millions of keys (suffix samples, n-grams).
Instead of one row per key, each batch sends one row per *cell* (range of the
key space) with its distinct keys, sorted and delta-coded; the task of a cell
sorts what all batches sent and answers every batch with one value per key in
the same order.  A batch repeats a key at most once, so a key that makes up a
third of the corpus costs one entry per batch.  Batches recompute their keys
instead of keeping them, thus a lost executor costs a recomputation and no
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.shared import keep

SENT = "cell int, batch int, keys binary, extra binary"
ANSWER = "batch int, phase int, cell int, data binary"
_U = np.uint64


#: Bytes of text in a batch.  A task needs some thirty times as much memory.
BATCH_BYTES = 8 << 20
#: Heavy rows that are broadcast (two numbers each); more are joined.
_FEW = 100_000


def batched(docs: DataFrame, doc_id: str, text: str, batch_bytes: int = BATCH_BYTES, rest: Column | None = None) -> tuple[DataFrame, int]:
    """(``batch``, ``id``, ``text``) rows, with ``rest`` if given, and the number of cells.  Rows spread
    over batches of about ``batch_bytes`` by a hash of id and text; a cell gets
    the keys of about two batches' worth of text.  Both numbers follow the
    bytes of text (counted here), not the number of partitions.

    Equal rows whose copies together have more than ``batch_bytes`` (they are
    counted by that hash; rarely there are any) spread by their place in the input
    as well, over as many batches as their bytes need."""
    body = F.coalesce(F.col(text), F.lit(""))
    each = F.xxhash64(F.col(doc_id).cast("string"), body)
    sizes = docs.select(each.alias("h"), F.octet_length(body).cast("long").alias("b"))
    sums = keep(sizes.groupBy("h").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")))
    total = sums.agg(F.sum("b").alias("b")).first()["b"] or 0
    n = max(1, -(-total // batch_bytes))
    more = [] if rest is None else [rest.alias("rest")]
    rows = docs.select(each.alias("h"), F.col(doc_id).alias("id"), body.alias("text"), *more)
    heavy = sums.where((F.col("b") > batch_bytes) & (F.col("n") > 1)).select("h", F.ceil(F.col("b") / batch_bytes).cast("long").alias("of"))
    found = heavy.limit(_FEW + 1).count()
    spread = F.col("h")
    if found:  # the join goes by broadcast if the heavy ones are few
        place = F.monotonically_increasing_id()
        heavy = F.broadcast(heavy) if found <= _FEW else heavy
        rows = rows.withColumn("place", place).join(heavy, "h", "left")
        spread = F.when(F.col("of").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.pmod(F.xxhash64("place"), F.col("of"))))
    batch = F.pmod(spread, F.lit(n)).cast("int")
    return rows.select(batch.alias("batch"), "id", "text", *(["rest"] if more else [])), max(1, n // 2)


def encode(keys: np.ndarray, drop: int = 0) -> bytes:
    """Sorted distinct keys as a header (bytes per step, dropped bits), the
    first key and the steps.  The ``drop`` low bits are left out; steps take as
    many bytes as the largest one needs."""
    if not len(keys):
        return b""
    keys = keys >> _U(drop)
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width, drop]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, _U)
    width, drop = data[0], data[1]
    raw = np.frombuffer(data, np.uint8, offset=10).reshape(-1, width)
    out = np.zeros((len(raw) + 1, 8), np.uint8)
    out[1:, :width] = raw
    out = out.view(_U).reshape(-1)
    out[0] = np.frombuffer(data, _U, 1, offset=2)[0]
    return np.cumsum(out, dtype=_U) << _U(drop)


def slices(keys: np.ndarray, cells: int) -> np.ndarray:
    """Borders of the cells in sorted keys: cells + 1 positions."""
    inner = np.array([(c << 64) // cells for c in range(1, cells)], dtype=_U)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)]))


def send(batch: int, keys: np.ndarray, extra: np.ndarray, cells: int, first: int = 0, drop: int = 0) -> pa.Table:
    """Rows of SENT for sorted distinct keys, with one item of ``extra`` each.
    Cells are numbered from ``first``; a cell that no key falls into gets no row,
    so a batch sends at most as many rows as it has keys; ``drop`` as in ``encode``."""
    at = slices(keys, cells)
    full = np.flatnonzero(at[1:] > at[:-1]).tolist()
    return pa.table({
        "cell": pa.array([first + c for c in full], pa.int32()),
        "batch": pa.array([batch] * len(full), pa.int32()),
        "keys": pa.array([encode(keys[at[c] : at[c + 1]], drop) for c in full], pa.binary()),
        "extra": pa.array([extra[at[c] : at[c + 1]].tobytes() for c in full], pa.binary()),
    })


def gather(table: pa.Table, extra_type) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """What a cell was sent: batches, length of each one's keys, keys, extra."""
    batches = table["batch"].to_pylist()
    keys = [decode(x) for x in table["keys"].to_pylist()]
    extra = [np.frombuffer(x, extra_type) for x in table["extra"].to_pylist()]
    return batches, np.array([len(k) for k in keys]), np.concatenate(keys), np.concatenate(extra)


def answer(phase: int, cell: int, batches: list[int], data: list[bytes]) -> pa.Table:
    n = len(batches)
    return pa.table({
        "batch": pa.array(batches, pa.int32()), "phase": pa.array([phase] * n, pa.int32()),
        "cell": pa.array([cell] * n, pa.int32()), "data": pa.array(data, pa.binary())})


def answers(table: pa.Table, phase: int) -> list[tuple[int, bytes]]:
    """(cell, data) of a phase in the order of the cells."""
    found = zip(table["phase"].to_pylist(), table["cell"].to_pylist(), table["data"].to_pylist())
    return sorted((c, d) for p, c, d in found if p == phase)
