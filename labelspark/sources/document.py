"""A-8 / A-9: one large results document, written and read in parallel.

The document is ``{..., "detailed_results": {"predictions": [[...], ...],
"true_labels": [[...], ...], ...}, ...}``: a file, or a folder whose part files
give the document when put together in the order of their names (what
:func:`write_results_document` leaves).

Reading never holds the document as one value.  It is cut into blocks of
bytes.  A first job reduces each block to the parity of its quotes and its
change of bracket depth, for a block that starts outside a string and one that
starts inside; joined in order they give every block's true state.  A second
job finds the two arrays and counts the samples that begin in each block.  The
driver holds a few numbers for each block.  The rows come from a data source
whose partitions are ranges of samples: each seeks its range in both arrays, so
no join brings predictions and truths together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.prefix import materialize
from .numbered import filesystem
from .readers import flatten_results

NAME = "results_document"
PARENT, ARRAYS = "detailed_results", ("predictions", "true_labels")
BLOCK = 8 << 20
LOOK = 1024  # bytes before a block that may hold a key and the space after it


class Parts:
    """The bytes of a document that lies in one file or in part files."""

    def __init__(self, path: str, files: list[tuple[str, int]]):
        self.path, self.files = path, files
        self.starts = np.cumsum([0] + [size for _, size in files])
        self.size = int(self.starts[-1])

    @classmethod
    def find(cls, path: str) -> Parts:
        from pyarrow.fs import FileSelector, FileType

        fs, base = filesystem(path.rstrip("/"))
        info = fs.get_file_info(base)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == FileType.File else sorted(
            (f for f in fs.get_file_info(FileSelector(base)) if f.type == FileType.File and f.base_name[0] not in "._"),
            key=lambda f: f.base_name)
        return cls(path, [(f.path, f.size) for f in found])

    def read(self, at: int, size: int) -> bytes:
        fs, _ = filesystem(self.path.rstrip("/"))
        at, end, out = max(at, 0), min(at + size, self.size), []
        i = int(np.searchsorted(self.starts, at, "right")) - 1
        while at < end:
            stop = min(end, int(self.starts[i + 1]))
            if stop > at:
                with fs.open_input_file(self.files[i][0]) as f:
                    out.append(f.read_at(stop - at, at - int(self.starts[i])))
            at, i = stop, i + 1
        return b"".join(out)


def _marks(parts: Parts, at: int, size: int) -> tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a block after some bytes before it, the number of those, and
    the places in the block (from 0) of quotes that open or close a string, of
    brackets, and the brackets' steps of depth."""
    look = min(LOOK, at)
    while True:
        data = parts.read(at - look, look + size)
        if look == at or data[:look].strip(b"\\"):
            break
        look = min(2 * look, at)  # nothing but backslashes: whether the next byte is escaped lies further back
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    if len(quotes) and b"\\" in data:
        place = np.where(b != 92, np.arange(len(b), dtype=np.int64), -1)
        before = np.concatenate(([-1], np.maximum.accumulate(place)))[quotes]
        quotes = quotes[(quotes - before - 1) % 2 == 0]
    quotes = quotes[quotes >= look] - look
    body = b[look:]
    found = np.flatnonzero((body == 91) | (body == 123) | (body == 93) | (body == 125))
    steps = np.where((body[found] == 91) | (body[found] == 123), 1, -1)
    return data, look, quotes, found, steps


def _outside(quotes: np.ndarray, places: np.ndarray, inside: bool) -> np.ndarray:
    """Which places lie outside strings."""
    return (np.searchsorted(quotes, places) + inside) % 2 == 0


def _summary(parts: Parts, at: int, size: int) -> tuple[int, int, int]:
    _, _, quotes, found, steps = _marks(parts, at, size)
    out = _outside(quotes, found, False)
    return len(quotes) % 2, int(steps[out].sum()), int(steps[~out].sum())


def _segments(parts: Parts, at: int, size: int, inside: bool, depth: int) -> Iterator[dict]:
    """A block's stretches, cut where a wanted key's value begins: samples
    that begin in it while the array lasts, and where array and parent end."""
    data, look, quotes, found, steps = _marks(parts, at, size)
    keep = _outside(quotes, found, inside)
    found, steps = found[keep], steps[keep]
    after = depth + np.cumsum(steps)
    cuts = [(0, None)]
    for m in re.finditer(rb'(?<!\\)"(\w+)"\s*:\s*[\[{]', data):
        name, v = m[1].decode(), m.end() - 1 - look
        i = int(np.searchsorted(found, v))
        if i < len(found) and found[i] == v and name in (PARENT, *ARRAYS):
            if after[i] == (2 if name == PARENT else 3) and data[m.end() - 1] == (123 if name == PARENT else 91):
                cuts.append((v + 1, name))
    for (start, name), (stop, _) in zip(cuts, [*cuts[1:], (len(data) - look, None)]):
        part = (found >= start) & (found < stop)
        p, s, a = found[part], steps[part], after[part]
        ends = p[(s < 0) & (a == 2)]
        last = p[(s < 0) & (a == 1)]
        opens = p[(s > 0) & (a == 4)]
        first = int(ends[0]) if len(ends) else stop
        yield {"at": at + start, "name": name, "inside": bool(inside and not start), "depth": depth if not start else
               (2 if name == PARENT else 3), "samples": int((opens < first).sum()),
               "array_end": at + first if len(ends) else None, "parent_end": at + int(last[0]) if len(last) else None}


def _lists(parts: Parts, at: int, inside: bool, depth: int, skip: int, count: int, block: int) -> list:
    """``count`` lists of an array after the first ``skip`` that begin at or after ``at``."""
    left = skip + count + (depth >= 4)  # lists still to end; one that is open at ``at`` ends first
    pieces, begun = [], False
    while left:
        data, look, quotes, found, steps = _marks(parts, at, block)
        if len(data) == look:
            raise ValueError("the document ends inside an array")
        keep = _outside(quotes, found, inside)
        found, steps = found[keep], steps[keep]
        after = depth + np.cumsum(steps)
        opens, ends = found[(steps > 0) & (after == 4)], found[(steps < 0) & (after == 3)]
        start = 0
        if not begun:
            begun = skip < len(opens)
            start = int(opens[skip]) if begun else None
            skip -= len(opens)
        stop = int(ends[left - 1]) + 1 if len(ends) >= left else len(data) - look
        if begun:
            pieces.append(data[look + start:look + stop])
        left -= min(left, len(ends))
        inside, depth = bool((len(quotes) + inside) % 2), int(after[-1]) if len(after) else depth
        at += len(data) - look
    out = json.loads(b"[" + b"".join(pieces) + b"]")
    if len(out) != count:
        raise ValueError("a sample of the document is not a list")
    return out


def _flat(values: list, kind) -> list:
    return [v for x in values for v in (_flat(x, kind) if isinstance(x, list) else [None if x is None else kind(x)])]


@dataclass
class Samples(InputPartition):
    """Samples ``first`` to ``first + count - 1`` and where to look for them."""

    first: int
    count: int
    seeks: list


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        self.parts = Parts(options["path"], [tuple(f) for f in json.loads(options["files"])])
        self.ranges, self.block = json.loads(options["ranges"]), int(options["block"])

    def partitions(self) -> list[Samples]:
        return [Samples(*r) for r in self.ranges]

    def read(self, partition: Samples | None):
        import pyarrow as pa

        if partition is None:  # a document without samples
            return
        scores, truths = (_lists(self.parts, *seek, partition.count, self.block) for seek in partition.seeks)
        ids = range(partition.first, partition.first + partition.count)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([_flat(v, float) for v in scores], pa.list_(pa.float64())),
            pa.array([_flat(v, int) for v in truths], pa.list_(pa.int32()))], ["sample_id", *ARRAYS])


class ResultsDocument(DataSource):
    """Options, all set by :func:`read_results_document`: ``path``, ``files``, ``ranges``, ``block``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "sample_id long, predictions array<double>, true_labels array<int>"

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


def _over_blocks(spark: SparkSession, rows: list[tuple], schema: str, function, out: str) -> list:
    """Collected, ordered rows of ``function(row)`` for each block."""
    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in out.split(", ")]
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = [r if isinstance(r, tuple) else tuple(r.values()) for r in function(*row)]
                yield pd.DataFrame(found, columns=names).astype(object)

    tasks = max(1, min(len(rows), 8 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, schema).repartition(tasks, "at").mapInPandas(run, out).orderBy("at").collect()


def sample_ranges(spark: SparkSession, parts: Parts, block: int = BLOCK) -> list[tuple]:
    """(first sample, samples, one seek for each array) for each block of
    ``predictions``; a seek is (place, inside a string, depth, samples to skip)."""
    blocks = [(at, min(block, parts.size - at)) for at in range(0, parts.size, block)]
    if not blocks:
        raise ValueError("the document is empty")
    sums = _over_blocks(spark, blocks, "at long, size long",
                        lambda at, size: [(at, *_summary(parts, int(at), int(size)))],
                        "at long, odd int, outer int, inner int")
    states, inside, depth = [], False, 0
    for (at, size), r in zip(blocks, sums):
        states.append((at, size, inside, depth))
        depth += r["inner"] if inside else r["outer"]
        inside ^= bool(r["odd"])
    if inside or depth:
        raise ValueError("the document is cut off or is not JSON")
    segments = _over_blocks(
        spark, states, "at long, size long, inside boolean, depth int",
        lambda at, size, inside, depth: _segments(parts, int(at), int(size), bool(inside), int(depth)),
        "at long, name string, inside boolean, depth int, samples int, array_end long, parent_end long")
    found: dict[str, list] = {}
    held, open_array, total = False, None, 0
    for s in segments:
        if s["name"] == PARENT:
            held = True
        elif s["name"] and held:
            open_array, total = s["name"], 0
            found[open_array] = []  # of a repeated key the last one counts, as JSON readers have it
        if open_array:
            found[open_array].append((total, s["samples"], (s["at"], s["inside"], s["depth"])))
            total += s["samples"]
            if s["array_end"] is not None:
                open_array = None
        if s["parent_end"] is not None:
            held = False
    missing = [a for a in ARRAYS if a not in found]
    if missing:
        raise ValueError(f"the document has no {PARENT}.{missing[0]}")
    scores, truths = (found[a] for a in ARRAYS)
    sizes = [sum(n for _, n, _ in f) for f in (scores, truths)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"{sizes[0]} predictions but {sizes[1]} true labels")
    firsts = [f for f, _, _ in truths]
    out = []
    for first, n, place in scores:
        if n:
            at = int(np.searchsorted(firsts, first, "right")) - 1
            out.append((first, n, [(*place, 0), (*truths[at][2], first - firsts[at])]))
    return out


def read_results_document(spark: SparkSession, path: str, block: int = BLOCK, nested: bool = False) -> DataFrame:
    """A-9: the long ``pred`` table ``(sample_id, label_id, truth, score)`` of a
    results document; ``sample_id`` is the sample's place in the document, from 0.
    ``nested`` gives one row per sample instead (``predictions``, ``true_labels``,
    lists in lists flattened).  A document that is cut off, lacks an array or
    has arrays of unequal length is an error; empty arrays give no rows."""
    parts = Parts.find(path)
    ranges = sample_ranges(spark, parts, block)
    spark.dataSource.register(ResultsDocument)
    df = (spark.read.format(NAME).option("path", path).option("files", json.dumps(parts.files))
          .option("ranges", json.dumps(ranges)).option("block", block).load())
    return df if nested else flatten_results(df)


def write_results_document(metrics: DataFrame, pred: DataFrame, path: str, sample: str = "sample_id",
                           label_id: str = "label_id", score: str = "score", truth: str = "truth",
                           mode: str = "overwrite") -> None:
    """A-8: metrics (one row) and the detail as one JSON document in part
    files, samples by id and labels by number.  A range sort puts the parts in
    order, so no task holds more than its own range."""
    held = pred.groupBy(sample).agg(F.array_sort(F.collect_list(
        F.struct(F.col(label_id).alias("i"), F.col(score).alias("s"), F.col(truth).alias("t")))).alias("_a"))
    held = materialize(held.select(F.col(sample).alias("_id"), *[
        F.to_json(F.col(f"_a.{f}")).alias(f"_{f}") for f in "st"]))
    first = F.broadcast(held.agg(F.min("_id").alias("_first")))
    comma = F.when(F.col("_id") == F.col("_first"), "").otherwise(",")
    lists = held.crossJoin(first).select("_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("_k"), F.concat(comma, c).alias("value")) for k, c in ((1, "_s"), (3, "_t"))])))
    between = held.sparkSession.createDataFrame(
        [(None, 2, f'], "{ARRAYS[1]}": ['), (None, 4, "]}}")], f"_id {held.schema['_id'].dataType.simpleString()}, _k int, value string")
    head = metrics.limit(1).select(F.lit(None).alias("_id"), F.lit(0).alias("_k"), F.concat(
        F.lit('{"metrics": '), F.to_json(F.struct("*")), F.lit(f', "{PARENT}": {{"{ARRAYS[0]}": [')).alias("value"))
    lists.unionByName(between).unionByName(head).orderBy("_k", "_id").select("value").write.mode(mode).text(path)
