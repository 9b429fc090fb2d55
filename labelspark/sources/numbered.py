"""A-7 / A-8 writer: numbered files ``batch_0001.json`` of N records each.

A Spark data source.  Every task writes its files into a folder of its own
attempt and reports them in its commit message; the driver moves the files of
the attempts that count to their names.  A task that fails and runs again
leaves no second copy, and a job that fails leaves nothing but whole files.
The path is one that all executors share, local or a URI that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .sinks import batch_numbers

NAME = "numbered_json"
ATTEMPTS = "_attempts"


def file_name(number: int) -> str:
    """At least four digits, more where the number has more."""
    return f"batch_{number:04d}.json"


def filesystem(path: str):
    """(file system, path in it) of a shared folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one attempt: (where it is, its name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class NumberedWriter(DataSourceWriter):
    def __init__(self, path: str, column: str, overwrite: bool):
        self.path, self.column, self.overwrite = path.rstrip("/"), column, overwrite

    def write(self, iterator: Iterator) -> Written:
        """Rows of a batch come one after another; one batch is held at a time."""
        fs, base = filesystem(self.path)
        folder, out = f"{base}/{ATTEMPTS}/{uuid.uuid4().hex}", Written()
        number, records = None, []

        def flush() -> None:
            if number is None:
                return
            if not out.files:
                fs.create_dir(folder, recursive=True)
            place = f"{folder}/{file_name(number)}"
            with fs.open_output_stream(place) as f:
                f.write(json.dumps(records, indent=2, ensure_ascii=False, default=str).encode())
            out.files.append((place, f"{base}/{file_name(number)}"))

        for row in iterator:
            record = row.asDict(recursive=True)
            n = record.pop(self.column)
            if n != number:
                flush()
                number, records = n, []
            records.append(record)
        flush()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.path)
        files = [f for m in messages if m for f in m.files]
        if self.overwrite:
            new = {name for _, name in files}
            for name in existing(self.path).values():
                if name not in new:
                    fs.delete_file(name)
        for place, name in files:
            fs.move(place, name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        fs, base = filesystem(self.path)
        if fs.get_file_info(f"{base}/{ATTEMPTS}").type == FileType.Directory:
            fs.delete_dir(f"{base}/{ATTEMPTS}")


class NumberedJson(DataSource):
    """Options: ``path``, and ``number``, the column with the file's number."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> NumberedWriter:
        column = self.options.get("number", "batch")
        if column not in schema.fieldNames():
            raise ValueError(f"no column {column!r} to number the files by")
        return NumberedWriter(self.options["path"], column, overwrite)


def existing(path: str) -> dict[int, str]:
    """Numbers and names of the finished files in a folder."""
    import re

    from pyarrow.fs import FileSelector

    fs, base = filesystem(path.rstrip("/"))
    found = fs.get_file_info(FileSelector(base, allow_not_found=True))
    names = ((re.fullmatch(r"batch_(\d{4,})\.json", f.base_name), f.path) for f in found)
    return {int(m[1]): p for m, p in names if m}


def write_numbered(df: DataFrame, path: str, order_col: str, batch_size: int = 50, start_index: int = 0,
                   resume: bool = False) -> None:
    """A-7: record n (1-based, along ``order_col``) goes to file
    ``(n - 1) // batch_size + start_index // batch_size + 1``; a file is a JSON
    list of at most ``batch_size`` records.  With ``resume`` files that are there
    already stay and their records are not written again; otherwise the folder
    ends up with exactly the files of this call."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(NumberedJson)
    rows = batch_numbers(df, order_col, batch_size, start_index, out="_number")
    if resume:
        done = spark.createDataFrame([(n,) for n in existing(path)], "_number long")
        rows = rows.join(done, "_number", "left_anti")
    # a file is written by one task, its records in order
    rows = rows.repartition(F.col("_number")).sortWithinPartitions("_number", order_col)
    rows.write.format(NAME).mode("append" if resume else "overwrite").option("number", "_number").save(path)


def read_numbered(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of all numbered files with the number of their file."""
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "batch_*.json").json(path)
    number = F.regexp_extract(F.input_file_name(), r"batch_(\d+)\.json$", 1).cast("long")
    return raw.withColumn("batch", number)
