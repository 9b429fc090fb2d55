"""Sources (A-1 .. A-6, A-9): readers that end in canonical samples or
metric inputs.  All are lazy DataFrame readers with explicit schemas where
the format allows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import build_labels, choose_text_column, drop_empty, shuffle_labels

SAMPLE_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("ltext", T.ArrayType(T.StringType())),
    T.StructField("lint", T.ArrayType(T.IntegerType()))])

TRIPLET_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("sentence", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("not_labels", T.ArrayType(T.StringType()))])


def read_any(spark: SparkSession, path: str, fmt: str = "parquet",
             schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.format(fmt).load(path)


def load_triplets(spark: SparkSession, path: str, fmt: str = "json", text_column: str | None = None,
                  positive_column: str = "labels", negative_column: str = "not_labels",
                  min_label_length: int = 0, shuffle: bool = False, seed: int = 42,
                  extra: DataFrame | None = None, schema: T.StructType | None = None,
                  ) -> DataFrame:
    """A-1 / A-2: read a triplet corpus -> canonical samples.  ``extra`` rows
    (e.g. a local corpus appended to the train split) are unioned first;
    ``shuffle`` orders labels by the seeded hash (B-8).  The corpus order is
    the row id; a global seeded order is :func:`operators.sampling.shuffled_positions`."""
    df = read_any(spark, path, fmt, schema)
    if extra is not None:
        df = df.unionByName(extra, allowMissingColumns=True)
    tcol = choose_text_column(df, text_column)
    s = drop_empty(build_labels(df, "sample_id", tcol, positive_column, negative_column,
                                min_label_length))
    return shuffle_labels(s, seed) if shuffle else s


def load_validated(spark: SparkSession, reader: Callable[[], DataFrame],
                   mapper: Callable[[DataFrame], DataFrame] | None = None,
                   on_error: str = "raise") -> DataFrame:
    """A-3: read -> map -> canonical columns -> validate.  The reference logs
    and returns an empty dataset on any error; here that is opt-in
    (``on_error='empty'``), raising is the default."""
    from ..operators.normalize import validate
    try:
        df = reader()
        if mapper is not None:
            df = mapper(df)
        df = df.select("sample_id", "text", "ltext", "lint")
        df.schema  # noqa: B018  (forces analysis so bad columns fail here)
        return validate(df)
    except Exception:
        if on_error == "empty":
            return spark.createDataFrame([], SAMPLE_SCHEMA)
        raise


def expand(df: DataFrame, function: Callable, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """L-2: a hook that maps source rows to any number of samples.  ``function``
    gets a pandas frame of source rows and returns one of sample rows with the
    columns of ``schema``; it runs in the tasks on Arrow batches."""
    names = schema.fieldNames()
    return df.mapInPandas(lambda batches: (function(b)[names] for b in batches), schema)


class Registry:
    """A-4 / A-5: named corpora -> ``fn(spark, path) -> DataFrame`` of samples."""

    def __init__(self) -> None:
        self._fns: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {}

    def register(self, name: str, role: str = "train"):
        def deco(fn):
            self._fns[name] = (role, fn)
            return fn
        return deco

    def names(self, role: str | None = None) -> list[str]:
        return sorted(n for n, (r, _) in self._fns.items() if role is None or r == role)

    def load(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        return self._fns[name][1](spark, path)


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """A-6: JSON objects {group: [fine, ...]} -> (group, fine) rows, of any
    number.  A file is one value, so a large hierarchy is a folder of files,
    read by many tasks; a group may lie in several of them.  Nothing here is
    broadcast: joins on the rows go by their measured size."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return raw.select(F.explode(m).alias("group", "fines")).select("group", F.explode("fines").alias("fine"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A-9: read an evaluation results file (JSON lines of
    ``{sample_id, predictions[], true_labels[]}``) and flatten it to the long
    ``pred`` table ``(sample_id, label_id, truth, score)``."""
    schema = T.StructType([
        T.StructField("sample_id", T.LongType()),
        T.StructField("predictions", T.ArrayType(T.DoubleType())),
        T.StructField("true_labels", T.ArrayType(T.IntegerType()))])
    return flatten_results(spark.read.schema(schema).json(path))


def flatten_results(df: DataFrame) -> DataFrame:
    """A-9: one row per label from ``(sample_id, predictions, true_labels)``."""
    z = F.arrays_zip(F.col("predictions").alias("s"), F.col("true_labels").alias("t"))
    ex = df.filter((F.size("predictions") > 0) & (F.size("true_labels") > 0)).select(
        "sample_id", F.posexplode(z).alias("_p", "_z"))
    # E-33 / D-6: a truth without a score counts 0.0, a score without a truth is dropped
    return ex.filter(F.col("_z.t").isNotNull()).select(
        "sample_id", (F.col("_p") + 1).cast("int").alias("label_id"),
        F.col("_z.t").alias("truth"), F.coalesce(F.col("_z.s"), F.lit(0.0)).alias("score"))
