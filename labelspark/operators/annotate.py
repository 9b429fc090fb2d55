"""Annotation job (J-13, F-13 .. F-15, L-6).

The text generator (an LLM, a rules engine ...) is a user callable applied
through ``mapInPandas`` on Arrow batches: it is loaded once per task, sees a
pandas Series of prompts and returns a Series of raw JSON strings.  Failed
calls are retried per row up to ``retries`` times; rows that still fail are
dropped, as in the reference.  Parsing and strict validation of the returned
JSON run JVM-side (:func:`parse_generated`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DEFAULT_PROMPT_TEMPLATE, prompt, py_strip
from .placement import once_per_worker
from .prefix import materialize
from .sampling import sample_exact

Generator = Callable[[pd.Series], pd.Series]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _string_array_ok(v: Column, path: str) -> Column:
    t = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return t.isin("ARRAY<STRING>", "ARRAY<VOID>")


def parse_generated(raw, keep_invalid: bool = False) -> Column:
    """F-13: JSON -> struct<sentence, labels[], not_labels[]> with strict
    types: all three keys present, sentence a string, both lists arrays of
    strings (an empty array is fine); extra keys ignored; anything else is
    NULL (malformed JSON included)."""
    v = F.try_parse_json(_c(raw))
    ok = (v.isNotNull()
          & (F.schema_of_variant(F.variant_get(v, "$.sentence", "variant")) == "STRING")
          & _string_array_ok(v, "$.labels") & _string_array_ok(v, "$.not_labels"))
    val = F.struct(F.variant_get(v, "$.sentence", "string").alias("sentence"),
                   F.variant_get(v, "$.labels", "array<string>").alias("labels"),
                   F.variant_get(v, "$.not_labels", "array<string>").alias("not_labels"))
    return F.when(F.coalesce(ok, F.lit(False)), val)


def conformance_flags(labels="labels", not_labels="not_labels", lo: int = 5,
                      hi: int = 15) -> Column:
    """F-14: the generator contract (lo..hi labels and negatives, non-empty
    strings, no duplicates), as a data-quality struct."""
    def ok(a):
        a = _c(a)
        return ((F.size(a) >= lo) & (F.size(a) <= hi)
                & F.forall(a, lambda x: F.length(py_strip(x)) > 0)
                & (F.size(F.array_distinct(a)) == F.size(a)))
    return F.struct(ok(labels).alias("labels_ok"), ok(not_labels).alias("not_labels_ok"),
                    (ok(labels) & ok(not_labels)).alias("conforms"))


def generate(df: DataFrame, generator: Generator | None = None, prompt_col: str = "prompt",
             out: str = "raw", retries: int = 3,
             factory: Callable[[], Generator] | None = None, model_name: str | None = None,
             profile=None) -> DataFrame:
    """L-6: apply the user's generator to Arrow batches of prompts; each row is
    retried up to ``retries`` times when the call raises or returns None.
    Pass ``factory`` instead of ``generator`` to build the generator (load a
    model, open a client) once per task, or with ``model_name`` once per worker
    process (:mod:`.placement`); ``profile``, a ``ResourceProfile``, is what the
    executors of this stage must have."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType())])
    if (generator is None) == (factory is None):
        raise ValueError("pass exactly one of generator / factory")

    make = once_per_worker(model_name, factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = generator if generator is not None else make()
        for b in batches:
            res = pd.Series([None] * len(b), index=b.index, dtype=object)
            todo = b.index
            for _ in range(max(1, retries)):
                if len(todo) == 0:
                    break
                try:
                    got = gen(b.loc[todo, prompt_col])
                    got = pd.Series(got, index=todo)
                except Exception:  # noqa: BLE001  (user code: retry)
                    got = pd.Series([None] * len(todo), index=todo, dtype=object)
                res.loc[todo] = got
                todo = res.index[res.isna()]
            yield b.assign(**{out: res})

    return df.mapInPandas(run, schema, profile=profile)


def annotate(df: DataFrame, generator: Generator | None = None, text: str = "text", id_col: str = "doc_id",
             min_length: int = 100, template: str = DEFAULT_PROMPT_TEMPLATE, retries: int = 3,
             factory: Callable[[], Generator] | None = None, sample: int | None = None, seed: int = 42,
             path: str | None = None, batch_size: int = 50, start_index: int = 0) -> DataFrame:
    """J-13: sample (H-5, if asked for) -> length filter (B-10) -> prompt (F-15)
    -> generator with retries -> strict parse (F-13) -> failures skipped.

    With ``path`` the records are also written there in numbered batches (A-7)
    and the result is read back from them, so the generator runs once."""
    d = df if sample is None else sample_exact(df, sample, id_col, seed)
    d = d.filter(F.length(_c(text)) >= min_length).select(
        id_col, text, prompt(_c(text), template).alias("prompt"))
    g = generate(d, generator, "prompt", "raw", retries, factory)
    p = g.select(id_col, parse_generated("raw").alias("g")).filter(F.col("g").isNotNull())
    out = p.select(id_col, "g.sentence", "g.labels", "g.not_labels")
    if path is None:
        return out
    from ..sources.sinks import write_batches

    # the batches are numbered from a sample and two passes: write once first
    write_batches(materialize(out), path, id_col, batch_size, start_index)
    return df.sparkSession.read.schema(out.schema).json(path)


def stub_generator(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a text generator (tests, smoke runs): the
    'sentence' is the text, labels are its words of more than twelve letters,
    negatives those of one; every prompt whose text length is a multiple of 7
    gets malformed output."""
    import json

    def one(p: str) -> str:
        body = p.split("Text:\n", 1)[-1]
        if len(body) % 7 == 0:
            return "{not json"
        words = body.split()
        return json.dumps({"sentence": body, "labels": [w for w in words if len(w) > 12],
                           "not_labels": [w for w in words if len(w) == 1]})
    return prompts.map(one)
