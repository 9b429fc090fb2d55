"""Random strings with every kind of whitespace: the Spark string operators
must agree with Python's own str.strip / str.split semantics."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelspark.functions.text import ensure_string, py_strip
from labelspark.operators import normalize as N
from labelspark.operators.pack import whitespace_tokens

ALPHABET = "ab_ \t\n\x0b\x0c\r\x1c\x1f\x85\xa0      　​"
TEXT = st.text(alphabet=ALPHABET, max_size=12)
SETTINGS = settings(max_examples=20, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=25))
def test_strip_split_and_ensure_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string")
    rows = df.select("i", py_strip("s").alias("st"), ensure_string(F.col("s")).alias("en"),
                     whitespace_tokens("s").alias("tok"), whitespace_tokens("s", 2).alias("tok2")
                     ).collect()
    for r in rows:
        v = values[r.i]
        assert r.st == v.strip()
        assert r.en == v.replace("_", " ").strip()
        assert r.tok == v.split()
        assert r.tok2 == v.split()[:2]


@SETTINGS
@given(st.lists(st.tuples(st.lists(TEXT, max_size=4), st.lists(TEXT, max_size=4)),
                min_size=1, max_size=10), st.integers(0, 2))
def test_build_labels_matches_python(spark, rows, min_len):
    df = spark.createDataFrame([(i, "t", p, n) for i, (p, n) in enumerate(rows)],
                               "sample_id long, text string, pos array<string>, neg array<string>")
    got = {r.sample_id: (r.ltext, r.lint)
           for r in N.build_labels(df, "sample_id", "text", "pos", "neg", min_len).collect()}
    for i, (p, n) in enumerate(rows):
        pos = [x.strip() for x in p if len(x.strip()) > min_len]
        neg = [x.strip() for x in n if len(x.strip()) > min_len]
        assert got[i] == (pos + neg, [1] * len(pos) + [0] * len(neg))
