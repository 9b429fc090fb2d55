"""L-2 as a table function: one source row to many samples, from SQL.

``expand_choices(TABLE(t) PARTITION BY (id), 'choices', 'answer')`` gives a row for
each entry of an array column.  Its result type follows from the table it is called
with: the element type of the array and all other columns of the table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

NAME = "expand_choices"


class ExpandChoices:
    """Rows with ``label_id`` (from 1 over all rows of a partition, in order),
    ``label`` (the entry), ``truth`` (1 where the answer column holds the entry's
    position, from 0) and the other columns.  A null or empty array gives no rows;
    a null answer makes every truth 0."""

    def __init__(self):
        self.given = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, choices: AnalyzeArgument, answer: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be TABLE(...)")
        for a in (choices, answer):
            if not a.isConstantExpression or a.value not in rows.dataType.fieldNames():
                raise ValueError("choices and answer must be names of the table's columns")
        array = rows.dataType[choices.value].dataType
        if not isinstance(array, T.ArrayType):
            raise ValueError(f"{choices.value} must be an array, not {array.simpleString()}")
        rest = [f for f in rows.dataType.fields if f.name not in (choices.value, answer.value)]
        clash = {f.name for f in rest} & {"label_id", "label", "truth"}
        if clash:
            raise ValueError(f"the table has columns named {sorted(clash)}")
        return AnalyzeResult(schema=T.StructType([
            *rest, T.StructField("label_id", T.IntegerType()), T.StructField("label", array.elementType),
            T.StructField("truth", T.IntegerType())]))

    def eval(self, rows, choices, answer):
        rest = [v for c, v in zip(rows.__fields__, rows) if c not in (choices, answer)]
        for i, entry in enumerate(rows[choices] or []):
            self.given += 1
            yield *rest, self.given, entry, int(rows[answer] == i)


def register_expander(spark: SparkSession, name: str = NAME) -> str:
    """Make the function known to a session's SQL; returns its name."""
    spark.udtf.register(name, udtf(ExpandChoices))
    return name
