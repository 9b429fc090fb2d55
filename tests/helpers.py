"""Build the long pred table from dense per-sample lists."""

from pyspark.sql import types as T

PRED = T.StructType([
    T.StructField("sample_id", T.LongType()), T.StructField("label_id", T.IntegerType()),
    T.StructField("truth", T.IntegerType()), T.StructField("score", T.DoubleType())])


def pred_df(spark, truths, scores, partitions=None):
    rows = [(i, j + 1, int(t), float(s))
            for i, (ts, ss) in enumerate(zip(truths, scores))
            for j, (t, s) in enumerate(zip(ts, ss))]
    df = spark.createDataFrame(rows, PRED)
    return df.repartition(partitions) if partitions else df
