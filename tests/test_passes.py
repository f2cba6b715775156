"""What reads a frame many times computes it once."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lakeframe.operators import learn, noise, stress

N = 1200


def _nested(df):
    stages = [VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y", solver="normal")]
    return learn.nested_cv(df, {"x": lambda: Pipeline(stages=stages)}, "y")


@pytest.mark.parametrize(
    "read",
    [
        lambda df: learn.learnability(df, ["g"], ["x"], "y", "key", max_iter=2),
        lambda df: learn.learnability_classes(df, ["g"], ["x"], "g", "key"),
        lambda df: stress.stress_shift(df, "key", ["x"], ["g"], 0.5, 7),
        lambda df: noise.classification_sigma(df, F.col("y"), F.col("x"), [0.5], 0.8, steps=3),
        _nested,
    ],
    ids=["learnability", "learnability_classes", "stress_shift", "classification_sigma", "nested_cv"],
)
def test_a_frame_is_computed_once(spark, read):
    computed = spark.sparkContext.accumulator(0)

    def counted(x):
        computed.add(1)
        return x

    i = F.col("id")
    seen = F.udf(counted, "double").asNondeterministic()(F.pmod(i * 7919, F.lit(1009)).cast("double"))
    df = spark.range(N).select(i.cast("string").alias("key"), seen.alias("x"), F.when(i % 3 == 0, "a").otherwise("b").alias("g"), (i % 17).cast("double").alias("y"), (i % 3).cast("int").alias("fold"))
    read(df).collect()
    assert computed.value == N
