"""The copula's columns of many values: in order by parts, none of whose rows is shuffled more than it must be."""

from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeframe.functions.exprs import hash_normal, hash_uniform
from lakeframe.operators import synth


@pytest.fixture(scope="module")
def rows(spark):
    """Most rows of hot share a value, most of word are null, y is of single values, level of three."""
    z = hash_normal("id", 1, "z")
    df = spark.range(4000).withColumn("z", z)
    return df.select(
        F.when(F.col("z") > -0.5, 0.25).otherwise(F.col("z")).alias("hot"), F.when(hash_uniform("id", 1, "hole") > 0.7, F.concat(F.lit("w"), F.floor(F.col("z") * 50).cast("string"))).alias("word"),
        (F.col("z") * 2 + hash_normal("id", 1, "e")).alias("y"), F.when(F.col("z") < -0.5, "a").when(F.col("z") < 1, "b").alias("level"),
    ).cache()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), "Generate" in plan


def test_quantiles_are_those_of_the_standard_library():
    p = np.concatenate([np.linspace(0.001, 0.999, 999), [1e-300, 1e-20, 1e-9, 1 - 1e-9, 0.075, 0.925]])
    wanted = np.array([NormalDist().inv_cdf(x) for x in p])
    assert np.allclose(synth._quantile(p), wanted, rtol=1e-14, atol=1e-15)
    assert synth._quantile(np.array([0.0, 1.0])).tolist() == [-np.inf, np.inf]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_values_in_order_however_rows_are_dealt(spark, rows, monkeypatch, batch):
    """Values that go on over parts and batches are one, with all their rows; sums beside them are those of their rows."""
    monkeypatch.setattr(synth, "SMALL", 20)
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": batch, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        fitted = synth.fit_copula(rows, rows.columns)
        assert set(fitted.few) == {3}
        for k, c in enumerate(rows.columns[:3]):
            wanted = Counter(r[0] for r in rows.select(c).collect())
            assert fitted.distinct[k] == len(wanted) and fitted.many[k].runs.select("p").distinct().count() > 1
            order = sorted(wanted, key=lambda v: (v is not None, v or 0))
            upto = np.cumsum([wanted[v] for v in order])
            ends = dict(zip(order, zip(upto - [wanted[v] for v in order], upto)))
            found = fitted.many[k].means().collect()
            assert {r.v: r.m for r in found} == wanted and len(found) == len(wanted)
            dealt = {(r.v, r.place, r.m) for r in fitted.many[k].dealt(8).collect()}
            assert dealt == {(v, low, high - low) for v, (low, high) in ends.items()}
        assert fitted.sample(3000).count() == 3000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_draws_are_not_shuffled_for_columns_of_few_values(rows, monkeypatch):
    assert exchanges(synth.fit_copula(rows, ["level"]).sample(1000)) == (0, False)
    monkeypatch.setattr(synth, "SMALL", 20)
    assert exchanges(synth.fit_copula(rows, ["y", "level"]).sample(1000)) == (2, False)  # draws, and values once
