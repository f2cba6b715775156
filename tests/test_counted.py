"""What is learned from counted rows is what the rows say, and a verdict reads its frame once."""

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from lakeframe.functions.exprs import hash_normal
from lakeframe.operators import contract, learn
from lakeframe.spec import SETTINGS, Feature, Problem

N = 4000


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    df = spark.range(N).select(i.cast("string").alias("key"), F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").alias("g"), (i * 7919 % 11).cast("double").alias("x"), F.when(i % 5 > 0, (i % 5).cast("double")).alias("z"))
    effect = F.col("x") * 2 + F.coalesce("z", F.lit(0.0)) + F.when(F.col("g") == "a", 4.0).otherwise(0.0)
    return df.withColumn("y", effect + 3 * hash_normal("key", 1, "e")).cache()


def test_trees_on_counted_rows_are_those_on_rows(rows, monkeypatch):
    seen = []

    class Counting(GBTRegressor):
        def fit(self, df):
            seen.append(df.count())
            return super().fit(df)

    monkeypatch.setattr(learn, "GBTRegressor", Counting)
    found = learn.learnability(rows, ["g"], ["x", "z"], "y", "key", max_iter=4).first()
    assert seen and seen[0] <= 3 * 11 * 5 < N / 10  # a row for each combination of features
    sided = learn._sided(rows, ["g"], ["x", "z"], "y", "key", SETTINGS)
    fitted = learn.feature_pipeline(sided, ["g"], ["x", "z"]).fit(sided.where("not _test"))
    model = GBTRegressor(labelCol="y", featuresCol="features", maxIter=4, maxDepth=4, seed=SETTINGS.random_seed).fit(fitted.transform(sided.where("not _test")))
    wanted = RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.transform(fitted.transform(sided.where("_test"))))
    assert found.n_rows == N and abs(found.r2 - wanted) < 1e-9


def test_spellings_are_fitted_on_every_row(rows):
    """50 names, beyond what is one-hot: their encoder sees each row as often as it was counted."""
    named = rows.withColumn("name", F.concat(F.lit("n"), (F.col("key").cast("int") % 50).cast("string")))
    counted = learn._counted(named, ["name"], "y", "key", SETTINGS)
    wanted = {(r.name, r._test): r._n for r in counted.collect()}
    for at_once in (7, 10_000):
        assert {(r.name, r._test): r["count"] for r in learn._each(counted, at_once).groupBy("name", "_test").count().collect()} == wanted
    assert learn.learnability(named, ["name"], ["x"], "y", "key", max_iter=1).first().n_rows == N


PROBLEM = Problem(
    (
        Feature("g", "categorical", ("a",)), Feature("x", "numeric", maximum=8), Feature("z", "numeric", nullable=True), Feature("text", "numeric"),
        Feature("flat", "numeric"), Feature("zero", "numeric"), Feature("empty", "boolean", nullable=True), Feature("when", "datetime"), Feature("id_", "categorical", ("0",)),
    ),
    Feature("y", "numeric"),
)


def test_a_verdict_reads_its_frame_once(spark, rows):
    computed = spark.sparkContext.accumulator(0)

    def counted(x):
        computed.add(1)
        return x

    odd = {"text": F.when(F.col("x") > 3, F.col("x").cast("string")).otherwise("no"), "flat": F.lit(float("nan")), "zero": F.when(F.col("x") > 3, 0.0).otherwise(-0.0), "empty": F.lit(None).cast("boolean"), "when": F.timestamp_seconds(F.col("key").cast("long")), "id_": F.col("key")}
    df = rows.withColumns(odd)
    verdict = contract.contract_verdict(df.withColumn("x", F.udf(counted, "double").asNondeterministic()("x")), PROBLEM, "key", None, None).first()
    assert computed.value == N
    audit = {r["column"]: r.issues for r in contract.column_audit(df, PROBLEM).collect() if r.issues}
    assert audit["flat"] == audit["zero"] == "constant" and "more values than levels" in audit["g"] and "id-like" in audit["id_"]
    assert verdict.n_violations == contract.violations(df, PROBLEM, "key").count() > N
    assert verdict.warnings == " | ".join(["leakage was not measured", *sorted(f"{c}: {issues}" for c, issues in audit.items())])
