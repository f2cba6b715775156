"""Stored models: refusals, and scores after a round trip through the store."""

import dataclasses
import sys
import tempfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lakeframe.jobs import QUERIES
from lakeframe.operators import measure, model_store

ROWS = [(i, float(i % 7), float(i % 3), "ab"[i % 2], 2.0 * (i % 7) - (i % 3) + 1) for i in range(60)]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "id long, a double, b double, flag string, y double")


@pytest.fixture
def path():
    with tempfile.TemporaryDirectory() as folder:
        yield f"{folder}/run"


def fitted(frame):
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="features"), LinearRegression(labelCol="y", solver="normal")]
    return Pipeline(stages=stages).fit(frame)


class Threshold:
    """A classifier that Spark knows nothing of."""

    classes_ = ("no", "yes")

    def predict(self, x):
        return np.where(x["a"] + x["b"] > 3, "yes", "no")

    def predict_proba(self, x):
        p = 1 / (1 + np.exp(3 - x["a"] - x["b"]))
        return np.column_stack([1 - p, p])


def test_round_trip(spark, frame, path):
    manifest = model_store.describe(frame, "r", ["a", "b"], "y", closed=("flag",), metric="r2", metric_value=1.0)
    model_store.save(spark, path, manifest, fitted(frame))
    stored = model_store.load(spark, path)
    assert stored.manifest == dataclasses.replace(manifest, kind="pipeline") and stored.manifest.known == {"flag": ("a", "b")}
    scored = model_store.score_frame(frame.withColumn("y_pred", F.lit(0)), stored)
    assert scored.columns == ["id", "a", "b", "flag", "y", "y_pred"]
    assert all(abs(r.y_pred - r.y) < 1e-9 for r in scored.collect())
    assert abs(model_store.verify(stored, frame, measure.r2) - 1) < 1e-9
    with pytest.raises(ValueError, match="recorded"):
        model_store.verify(stored, frame.withColumn("y", F.col("y") * F.rand(1)), measure.r2)
    with pytest.raises(Exception, match="exist"):
        model_store.save(spark, path, manifest, fitted(frame))
    assert model_store.score_frame(frame.limit(0), stored).count() == 0


def test_refusals(spark, frame, path):
    with pytest.raises(model_store.ModelMissing):
        model_store.load(spark, path)
    model = fitted(frame)
    model.write().save(f"{path}/model")  # a writer that died before the manifest
    with pytest.raises(model_store.ModelMissing):
        model_store.load(spark, path)
    manifest = model_store.describe(frame, "r", ["a", "b"], "y", closed=("flag",))
    model_store.save(spark, f"{path}2", manifest, model)
    stored = model_store.load(spark, f"{path}2")
    for bad in (frame.drop("b"), frame.withColumn("a", F.col("a").cast("string")), frame.select("b", "a"), frame.withColumn("prediction", F.lit(1))):
        with pytest.raises(model_store.FeatureMismatch):
            model_store.score_frame(bad, stored)
    strange = frame.withColumn("flag", F.when(F.col("id") < 3, "z").when(F.col("id") > 5, F.col("flag")))
    assert model_store.unknown_levels(stored.manifest, strange) == {"flag": 3}
    assert model_store.score_frame(strange, stored).count() == 60
    with pytest.raises(model_store.FeatureMismatch, match="flag"):
        model_store.score_frame(strange, stored, strict_levels=True)
    old = dataclasses.replace(manifest, versions={"pyspark": "0.0"})
    model_store.save(spark, f"{path}3", old, model)
    with pytest.raises(model_store.VersionDrift):
        model_store.load(spark, f"{path}3")
    assert model_store.load(spark, f"{path}3", allow_version_drift=True).pipeline is not None
    with pytest.raises(ValueError, match="levels"):
        model_store.describe(frame, "r", ["a"], "y", closed=("flag",), most=1)


def test_other_models_run_in_batches(spark, frame, path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    manifest = model_store.describe(frame, "t", ["a", "b"], "truth", ("no", "yes"))
    model_store.save(spark, path, manifest, Threshold())
    scored = model_store.score_frame(frame.repartition(3), model_store.load(spark, path)).collect()
    assert len(scored) == 60
    for r in scored:
        assert r.y_pred == ("yes" if r.a + r.b > 3 else "no") and abs(r.y_pred_proba - 1 / (1 + np.exp(3 - r.a - r.b))) < 1e-12


def test_classifier_query(spark):
    found = QUERIES["score_frame_classes"](spark, "/root/testdata/sf0.001").toPandas()
    assert set(found.y_pred) == {"good", "poor"} and found.y_pred_proba.between(0, 1).all()
    assert ((found.y_pred_proba > 0.5) == (found.y_pred == "poor")).mean() > 0.999
