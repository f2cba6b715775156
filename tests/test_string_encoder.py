import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lakeframe.operators import learn

STEMS = ("brass", "copper", "nickel", "steel", "tin")


@pytest.fixture(scope="module")
def names(spark):
    rows = [(f"{STEMS[i % 5]}-{i // 5:02d}",) for i in range(60)] + [("steel-00",)] * 200 + [(None,), ("",)]
    return spark.createDataFrame(rows, "name string")


@pytest.fixture(scope="module")
def fitted(names):
    return Pipeline(stages=learn.string_encoder("name", "v", 256, 8)).fit(names)


def places(fitted, df):
    return {r.name: np.array(r.v) for r in fitted.transform(df).select("name", vector_to_array("v").alias("v")).collect()}


def test_near_spellings_are_near(spark, names, fitted, tmp_path):
    found = places(fitted, names)
    assert np.allclose(found[None], found[""])

    def apart(a, b):
        return np.linalg.norm(found[a] - found[b])

    for s in STEMS:
        strangers = [apart(f"{s}-03", f"{t}-08") for t in STEMS if t != s]
        assert apart(f"{s}-03", f"{s}-07") < min(strangers)
    # unseen spellings, other case, a stored pipeline
    other = spark.createDataFrame([("STEEL-03",), ("steeel-03",)], "name string")
    fitted.write().save(str(tmp_path / "m"))
    new = places(PipelineModel.load(str(tmp_path / "m")), other)
    assert np.allclose(new["STEEL-03"], found["steel-03"])
    assert np.linalg.norm(new["steeel-03"] - found["steel-03"]) < min(np.linalg.norm(new["steeel-03"] - found[f"{t}-08"]) for t in STEMS[:3])


def test_components_equal_numpy(names, fitted):
    x = np.array([r[0] for r in fitted.transform(names).select(vector_to_array("v_unit")).collect()])
    sizes = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(fitted.stages[-1].explainedVariance.toArray(), sizes[:8] / sizes.sum(), atol=1e-9)


def test_levels_are_counted_exactly(spark):
    """40 levels are one-hot, 41 are encoded, nulls being none; so many levels lie within a sketch's error."""
    df = spark.range(4100).select(*[F.when(F.col("id") % 7 > 0, F.concat(F.lit("l"), F.col("id") % n)).alias(f"c{n}") for n in (40, 41)], F.lit(1.0).alias("x"))
    made = learn.feature_pipeline(df, ["c40", "c41"], ["x"], components=5, grams=64).fit(df).transform(df)
    assert made.select(F.size(vector_to_array("features")).alias("n")).distinct().collect() == [(1 + 40 + 5,)]
