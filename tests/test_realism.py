import random

import pytest
from pyspark.sql import functions as F

from lakeframe.operators.latent import Driver, Interaction, LatentModel
from lakeframe.operators.realism import realism_report
from lakeframe.spec import Feature, Problem

MODEL = LatentModel(5.0, (Driver("x", 2.0), Driver("z", 1.0, "square"), Interaction("x", "z", 0.5)))
PROBLEM = Problem((Feature("x", "numeric"), Feature("z", "numeric"), Feature("filler", "numeric", nullable=True)), Feature("t", "numeric"))


@pytest.fixture
def frame(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        x, z, hidden = rng.uniform(-2, 2), rng.uniform(-1, 1), rng.gauss(0, 1)
        noise = rng.gauss(0, 0.5 if z < 0 else 1.5)
        rows.append((x, z, None if i % 4 == 0 else 1.0, hidden, 5 + 2 * x + z * z + 0.5 * x * z + 3 * hidden + noise))
    return spark.createDataFrame(rows, "x double, z double, filler double, hidden double, t double")


def test_everything_is_measured(frame):
    r = realism_report(frame, PROBLEM, MODEL, {"route": 3 * F.col("hidden")}, "z", 5 + 2 * F.col("x")).first()
    assert (r.n, r.missing, r.driven, r.undriven, r.turning, r.n_interactions, r.confounders) == (4000, "filler=0.250000", "x,z", "filler", "z", 1, "route")
    assert abs(r.confounder_variance - 9) < 0.6 and abs(r.noise_variance - 1.25) < 0.15
    whole = r.signal_variance + r.confounder_variance + r.noise_variance
    assert abs(r.confounder_share - r.confounder_variance / whole) < 1e-9 and abs(r.ceiling - r.signal_variance / whole) < 1e-9
    assert abs(r.oracle_r2 - r.ceiling) < 0.05 and 0.8 < r.headroom <= 1
    without = realism_report(frame, PROBLEM, MODEL, None, "z").first()  # a hidden cause that is not named is noise
    assert without.confounder_share == 0 and abs(without.noise_variance - 10.25) < 0.7 and without.headroom is None
    quiet = realism_report(frame.withColumn("t", F.col("t") - 3 * F.col("hidden")), PROBLEM, MODEL, None, "z").first()
    assert 2.5 < quiet.heteroscedasticity < 3.5


def test_what_cannot_be_had_is_null(frame):
    few = realism_report(frame.limit(59), PROBLEM, MODEL, None, "filler").first()
    assert few.oracle_r2 is None and few.heteroscedasticity is None and few.n == 59
    empty = realism_report(frame.limit(0), PROBLEM, MODEL, None, "z").first()
    assert (empty.n, empty.missing, empty.signal_variance, empty.heteroscedasticity) == (0, "", None, None)
    plain = realism_report(frame, PROBLEM, None)
    assert plain.columns == ["n", "missing"]


def test_balance_of_classes(frame):
    problem = Problem((Feature("x", "numeric"),), Feature("c", "categorical", ("a", "b")))
    df = frame.withColumn("c", F.when(F.monotonically_increasing_id() % 4 == 0, "a").otherwise("b")).coalesce(1)
    r = realism_report(df, problem, None).first()
    total = sum(int(p.split("=")[1]) for p in r.class_balance.split(","))
    assert total == 4000 and [p.split("=")[0] for p in r.class_balance.split(",")] == ["a", "b"]
    assert abs(r.majority_share - 0.75) < 0.01
