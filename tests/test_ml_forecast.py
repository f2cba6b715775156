"""Forecasts point in time: features, recursions, bands and what they may not see."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeframe.operators import forecast, ml_forecast
from lakeframe.operators.ml_forecast import Roster

START = datetime.datetime(2024, 1, 1)
DAY = datetime.timedelta(days=1)
SCHEMA = "unique_id string, ds timestamp, y double"


def values(k, n):
    rng = np.random.default_rng(k)
    return [10 + 3 * np.sin(i * 2 * np.pi / 7 + k) + 0.05 * i + rng.normal(0, 0.3) for i in range(n)]


def frame(spark, lengths, changed=()):
    rows = [(f"s{k}", START + DAY * i, 1000.0 if (k, i) in changed else float(v)) for k, n in enumerate(lengths) for i, v in enumerate(values(k, n))]
    return spark.createDataFrame(rows, SCHEMA)


def plain_features(history, ds, roster):
    parts = {"dayofweek": ds.weekday(), "week": ds.isocalendar()[1]}
    return [*(history[-k] for k in roster.lags), sum(history[-roster.window :]) / roster.window, *(parts[p] for p in ("dayofweek", "week"))]


def test_first_step_has_the_features_of_a_row(spark):
    """A buffer's features are those that lag_features gives the row that comes next."""
    series = frame(spark, [80, 90])
    roster = Roster.of(80, 7, 5, "D")
    assert roster.lags == (1, 2, 3, 7, 8, 14) and roster.window == 7 and roster.reach == 14
    state = ml_forecast.buffers(ml_forecast.numbered(series), roster.reach, 5, 0)
    found = state.select("unique_id", *[c.alias(n) for n, c in zip(roster.names, roster.of_buffer(F.col("buffer"), F.col("at") + F.expr("INTERVAL 1 DAY")))])
    following = spark.createDataFrame([(f"s{k}", START + DAY * n, 0.0) for k, n in enumerate((80, 90))], SCHEMA)
    rows = forecast.lag_features(series.unionByName(following), 7, 5).join(following.select("unique_id", "ds"), ["unique_id", "ds"])
    wanted = {r.unique_id: [float(r[n]) for n in roster.names] for r in rows.collect()}
    for r in found.collect():
        assert np.allclose([r[n] for n in roster.names], wanted[r.unique_id])


def test_ridge_equals_a_plain_recursion(spark):
    lengths = [80, 90]
    series, horizon = frame(spark, lengths), 6
    roster = Roster.of(80, 7, horizon, "D")
    x, y = [], []
    for k, n in enumerate(lengths):
        v = values(k, n)
        for i in range(roster.reach, n):
            x.append(plain_features(v[:i], START + DAY * i, roster))
            y.append(v[i])
    x, y = np.array(x), np.array(y)
    candidates = {"ridge": ml_forecast.ridge(len(y), y.std(), 2.5)}
    found = {(r.unique_id, r.step): (r.ds, r.forecast) for r in ml_forecast.global_forecasts(series, 7, horizon, candidates=candidates).collect()}
    centred = x - x.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + 2.5 * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    for k, n in enumerate(lengths):
        history = values(k, n)
        for step in range(1, horizon + 1):
            ds = START + DAY * (n + step - 1)
            p = y.mean() + weights @ (np.array(plain_features(history, ds, roster)) - x.mean(axis=0))
            history.append(p)
            assert found[f"s{k}", step][0] == ds and abs(found[f"s{k}", step][1] - p) < 1e-6


def test_stepwise_equals_linear_recursion(spark):
    series = frame(spark, [60])
    roster = Roster.of(60, 7, 4, "D")
    state = ml_forecast.buffers(ml_forecast.numbered(series), roster.reach, 4, 2)
    weights = [0.1 * (i + 1) for i in range(len(roster.names))]
    one = ml_forecast.linear_recursion(state, roster, 4, weights, 1.0)
    from pyspark.ml.functions import vector_to_array

    def model(df):
        x = vector_to_array("features")
        return df.withColumn("prediction", sum((w * x[i] for i, w in enumerate(weights)), F.lit(1.0)))

    other = ml_forecast.stepwise_recursion(state, roster, 4, model)
    key = ["unique_id", "window", "step"]
    pairs = one.join(other.withColumnsRenamed({"forecast": "f", "ds": "d"}), key).collect()
    assert len(pairs) == 8 and all(abs(r.forecast - r.f) < 1e-9 and r.ds == r.d for r in pairs)


@pytest.mark.parametrize("refit", [False, True])
def test_nothing_beyond_a_cutoff_is_seen(spark, refit):
    """A change beyond a cutoff changes no forecast made at it, or before."""
    n, horizon, windows = 80, 5, 3
    cutoffs = [n - (windows - k) * horizon for k in range(windows)]
    changed = {(k, i) for k in range(2) for i in range(cutoffs[1], n)}
    made = []
    for series in (frame(spark, [n, n]), frame(spark, [n, n], changed)):
        found = ml_forecast.backtest_forecasts(series, 7, horizon, windows, refit=refit)
        made.append({(r.model, r.unique_id, r.window, r.step): r.forecast for r in found.collect()})
    assert len(made[0]) == 6 * 2 * windows * horizon == len(made[1])
    same = [k for k in made[0] if abs(made[0][k] - made[1][k]) < 1e-9]
    assert {k for k in made[0] if k[2] < 2} <= set(same)
    assert not [k for k in same if k[0] == "naive" and k[2] == 2]


def test_bands_come_from_earlier_cutoffs(spark):
    rows = [("m", "s", w, s, START, 0.0, float(e)) for w, errors in enumerate([[1, 2, 3, 4], [9, 0, 0, 0], [5, 1, 8, 9]]) for s, e in enumerate(errors, 1)]
    forecasts = spark.createDataFrame(rows, "model string, unique_id string, window int, step int, ds timestamp, y double, forecast double")
    widths = {r.window: r.width for r in ml_forecast.conformal_widths(forecasts, 3, 0.5).collect()}
    assert widths == {1: 4.0, 2: 3.0}  # the value at or above place 0.75 * 3 of four errors, and 0.625 * 7 of eight
    found = ml_forecast.backtest(forecasts, 3, 0.5).first()
    assert found.measured == (3 + 1) / 8 and found.place == 1 and found.mape is None


def test_refusals(spark):
    with pytest.raises(ValueError, match="needed"):
        ml_forecast.global_forecasts(frame(spark, [10]), 7, 3)
    flat = spark.createDataFrame([("s", START + DAY * i, 1.0) for i in range(60)], SCHEMA)
    with pytest.raises(ValueError, match="flat"):
        ml_forecast.backtest_forecasts(flat, 7, 3, 2)
    with pytest.raises(ValueError, match="windows"):
        ml_forecast.backtest_forecasts(flat, 7, 3, 1)
    with pytest.raises(ValueError, match="frequency"):
        Roster.of(60, 7, 3, "Q")


def test_months(spark):
    """The next period of monthly series is a month on."""
    series = spark.createDataFrame([("s", datetime.datetime(2020 + i // 12, i % 12 + 1, 1), float(i % 12 + i / 40)) for i in range(60)], SCHEMA)
    found = ml_forecast.global_forecasts(series, 12, 3, "MS", {"ridge": ml_forecast.ridge(60, 3.5)}).orderBy("step").collect()
    assert [r.ds for r in found] == [datetime.datetime(2025, m, 1) for m in (1, 2, 3)] and all(abs(r.forecast - (m + 1.5)) < 1.5 for m, r in enumerate(found))
