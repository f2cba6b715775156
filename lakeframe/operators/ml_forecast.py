"""Global forecasts, point in time: one model over all series, recursive steps over a ring buffer, candidates measured.

A series' last values lie in an array column, the ring buffer. Every step recomputes lags, the rolling mean and the next
date's parts from it, forecasts, and puts the forecast in; all series, and all cutoffs of a backtest, take a step
together. Whatever is fitted or forecast at a cutoff comes from rows before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .forecast import DATE_PARTS, UNITS, error_metrics, rank_forecasts

_PARTS: dict[str, Callable[[Column], Column]] = {"hour": F.hour, "dayofweek": F.weekday, "week": F.weekofyear, "month": F.month, "quarter": F.quarter}


@dataclass(frozen=True)
class Roster:
    """The features that so much history supports: lags, a rolling mean and parts of the date."""

    lags: tuple[int, ...]
    window: int
    season: int
    freq: str

    @classmethod
    def of(cls, n: int, season: int, horizon: int, freq: str) -> Roster:
        """Lags 1, 2, 3, s, s + 1 and 2 s up to a third of what is left beyond twice the horizon; a mean over a season or a sixth."""
        if freq not in UNITS:
            raise ValueError(f"unknown frequency {freq!r}")
        longest = max(1, (n - 2 * horizon) // 3)
        lags = tuple(k for k in sorted({1, 2, 3, season, season + 1, 2 * season}) if k <= longest)
        return cls(lags or (1,), max(2, min(season, max(2, n // 6))), season, freq)

    @property
    def reach(self) -> int:
        return max(*self.lags, self.window, self.season)

    @property
    def names(self) -> list[str]:
        return [*(f"lag{k}" for k in self.lags), "rolling_mean", *DATE_PARTS[self.freq]]

    def of_buffer(self, buffer: Column, ds: Column) -> list[Column]:
        """The features of the value after a buffer, which is due at ds."""
        mean = F.aggregate(F.slice(buffer, -self.window, self.window), F.lit(0.0), lambda a, x: a + x) / self.window
        return [*(F.element_at(buffer, -k) for k in self.lags), mean, *(_PARTS[p](ds).cast("double") for p in DATE_PARTS[self.freq])]

    def of_rows(self, numbered: DataFrame) -> DataFrame:
        """The features of every row that has that much history; a window of a series is sorted once for all of them."""
        order = Window.partitionBy("unique_id").orderBy("ds")
        lags = [F.lag("y", k).over(order).alias(f"lag{k}") for k in self.lags]
        mean = F.avg("y").over(order.rowsBetween(-self.window, -1)).alias("rolling_mean")
        parts = [_PARTS[p](F.col("ds")).cast("double").alias(p) for p in DATE_PARTS[self.freq]]
        return numbered.select("unique_id", "ds", "y", "i", "n", *lags, mean, *parts).where(F.col("i") >= self.reach)


def numbered(series: DataFrame) -> DataFrame:
    """i: a row's place in its series, from 0; n: the series' rows."""
    return series.select("unique_id", "ds", F.col("y").cast("double").alias("y")).withColumn("i", (F.row_number().over(Window.partitionBy("unique_id").orderBy("ds")) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("unique_id")))


def eligible(rows: DataFrame, least: int) -> DataFrame:
    """Of numbered rows the series that have enough of them and vary; refused if there is none, with the arithmetic."""
    spans = rows.groupBy("unique_id").agg(F.count("*").alias("_n"), (F.min("y") < F.max("y")).alias("_varies"))
    found = spans.agg(F.count("*").alias("all"), F.max("_n").alias("longest"), F.count_if(F.col("_n") >= least).alias("long"), F.count_if((F.col("_n") >= least) & F.col("_varies")).alias("kept")).first()
    if not found.kept:
        why = f"they are flat ({found.long} of {found.all})" if found.long else f"the longest of {found.all} has {found.longest or 0} rows, {least} are needed"
        raise ValueError(f"no series can be forecast: {why}")
    return rows.join(spans.where((F.col("_n") >= least) & F.col("_varies")).select("unique_id"), "unique_id", "left_semi")


def buffers(rows: DataFrame, reach: int, horizon: int, windows: int) -> DataFrame:
    """(unique_id, window, cutoff, at, buffer): the reach values before each cutoff, oldest first; windows 0: the series' end."""
    if windows:
        made = rows.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
        cutoff = F.col("n") - (windows - F.col("window")) * horizon
    else:
        made, cutoff = rows.withColumn("window", F.lit(0)), F.col("n")
    last = made.withColumn("cutoff", cutoff).where((F.col("i") < F.col("cutoff")) & (F.col("i") >= F.col("cutoff") - reach))
    ordered = F.array_sort(F.collect_list(F.struct("i", "y")))  # reach values
    return last.groupBy("unique_id", "window", "cutoff").agg(F.max("ds").alias("at"), F.transform(ordered, lambda x: x.y).alias("buffer"))


def _due(roster: Roster, at: Column, step: Column | int) -> Column:
    return F.timestamp_add(UNITS[roster.freq].upper(), F.lit(step) if isinstance(step, int) else step, at)


def _exploded(state: DataFrame, roster: Roster, values: Column) -> DataFrame:
    """(unique_id, window, cutoff, step, ds, forecast) of an array of forecasts."""
    made = state.select("unique_id", "window", "cutoff", "at", F.posexplode(values).alias("_p", "forecast"))
    return made.select("unique_id", "window", "cutoff", (F.col("_p") + 1).alias("step"), _due(roster, F.col("at"), F.col("_p") + 1).alias("ds"), "forecast")


def naive_candidates(roster: Roster, horizon: int) -> dict[str, Column]:
    """Forecasts without a model, as arrays: the last value, the last season and the mean of the last values."""
    buffer, steps = F.col("buffer"), F.sequence(F.lit(0), F.lit(horizon - 1))
    mean = F.aggregate(F.slice(buffer, -roster.window, roster.window), F.lit(0.0), lambda a, x: a + x) / roster.window
    return {
        "naive": F.transform(steps, lambda s: F.element_at(buffer, -1)),
        "seasonal_naive": F.transform(steps, lambda s: F.element_at(buffer, (s % roster.season - roster.season).cast("int"))),
        "window_mean": F.transform(steps, lambda s: mean),
    }


def ridge(rows: int, spread: float, alpha: float = 1.0) -> LinearRegression:
    """Sum of squared errors plus alpha times that of the weights; the estimator divides its penalty by the spread of y."""
    return LinearRegression(labelCol="y", featuresCol="features", regParam=alpha * spread / rows, standardization=False, solver="normal")


def model_candidates(rows: int, spread: float, seed: int = 7) -> dict[str, Estimator]:
    """Three different biases: boosted trees, a random forest, and ridge regression."""
    return {
        "boosted": GBTRegressor(labelCol="y", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, seed=seed),
        "forest": RandomForestRegressor(labelCol="y", featuresCol="features", numTrees=20, maxDepth=7, minInstancesPerNode=2, seed=seed),
        "ridge": ridge(rows, spread),
    }


def _measured(train: DataFrame) -> tuple[int, float]:
    return tuple(train.agg(F.count("*"), F.stddev_pop("y")).first())


def linear_recursion(state: DataFrame, roster: Roster, horizon: int, weights: list[float], intercept: float) -> DataFrame:
    """All steps of a linear model as one expression over the buffer, which grows by a forecast each step."""
    at = F.col("at")

    def forecast(buffer: Column, step: Column) -> Column:
        terms = [w * x for w, x in zip(weights, roster.of_buffer(buffer, _due(roster, at, step)), strict=True)]
        return F.array_append(buffer, sum(terms, F.lit(intercept)))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("buffer"), forecast)
    return _exploded(state, roster, F.slice(grown, -horizon, horizon))


def stepwise_recursion(state: DataFrame, roster: Roster, horizon: int, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps of any model one after the other, each written, so that no plan holds them all; a row for each series and cutoff."""
    made = None
    keys = ["unique_id", "window", "cutoff", "at"]
    assembler = VectorAssembler(inputCols=roster.names, outputCol="features")
    for step in range(1, horizon + 1):
        due = _due(roster, F.col("at"), step)
        inputs = state.select(*keys, "buffer", *[c.alias(n) for n, c in zip(roster.names, roster.of_buffer(F.col("buffer"), due), strict=True)])
        stepped = cut(model(assembler.transform(inputs)).select(*keys, "buffer", "prediction"))
        one = stepped.select("unique_id", "window", "cutoff", F.lit(step).alias("step"), due.alias("ds"), F.col("prediction").alias("forecast"))
        made = one if made is None else made.unionByName(one)
        state = stepped.select(*keys, F.slice(F.array_append("buffer", F.col("prediction")), -roster.reach, roster.reach).alias("buffer"))
    return made


def _forecasts(train: DataFrame, state: DataFrame, roster: Roster, horizon: int, estimator: Estimator) -> DataFrame:
    assembler = VectorAssembler(inputCols=roster.names, outputCol="features")
    model = estimator.fit(assembler.transform(train).select("features", "y"))
    if isinstance(estimator, LinearRegression):
        return linear_recursion(state, roster, horizon, model.coefficients.tolist(), float(model.intercept))
    return stepwise_recursion(state, roster, horizon, model.transform)


def _history(series: DataFrame, season: int, horizon: int, windows: int) -> tuple[DataFrame, int]:
    """Eligible numbered rows, and the shortest history that a cutoff has."""
    rows = eligible(numbered(series), horizon * windows + 2 * season + 2)
    return rows, rows.agg(F.min("n")).first()[0] - horizon * windows


def global_forecasts(series: DataFrame, season: int, horizon: int, freq: str = "D", candidates: Mapping[str, Estimator] | None = None) -> DataFrame:
    """(model, unique_id, step, ds, forecast) of each candidate, one model over all series, beyond their ends.

    Series of under 2 s + 2 rows, and flat ones, are left out; refused if none is left.
    """
    rows, n = _history(series, season, horizon, 0)
    roster = Roster.of(n, season, horizon, freq)
    features = cut(roster.of_rows(rows))
    state = cut(buffers(rows, roster.reach, horizon, 0))
    made = None
    for name, estimator in (candidates or model_candidates(*_measured(features))).items():
        one = _forecasts(features, state, roster, horizon, estimator).select(F.lit(name).alias("model"), "unique_id", "step", "ds", "forecast")
        made = one if made is None else made.unionByName(one)
    return made


def backtest_forecasts(
    series: DataFrame, season: int, horizon: int, windows: int, freq: str = "D", models: bool = True, refit: bool = False, candidates: Mapping[str, Estimator] | None = None
) -> DataFrame:
    """(model, unique_id, window, step, ds, y, forecast) of every candidate from every cutoff, horizon rows apart.

    Models are fitted on rows before the first cutoff, or with refit anew on rows before each; buffers end at their
    cutoff. So no forecast depends on a value at or beyond its cutoff.
    """
    if windows < 2 or horizon < 1:
        raise ValueError("two windows and a horizon of one, at least: one window has no earlier errors to make a band of")
    rows, n = _history(series, season, horizon, windows)
    roster = Roster.of(n, season, horizon, freq)
    state = cut(buffers(rows, roster.reach, horizon, windows))
    made = None

    def add(name: str, found: DataFrame) -> None:
        nonlocal made
        one = found.withColumn("model", F.lit(name))
        made = one if made is None else made.unionByName(one)

    for name, values in naive_candidates(roster, horizon).items():
        add(name, _exploded(state, roster, values))
    if models:
        features = cut(roster.of_rows(rows))
        for window in range(windows) if refit else (0,):
            train = features.where(F.col("i") < F.col("n") - (windows - window) * horizon)
            some = state.where(F.col("window") == window) if refit else state
            for name, estimator in (candidates or model_candidates(*_measured(train))).items():
                add(name, _forecasts(train, some, roster, horizon, estimator))
    actual = rows.select("unique_id", F.col("i").alias("_i"), "y", F.col("ds").alias("_ds"))
    place = (made["unique_id"] == actual["unique_id"]) & (F.col("cutoff") + F.col("step") - 1 == F.col("_i"))
    return made.join(actual, place).select("model", made["unique_id"], "window", "step", F.col("_ds").alias("ds"), "y", "forecast")


def conformal_widths(forecasts: DataFrame, windows: int, level: float) -> DataFrame:
    """(model, unique_id, window, width): the band's half-width at a cutoff from the errors at earlier cutoffs alone."""
    later = forecasts.select("model", "unique_id", F.abs(F.col("y") - F.col("forecast")).alias("s"), F.explode(F.sequence(F.col("window") + 1, F.lit(windows))).alias("window")).where(F.col("window") < windows)
    w = Window.partitionBy("model", "unique_id", "window")  # horizon x windows rows
    n = F.col("n")
    share = F.least(F.lit(1.0), F.ceil(F.round((n + 1) * level, 9)) / n)
    ranked = later.withColumn("r", F.row_number().over(w.orderBy("s"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("r") == F.ceil(F.round(share * (n - 1), 9)) + 1).select("model", "unique_id", "window", F.col("s").alias("width"))


def backtest(forecasts: DataFrame, windows: int, level: float) -> DataFrame:
    """A row for each candidate, best first: pooled errors of all cutoffs, and what the bands of all but the first one cover."""
    if not 0 < level < 1:
        raise ValueError("coverage lies strictly between 0 and 1")
    joined = forecasts.join(conformal_widths(forecasts, windows, level), ["model", "unique_id", "window"], "left")
    inside = F.when(F.col("width").isNotNull(), (F.abs(F.col("y") - F.col("forecast")) <= F.col("width")).cast("double"))
    errors = [c.alias(n) for n, c in error_metrics().items()]
    scored = joined.groupBy("model").agg(*errors, F.lit(level).alias("requested"), F.avg(inside).alias("measured"), F.avg("width").alias("width"))
    return rank_forecasts(scored)
