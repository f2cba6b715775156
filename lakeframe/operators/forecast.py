"""Series: gap filling, lag features, rolling-origin windows, seasonal forecasts and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_gaps(points: DataFrame, step: str = "INTERVAL 1 DAY") -> DataFrame:
    """Every period between a series' first and last, with 0 where there is no value; sums equal times."""
    summed = points.groupBy("unique_id", "ds").agg(F.sum("y").alias("y"))
    spans = summed.groupBy("unique_id").agg(F.expr(f"sequence(min(ds), max(ds), {step})").alias("s")).select("unique_id", F.explode("s").alias("ds"))
    return spans.join(summed, ["unique_id", "ds"], "left").select("unique_id", "ds", F.coalesce("y", F.lit(0.0)).alias("y"))


#: Frequencies with the unit they truncate to, and the parts of the date that mean something to them.
UNITS = {"h": "hour", "D": "day", "W": "week", "MS": "month"}
DATE_PARTS = {"h": ("hour", "dayofweek"), "D": ("dayofweek", "week"), "W": ("week", "month"), "MS": ("month", "quarter")}


def event_series(points: DataFrame, time: str, freq: str) -> DataFrame:
    """(freq, unique_id, ds, y): y of points summed by hour, day, week from Monday or month, gaps as 0."""
    bucketed = points.select("unique_id", F.date_trunc(UNITS[freq], time).alias("ds"), "y")
    return fill_gaps(bucketed, f"INTERVAL 1 {UNITS[freq].upper()}").select(F.lit(freq).alias("freq"), "unique_id", "ds", "y")


def lag_features(series: DataFrame, season: int, horizon: int, freq: str = "D") -> DataFrame:
    """Lags 1, 2, 3, s, s + 1 and 2 s, a rolling mean before each value and the frequency's parts of the date.

    A series keeps the lags up to a third of what is left of it beyond twice the horizon; the mean goes over a season,
    or a sixth of the series where that is less, but two values at least.
    """
    order, whole = Window.partitionBy("unique_id").orderBy("ds"), Window.partitionBy("unique_id")
    counted = series.withColumn("n", F.count("*").over(whole))
    longest = F.greatest(F.lit(1), F.floor((F.col("n") - 2 * horizon) / 3))
    lags = {f"lag{k}": F.when(F.lit(k) <= longest, F.lag("y", k).over(order)) for k in sorted({1, 2, 3, season, season + 1, 2 * season})}
    window = F.greatest(F.lit(2), F.least(F.lit(season), F.greatest(F.lit(2), F.floor(F.col("n") / 6))))
    mean = F.avg("y").over(order.rowsBetween(-season, -1))
    for k in range(2, season):
        mean = F.when(window == k, F.avg("y").over(order.rowsBetween(-k, -1))).otherwise(mean)
    parts = {"hour": F.hour("ds"), "dayofweek": F.weekday("ds"), "week": F.weekofyear("ds"), "month": F.month("ds"), "quarter": F.quarter("ds")}
    return counted.withColumns(lags).withColumn("rolling_mean", mean).withColumns({n: parts[n] for n in DATE_PARTS[freq]})


def rank_forecasts(scored: DataFrame) -> DataFrame:
    """Best first by smape, mae and name; margin: how much better than the best of the others."""
    everything = Window.partitionBy()  # a row for each model
    order = Window.orderBy("smape", "mae", "model")
    best, second = F.min("smape").over(everything), F.try_element_at(F.sort_array(F.collect_list("smape").over(everything)), F.lit(2))
    ranked = scored.withColumn("place", F.row_number().over(order)).withColumn("_best", best).withColumn("_second", second)
    return ranked.withColumn("margin", F.when(F.col("place") == 1, F.col("_second")).otherwise(F.col("_best")) - F.col("smape")).drop("_best", "_second")


def rolling_origin(series: DataFrame, horizon: int, windows: int) -> DataFrame:
    """(series row, window, part): each window trains on what comes before its cutoff and scores the next horizon rows."""
    if windows < 2 or horizon < 1:
        raise ValueError("two windows and a horizon of one, at least")
    order = Window.partitionBy("unique_id").orderBy("ds")
    numbered = series.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("unique_id")))
    numbered = numbered.where(F.col("n") >= horizon * windows + 2).withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    cut = F.col("n") - (windows - F.col("window")) * horizon
    part = F.when(F.col("i") < cut, "train").when(F.col("i") < cut + horizon, "score")
    return numbered.withColumn("cutoff", cut).withColumn("part", part).where("part is not null")


def seasonal_naive(series: DataFrame, season: int, horizon: int) -> DataFrame:
    """Forecasts of the next horizon periods: the last season's values again."""
    order = Window.partitionBy("unique_id").orderBy(F.desc("ds"))
    last = series.withColumn("back", F.row_number().over(order)).where(F.col("back") <= season)
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).where((F.col("step") - 1) % season == season - F.col("back"))
    return steps.select("unique_id", "step", F.col("y").alias("forecast"))


def backtest_seasonal_naive(series: DataFrame, season: int, horizon: int, windows: int) -> DataFrame:
    """Scored rows of every window with the value one season (or as many as needed) before the cutoff."""
    scored = rolling_origin(series, horizon, windows).where("part = 'score'")
    back = F.ceil((F.col("i") - F.col("cutoff") + 1) / season) * season
    order = Window.partitionBy("unique_id").orderBy("ds")
    past = series.withColumn("j", F.row_number().over(order) - 1).select("unique_id", "j", F.col("y").alias("forecast"))
    return scored.withColumn("j", F.col("i") - back).join(past, ["unique_id", "j"]).select("unique_id", "window", "ds", "y", "forecast")


def error_metrics(actual: str = "y", forecast: str = "forecast") -> dict[str, Column]:
    a, p = F.col(actual), F.col(forecast)
    both = F.abs(p) + F.abs(a)
    return {
        "smape": F.avg(F.when(both < 1e-9, 0.0).otherwise(200 * F.abs(p - a) / both)),
        "mape": F.when(~F.bool_or(F.abs(a) < 1e-9), F.avg(F.when(F.abs(a) >= 1e-9, 100 * F.abs((p - a) / a)))),
        "mae": F.avg(F.abs(p - a)),
    }
