"""Metrics, calibration, conformal intervals and slices; all algebraic, so partial sums meet in one small shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import by_direction, unpivot
from ..functions.ranks import AT_ONCE, digitize, exact_quantiles, higher_rank, order_statistics, running_sums
from ..functions.storage import stored
from ..spec import SETTINGS, Settings

#: Names of metrics, and whether a larger value is better.
HIGHER_IS_BETTER = {
    "r2": True, "rmse": False, "mae": False, "median_ae": False, "mape": False, "accuracy": True, "balanced_accuracy": True,
    "f1_macro": True, "precision": True, "recall": True, "roc_auc": True, "log_loss": False, "brier_score": False, "expected_calibration_error": False, "max_calibration_error": False,
}


def r2(y: str, p: str) -> Column:
    """Undefined, thus null, where the truth is constant."""
    spread = F.count(y) * F.var_pop(y)
    return F.when(spread > 1e-12, 1 - F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))) / spread)


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    error = F.abs(F.col(y) - F.col(p))
    median = exact_quantiles(df, {"e": error}, [0.5])["e"]
    return df.agg(
        r2(y, p).alias("r2"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("mae"), F.lit(median[0] if median else None).cast("double").alias("median_ae"),
        F.avg(F.when(F.col(y) != 0, error / F.abs(F.col(y)))).alias("mape"), F.count_if(F.col(y) == 0).alias("mape_n_excluded"), F.count("*").alias("n"),
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, mean recall over true classes, macro scores over true and predicted classes, with 0 for 0 / 0."""
    cells = confusion(df, truth, predicted)
    sides = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), "n", (F.col("truth") == F.col("predicted")).alias("hit"))
    per = sides.groupBy("x.c").agg(F.sum(F.col("n") * F.col("x.t")).alias("true"), F.sum(F.col("n") * F.col("x.p")).alias("pred"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.t")).otherwise(0)).alias("tp"))
    recall, precision = F.when(F.col("true") > 0, F.col("tp") / F.col("true")), F.when(F.col("pred") > 0, F.col("tp") / F.col("pred"))
    per = per.withColumn("recall", recall).withColumn("precision", F.coalesce(precision, F.lit(0.0)))
    f1 = 2 * F.col("tp") / (F.col("true") + F.col("pred"))
    return per.agg(
        (F.sum("tp") / F.sum("true")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg(f1).alias("f1_macro"),
        F.avg("precision").alias("precision"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("recall"), F.count("*").alias("n_classes"),
    )


def areas(df: DataFrame, classes: dict[str, tuple[Column, Column]], places: int = 9) -> DataFrame:
    """(class, roc_auc) of each class's (positive, score) columns: Mann-Whitney with average ranks, over distinct scores.

    Scores are rounded to places: those nearer to each other count as ties. All classes are measured in one pass.
    """
    one = [F.struct(F.lit(c).alias("class"), F.round(score, places).alias("s"), positive.cast("long").alias("pos")) for c, (positive, score) in classes.items()]
    values = df.select(F.explode(F.array(*one)).alias("x")).groupBy("x.class", "x.s").agg(F.sum("x.pos").alias("pos"), F.sum(1 - F.col("x.pos")).alias("neg"))
    ranked = running_sums(values.where("s is not null"), ["class"], "s", ["neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    return ranked.groupBy("class").agg(F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def auc(df: DataFrame, positive: Column, score: Column, places: int = 9) -> DataFrame:
    return areas(df, {"": (positive, score)}, places).select("roc_auc")


def quantile_higher(df: DataFrame, score: Column, level: float | Callable[[int], float], at_once: int = AT_ONCE) -> Column:
    """A driver-side number: the smallest order statistic at or above the level, which may depend on the number of rows."""

    def rank(_: str, n: int) -> list[int]:
        return [higher_rank(n, level(n) if callable(level) else level)]

    n, found = order_statistics(df, {"s": score}, rank, at_once)["s"]
    return F.lit(next(iter(found.values())) if n else None).cast("double")


def conformal_level(n: int, coverage: float) -> float:
    return min(1.0, -(-round((n + 1) * coverage, 9) // 1) / n)


def conformal_width(calibration: DataFrame, y: str, p: str, coverage: float) -> Column:
    return quantile_higher(calibration, F.abs(F.col(y) - F.col(p)), lambda n: conformal_level(n, coverage))


def coverage_report(df: DataFrame, covered: Column, width: Column, by: list[str] = (), settings: Settings = SETTINGS) -> DataFrame:
    """Requested and measured coverage are two columns; groups with too few rows are reported as skipped."""
    made = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg(covered.cast("double")).alias("measured"), F.avg(width).alias("mean_width"))
    enough = F.col("n_rows") >= settings.coverage_min_rows
    floor = settings.requested_coverage - settings.coverage_tolerance
    return made.select(
        *by, "n_rows", F.lit(settings.requested_coverage).alias("requested"), F.when(enough, F.col("measured")).alias("measured"), F.when(enough, F.col("mean_width")).alias("mean_width"),
        F.when(enough, F.round("measured", 9) >= floor).alias("meets_request"), (~enough).alias("skipped"),
    )


def quantile_bands(df: DataFrame, columns: list[str], bands: int = 4) -> dict[str, list[float]]:
    """Borders of each column's quantile bands, equal ones once; a few numbers a column."""
    found = exact_quantiles(df, columns, [i / bands for i in range(bands + 1)])
    return {c: sorted(set(found[c] or [])) for c in columns}


def band_label(c: str, edges: list[float]) -> Column:
    """"q1 (a, b]" and so on; the first band includes its least value; null stays null."""
    label = F.lit(None).cast("string")
    for i in range(len(edges) - 2, -1, -1):
        label = F.when(F.col(c) <= edges[i + 1], F.lit(f"q{i + 1} ({edges[i]:g}, {edges[i + 1]:g}]")).otherwise(label)
    return F.when(F.col(c).isNotNull(), label)


def slice_report(df: DataFrame, levels: dict[str, tuple[str, ...]], numeric: list[str], y: str, p: str, metric: str = "r2", settings: Settings = SETTINGS) -> DataFrame:
    """The metric (r2, mae, rmse or accuracy) of every level and band of every feature, in one shuffle.

    levels names categorical and boolean features with the levels they declare; numeric ones go by quantile bands,
    those without two distinct values not at all. Slices that are small, undefined or declared but absent are skipped,
    not dropped. gap is how much worse than over all rows; is_worst marks the worst measured slice.
    """
    error = F.abs(F.col(y) - F.col(p)) if metric != "accuracy" else None
    value = {"r2": lambda: r2(y, p), "mae": lambda: F.avg(error), "rmse": lambda: F.sqrt(F.avg(error * error)), "accuracy": lambda: F.avg((F.col(y) == F.col(p)).cast("double"))}[metric]()
    edges = quantile_bands(df, numeric) if numeric else {}
    banded = df.select(y, p, *levels, *[band_label(c, edges[c]).alias(c) for c in numeric if len(edges[c]) > 2], F.lit("all").alias("(overall)"))
    long = unpivot(banded, [y, p], [c for c in banded.columns if c not in (y, p)], "feature", "level").where("level is not null")
    made = long.groupBy("feature", "level").agg(F.count("*").alias("n_rows"), value.alias("value"))
    declared = [(f, level) for f, names in levels.items() for level in names]
    if declared:
        made = made.join(F.broadcast(df.sparkSession.createDataFrame(declared, "feature string, level string")), ["feature", "level"], "full_outer").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    everything = Window.partitionBy()  # a row for each slice
    sign = 1 if HIGHER_IS_BETTER[metric] else -1
    reason = F.when(F.col("n_rows") == 0, "absent").when(F.col("n_rows") < settings.slice_min_rows, "too few rows").when(F.col("value").isNull(), "undefined")
    made = made.withColumn("overall", F.max(F.when(F.col("feature") == "(overall)", F.col("value"))).over(everything)).where(F.col("feature") != "(overall)").withColumn("skipped", reason)
    made = made.withColumn("value", F.when(F.col("skipped").isNull(), F.col("value"))).withColumn("gap", sign * (F.col("overall") - F.col("value")))
    return made.withColumn("is_worst", F.coalesce(F.col("gap") == F.max("gap").over(everything), F.lit(False)))


def score(df: DataFrame, task: str, y: str, p: str, primary: str | None = None) -> DataFrame:
    """(metric, value, higher_is_better, is_primary) for a regression or classification; an unmeasured primary is refused."""
    found = {"regression": regression_metrics, "classification": classification_metrics}[task](df, y, p)
    names = [c for c in found.columns if c in HIGHER_IS_BETTER]
    primary = primary or {"regression": "r2", "classification": "accuracy"}[task]
    if primary not in names:
        raise ValueError(f"the primary metric {primary!r} is not measured here: {names}")
    long = unpivot(found, [], names, "metric", "value", "double")
    return long.select("metric", "value", (by_direction("metric", HIGHER_IS_BETTER) > 0).alias("higher_is_better"), (F.col("metric") == primary).alias("is_primary"))


def reliability(df: DataFrame, confidence: Column, hit: Column, edges: list[float]) -> DataFrame:
    """(bin, n, confidence, accuracy) of bins [low, high), the last one closed, between the edges; empty bins are absent."""
    inner = sorted(set(edges))[1:-1]
    rows = df.select(digitize(confidence, inner).alias("bin"), confidence.alias("c"), hit.cast("double").alias("hit"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("hit").alias("accuracy"))


def _sums_so_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each row of a part that is in order, and the sums of _e and of its squares up to it."""
    i, total, squares = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            e = batch.column("_e").fill_null(0.0).to_numpy(zero_copy_only=False)
            sums, of_squares = total + np.cumsum(e), squares + np.cumsum(e * e)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_p"), pa.array(np.arange(i + 1, i + len(e) + 1)), pa.array(sums), pa.array(of_squares)], names=["_key", "_p", "_i", "_cum", "_squares"])
            i, total, squares = i + len(e), float(sums[-1]), float(of_squares[-1])


def rolling_residuals(df: DataFrame, prediction: str, residual: str, key: str, least: int = 15) -> DataFrame:
    """key, rolling_mean, rolling_std of the residual over max(least, n // 20) rows around, in the order of the prediction.

    Both come from running sums over the order of all rows, so a row needs only those at both ends of its window, which
    are sent to it by its number: the rows are ordered once, and a key is dealt out once more.
    """
    named = df.select(F.col(key).alias("_key"), prediction, F.col(residual).cast("double").alias("_e"))
    ordered = named.repartitionByRange(prediction, "_key").sortWithinPartitions(prediction, "_key").select("_key", "_e", F.spark_partition_id().alias("_p"))
    kind = named.schema["_key"].dataType.simpleString()
    spread = stored(ordered.mapInArrow(_sums_so_far, f"_key {kind}, _p int, _i long, _cum double, _squares double"))
    parts = spread.groupBy("_p").agg(F.count("*").alias("_n"), F.max_by("_cum", "_i").alias("_se"), F.max_by("_squares", "_i").alias("_see"))
    up_to = Window.orderBy("_p")  # a row for each part
    before = parts.select("_p", *[(F.sum(c).over(up_to) - F.col(c)).alias(f"{c}_before") for c in ("_n", "_se", "_see")])
    at = (F.col("_i") + F.col("_n_before")).alias("rn"), (F.col("_cum") + F.col("_se_before")).alias("_cum"), (F.col("_squares") + F.col("_see_before")).alias("_squares")
    summed = spread.join(F.broadcast(before), "_p").select(F.col("_key").alias(key), *at)
    n, all_, all_squares = parts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_se"), F.lit(0.0)), F.coalesce(F.sum("_see"), F.lit(0.0))).first()
    window = max(least, n // 20)
    ahead, behind = (window - 1) // 2, window // 2 + 1
    last = summed.select((F.col("rn") - ahead).alias("rn"), F.col("_cum").alias("_to"), F.col("_squares").alias("_to_squares"))
    first = summed.select((F.col("rn") + behind).alias("rn"), F.col("_cum").alias("_from"), F.col("_squares").alias("_from_squares"))
    joined = summed.select(key, "rn").join(last, "rn", "left").join(first, "rn", "left")
    m = F.least(F.col("rn") + ahead, F.lit(n)) - F.greatest(F.col("rn") - behind, F.lit(0))
    total = F.coalesce("_to", F.lit(all_)) - F.coalesce("_from", F.lit(0.0))
    squares = F.coalesce("_to_squares", F.lit(all_squares)) - F.coalesce("_from_squares", F.lit(0.0))
    enough = m >= max(5, window // 3)
    return joined.select(key, F.when(enough, total / m).alias("rolling_mean"), F.when(enough, F.sqrt(F.greatest(F.lit(0.0), squares - total * total / m) / (m - 1))).alias("rolling_std"))


def equal_width(c: Column, low: float | Column, high: float | Column, bins: int) -> Column:
    """Bin of [low, high), the last one closed."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((c - low) / (high - low) * bins))).cast("int")
