"""Drift: level alignment, two-sample statistics for all features at once, verdicts and alerts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import unpivot
from ..functions.ranks import running_sums
from ..spec import SETTINGS, Problem, Settings


def level_counts(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """(feature, level, n_ref, n_cur): both sides' counts of every level of every column, in one shuffle."""
    long = unpivot(df, [side], columns, "feature", "level").where("level is not null")
    return long.groupBy("feature", "level").agg(F.count_if(F.col(side) == "reference").alias("n_ref"), F.count_if(F.col(side) == "current").alias("n_cur"))


def level_shares(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("feature")
    return counts.withColumn("share_ref", F.try_divide(F.col("n_ref"), F.sum("n_ref").over(w))).withColumn("share_cur", F.try_divide(F.col("n_cur"), F.sum("n_cur").over(w)))


def total_variation(counts: DataFrame) -> DataFrame:
    return level_shares(counts).groupBy("feature").agg((F.sum(F.abs(F.col("share_ref") - F.col("share_cur"))) / 2).alias("tv"))


def chi_square(counts: DataFrame) -> DataFrame:
    """Pearson's statistic of the current counts against the reference shares; levels new to the reference apart."""
    expected = F.col("share_ref") * F.sum("n_cur").over(Window.partitionBy("feature"))
    rows = level_shares(counts).withColumn("expected", expected)
    return rows.groupBy("feature").agg(
        F.sum(F.when(F.col("n_ref") > 0, F.pow(F.col("n_cur") - F.col("expected"), 2) / F.col("expected"))).alias("statistic"),
        (F.count_if(F.col("n_ref") > 0) - 1).alias("df"), F.sum(F.when(F.col("n_ref") == 0, F.col("n_cur")).otherwise(0)).alias("n_unseen"),
    )


def ks_statistic(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """(feature, d, n_ref, n_cur) for all columns: rows become counts of distinct values, which running sums go over."""
    long = unpivot(df, [side], columns, "feature", "value", "double").where("value is not null and not isnan(value)")
    values = long.groupBy("feature", "value").agg(F.count_if(F.col(side) == "reference").alias("r"), F.count_if(F.col(side) == "current").alias("c"))
    summed = running_sums(values, ["feature"], "value", ["r", "c"])
    gap = F.abs(F.try_divide("cum_r", "total_r") - F.try_divide("cum_c", "total_c"))
    return summed.groupBy("feature").agg(F.max(gap).alias("d"), F.max("total_r").alias("n_ref"), F.max("total_c").alias("n_cur"))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value: 2 sum (-1)^(k-1) exp(-2 k^2 l^2), as a column."""
    lam = d * F.sqrt(F.try_divide(n * m, n + m))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * lam * lam))
    total = 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def chi2_sf(x: float | None, df: float | None) -> float | None:
    """Upper tail of chi-square: a series below the mean, a continued fraction above."""
    if x is None or df is None or df <= 0 or math.isnan(x):
        return None
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    log_front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * math.exp(log_front))
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > tiny else tiny)
        c = b + an / c if abs(b + an / c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


#: Columns that may hold the prediction, in order of preference.
PREDICTION_COLUMNS = ("prediction", "prediction_label", "y_pred", "predicted")


def drift_statistics(df: DataFrame, side: str, numeric: list[str], categorical: list[str], settings: Settings = SETTINGS) -> DataFrame:
    """A row for each column with its test, statistic, p-value and whether it drifted."""
    found = []
    if numeric:
        ks = ks_statistic(df, side, numeric)
        p = kolmogorov_p(F.col("d"), F.col("n_ref"), F.col("n_cur"))
        found.append(ks.select("feature", F.lit("ks").alias("test"), F.col("d").alias("statistic"), F.lit(None).cast("long").alias("df"), p.alias("p")))
    if categorical:
        chi = chi_square(level_counts(df, side, categorical))
        chi2_p = F.udf(chi2_sf, "double")  # on one row for each column
        found.append(chi.select("feature", F.lit("chi_square").alias("test"), "statistic", "df", chi2_p("statistic", F.col("df").cast("double")).alias("p")))
    return reduce(DataFrame.unionByName, found).withColumn("drifted", F.col("p") < settings.drift_p_value)


def drift_report(reference: DataFrame, current: DataFrame, problem: Problem, settings: Settings = SETTINGS) -> DataFrame:
    """drift_statistics of every declared column that both frames have by name, with its role.

    Kinds come from the declaration; times are not tested, since time always passes. The target and the first of
    PREDICTION_COLUMNS are tested too, in roles of their own. Frames of too few rows or without a shared feature are
    refused: they would look like no drift.
    """
    shared = [c for c in reference.columns if c in set(current.columns)]
    kinds = {f.name: f.kind for f in problem.features if f.name in shared and f.kind != "datetime"}
    if not kinds:
        raise ValueError(f"no declared feature is in both frames: {shared[:10]}")
    least = min(reference.limit(settings.drift_min_rows).count(), current.limit(settings.drift_min_rows).count())
    if least < settings.drift_min_rows:
        raise ValueError(f"drift needs {settings.drift_min_rows} rows on either side")
    roles = dict.fromkeys(kinds, "feature")
    classes = problem.task == "classification"
    if problem.target.name in shared:
        kinds[problem.target.name], roles[problem.target.name] = "categorical" if classes else "numeric", "target"
    prediction = next((c for c in PREDICTION_COLUMNS if c in shared and c not in kinds), None)
    if prediction:
        kinds[prediction], roles[prediction] = "categorical" if classes or prediction == "prediction_label" else "numeric", "prediction"
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    both = reference.select(F.lit("reference").alias("_side"), *kinds).unionByName(current.select(F.lit("current").alias("_side"), *kinds))
    found = drift_statistics(both, "_side", numeric, [c for c in kinds if c not in numeric], settings)
    role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return found.withColumn("role", role[F.col("feature")])


def drift_verdict(report: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row; the share is of features alone, target and prediction stand beside it with their p-values."""
    feature = F.col("role") == "feature"
    share = F.avg(F.when(feature, F.col("drifted").cast("double")))
    verdict = F.when(share >= settings.drift_block, "block").when(share >= settings.drift_warn, "warn").otherwise("pass")
    names = F.array_join(F.sort_array(F.collect_list(F.when(feature & F.col("drifted"), F.col("feature")))), ",")
    of = {r: F.max(F.when(F.col("role") == r, F.col("p"))).alias(f"{r}_p") for r in ("target", "prediction")}
    return report.agg(F.count_if(feature).alias("n_features"), share.alias("share"), verdict.alias("verdict"), names.alias("drifted"), *of.values())


def drift_alerts(reports: DataFrame, settings: Settings = SETTINGS, metric_floor: float | None = None) -> DataFrame:
    """Rules over report rows (run_id, n_rows, share, target_p, prediction_p, estimated_metric), worst first by rank.

    Rules on the share fade to info on few rows; the floor has no default, as it depends on the metric.
    """
    few = F.col("n_rows") < settings.alert_min_rows

    def rule(fires: Column, severity: Column, code: str, value: Column, threshold: float) -> Column:
        return F.when(fires, F.struct(severity.alias("severity"), F.lit(code).alias("code"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold")))

    share, warn = F.col("share"), F.lit("warn")
    # The codes and severities of alerts, and the level of 0.01.
    rules = [
        rule(few, F.lit("info"), "drift.sample.small", F.col("n_rows"), settings.alert_min_rows),
        rule(share >= settings.drift_block, F.when(few, "info").otherwise("block"), "drift.share.block", share, settings.drift_block),
        rule((share >= settings.drift_warn) & (share < settings.drift_block), F.when(few, "info").otherwise("warn"), "drift.share.warn", share, settings.drift_warn),
        rule(F.col("target_p") < 0.01, warn, "drift.target", F.col("target_p"), 0.01),
        rule(F.col("prediction_p") < 0.01, warn, "drift.prediction", F.col("prediction_p"), 0.01),
    ]
    if metric_floor is not None:
        rules.append(rule(F.col("estimated_metric") < metric_floor, warn, "perf.estimated.below_floor", F.col("estimated_metric"), metric_floor))
    found = reports.select("run_id", F.explode(F.array_compact(F.array(*rules))).alias("a")).select("run_id", "a.*")
    return found.withColumn("rank", F.when(F.col("severity") == "block", 0).when(F.col("severity") == "warn", 1).otherwise(2))
