"""Evidence that a generated frame is realistic, all of it measured on the frame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SETTINGS, Problem, Settings
from .latent import Driver, Interaction, LatentModel
from .measure import r2
from .stress import average_ranks

#: Shapes that turn, so that more of the feature is not always more or less of the target. Fixed values.
TURNING = ("square", "abs")


def driven_features(model: LatentModel) -> list[str]:
    """What the model reads, in the order of its terms."""
    names = [n for t in model.terms for n in ((t.left, t.right) if isinstance(t, Interaction) else (t.name,))]
    return list(dict.fromkeys(names))


def quartile_values(df: DataFrame, feature: str) -> tuple[float | None, float | None]:
    """The greatest value ranked within the lowest quarter and the least within the highest, by average ranks.

    None for both if there are fewer than four distinct values.
    """
    ranks = average_ranks(df, feature)
    n, low, high = ranks.agg(F.count("*"), F.max(F.when(F.col("pct") <= 0.25, F.col(feature))), F.min(F.when(F.col("pct") >= 0.75, F.col(feature)))).first()
    return (low, high) if n >= 4 else (None, None)


def realism_report(
    df: DataFrame, problem: Problem, model: LatentModel | None, confounders: Mapping[str, Column] | None = None, driver: str | None = None,
    achieved: Column | None = None, settings: Settings = SETTINGS,
) -> DataFrame:
    """One row on df, whose target the model, the confounders' contributions and noise add up to.

    n; missing: the share of nulls of each feature that has any; for classes their balance and the commonest share. With
    a model: what drives and what does not, terms that turn, interactions, confounders; variances of the signal, of the
    confounders' contribution and of the rest (noise), each measured; noise_to_signal, confounder_share and the ceiling of r2
    that they imply; oracle_r2 of the clamped signal on the target as it was recorded, headroom (r2 of achieved over it),
    and heteroscedasticity: the spread of what the signal leaves in the driver's top quarter over the bottom. Without a
    model none of these is guessed. A figure that cannot be had is null: too few rows for r2, no spread, no driver.
    """
    target = problem.target.name
    features = [f.name for f in problem.features if f.name in df.columns]
    share = lambda c: F.round(1 - F.try_divide(F.count(c), F.count("*")), 6)
    missing = F.array_compact(F.array(*[F.when(share(c) > 0, F.concat(F.lit(f"{c}="), F.format_number(share(c), 6))) for c in features]))
    measured = [F.count("*").alias("n"), F.array_join(missing, ",").alias("missing")]
    named: list[Column] = []
    if model is not None:
        confounder = sum((confounders or {}).values(), F.lit(0.0))
        low, high = quartile_values(df, driver) if driver in features else (None, None)
        left = F.col(target) - F.col("_raw")
        df = df.withColumn("_raw", model.raw()).withColumn("_signal", model.signal()).withColumn("_confounder", confounder)
        df = df.withColumn("_left", left).withColumn("_noise", left - F.col("_confounder"))
        enough = F.count(target) >= settings.learnability_min_rows
        oracle = F.when(enough, r2(target, "_signal"))
        unexplained = F.var_pop("_confounder") + F.var_pop("_noise")
        whole = F.var_pop("_raw") + unexplained
        spread = F.lit(None).cast("double")
        if low is not None:
            spread = F.try_divide(F.stddev_samp(F.when(F.col(driver) >= high, F.col("_left"))), F.stddev_samp(F.when(F.col(driver) <= low, F.col("_left"))))
        got = F.lit(None).cast("double")
        if achieved is not None:
            df = df.withColumn("_achieved", achieved)
            got = F.when(oracle > 0, F.try_divide(r2(target, "_achieved"), oracle))
        measured += [
            F.var_pop("_raw").alias("signal_variance"), F.var_pop("_confounder").alias("confounder_variance"), F.var_pop("_noise").alias("noise_variance"),
            F.sqrt(F.try_divide(unexplained, F.var_pop("_raw"))).alias("noise_to_signal"), F.try_divide(F.var_pop("_confounder"), whole).alias("confounder_share"),
            F.try_divide(F.var_pop("_raw"), whole).alias("ceiling"), oracle.alias("oracle_r2"), got.alias("headroom"), spread.alias("heteroscedasticity"),
        ]
        driven = driven_features(model)
        turning = [t.name for t in model.terms if isinstance(t, Driver) and t.shape in TURNING]
        named = [
            F.lit(",".join(driven)).alias("driven"), F.lit(",".join(c for c in (f.name for f in problem.features) if c not in driven)).alias("undriven"),
            F.lit(",".join(turning)).alias("turning"), F.lit(sum(isinstance(t, Interaction) for t in model.terms)).cast("long").alias("n_interactions"),
            F.lit(",".join(confounders or {})).alias("confounders"),
        ]
    one = df.agg(*measured).select("*", *named)
    if problem.task != "classification":
        return one
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("level")).agg(F.count("*").alias("c"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("level", "c"))), lambda x: F.concat(x["level"], F.lit("="), x["c"].cast("string")))
    classes = counts.agg(F.array_join(text, ",").alias("class_balance"), F.try_divide(F.max("c"), F.sum("c")).alias("majority_share"))  # a row for each class
    return one.crossJoin(classes)  # one row each
