"""How much noise makes a target as learnable as declared."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import bucket_of, order_statistics
from ..functions.storage import stored


def regression_budget(df: DataFrame, signal: Column, confounder: Column, r2: float, share: float) -> DataFrame:
    """One row: the signal's variance, sigma of the noise, the factor for the confounder, its variance, the ceiling of r2.

    What the signal must leave unexplained is a budget of variance; the confounder gets its share of it, whatever its
    raw spread is, and none if it has no spread.
    """
    if not (0 < r2 < 1 and 0 <= share < 1):
        raise ValueError("r2 lies strictly between 0 and 1, the confounder's share from 0 up to 1")
    one = df.agg(F.var_pop(signal).alias("signal_variance"), F.stddev_pop(confounder).alias("raw")).withColumn("budget", F.col("signal_variance") * (1 - r2) / r2)
    given = F.when(F.col("raw") > 0, share).otherwise(0.0)
    one = one.withColumn("sigma", F.sqrt(F.col("budget") * (1 - given)))
    scale = F.coalesce(F.try_divide(F.col("sigma") * F.sqrt(given / (1 - given)), F.col("raw")), F.lit(1.0))
    ceiling = F.try_divide("signal_variance", F.col("signal_variance") + F.col("budget"))
    return one.select("signal_variance", "sigma", scale.alias("confounder_scale"), (F.col("budget") * given).alias("confounder_variance"), ceiling.alias("ceiling"))


def _quantiles(df: DataFrame, c: Column, levels: list[float]) -> list[float]:
    """The least values that these shares of the rows do not exceed."""
    n, found = order_statistics(df, {"v": c}, lambda _, n: [max(1, math.ceil(round(p * n, 9))) for p in levels])["v"]
    return [found[max(1, math.ceil(round(p * n, 9)))] for p in levels]


def classification_sigma(df: DataFrame, signal: Column, unit_noise: Column, cuts: list[float], accuracy: float, steps: int = 12) -> DataFrame:
    """(sigma, accuracy): the noise at which that share of rows keeps the class that the quantiles of the score cut.

    A bisection over two columns that are written once; cuts are exact quantiles, counted in cells, so no task merges
    what grows with the rows.
    """
    kept = stored(df.select(signal.cast("double").alias("s"), unit_noise.cast("double").alias("z")))
    clean = _quantiles(kept, F.col("s"), cuts)
    low, high, share = 0.0, 8 * (kept.agg(F.stddev_pop("s")).first()[0] or 0.0), 0.0
    for _ in range(steps):
        sigma = (low + high) / 2
        noisy = F.col("s") + sigma * F.col("z")
        moved = _quantiles(kept, noisy, cuts)
        same = bucket_of(F.col("s"), sorted(clean)) == bucket_of(noisy, sorted(moved))
        share = kept.agg(F.avg(same.cast("double"))).first()[0]
        low, high = (sigma, high) if share > accuracy else (low, sigma)
    return df.sparkSession.createDataFrame([(sigma, share)], "sigma double, accuracy double")
