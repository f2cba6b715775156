"""Frames moved on purpose, to show what drift detection finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from ..functions.ranks import running_sums
from ..functions.storage import stored


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, pct): the average rank of each distinct value over the number of values."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    return running_sums(values, [], column, ["c"]).select(column, ((F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2) / F.col("total_c")).alias("pct"))


def stress_shift(df: DataFrame, key: str, numeric: list[str], categorical: list[str], magnitude: float, seed: int) -> DataFrame:
    """df distorted, with copy (1, 2, ...) as rows can come several times.

    Numbers are stretched by 1 + magnitude and moved by magnitude deviations. Rows stay with a chance that grows with
    the rank of the first number, from 0.25 to 1.75, over the greatest such weight, unless too few would. Of every
    categorical in turn the rarest level, the first by name of equals, comes three times if under half of the rows
    have it and there is another.
    """
    df = stored(df)
    n = df.count()
    spread = df.agg(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(c) for c in numeric]).first()
    moved = df.select(*[(F.col(c) * (1 + magnitude) + magnitude * spread[c]).alias(c) if c in numeric else F.col(c) for c in df.columns])
    if numeric:
        ranks = average_ranks(moved, numeric[0])
        ranked = moved.join(ranks, numeric[0], "left").withColumn("_w", 0.25 + 1.5 * F.coalesce("pct", F.lit(0.5)))
        most = ranked.agg(F.max("_w")).first()[0]
        kept = stored(ranked.where(hash_uniform(key, seed, "thin") < F.col("_w") / F.lit(most)).select(*moved.columns))
        if kept.count() >= max(20, n // 5):
            moved = kept
    moved = moved.withColumn("_copies", F.lit(1).cast("long"))
    for c in categorical:
        counts = moved.groupBy(c).agg(F.sum("_copies").alias("m")).where(F.col(c).isNotNull())
        rare = counts.agg(F.min(F.struct("m", c)).alias("r"), F.sum("m").alias("total"), F.count("*").alias("levels")).first()
        if rare.levels > 1 and rare.r.m < rare.total // 2:
            moved = moved.withColumn("_copies", F.when(F.col(c) == rare.r[c], F.col("_copies") * 3).otherwise(F.col("_copies")))
    return moved.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies")
