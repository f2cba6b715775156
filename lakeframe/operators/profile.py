"""Profiles of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import unpivot
from ..functions.ranks import exact_quantiles
from ..spec import SETTINGS, Settings


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Head counts, range, mean, sample deviation and median of every column.

    Values are aggregated to counts first, so distinct ones cost no second shuffle; the mean is that of values rounded
    to 12 places, summed as decimals: it does not depend on the order of rows. Medians come by bracketed ranks.
    """
    long = unpivot(df, [], columns, "column", "value", "double")
    v, n = F.col("value"), F.col("n")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    known = F.when(v.isNotNull(), n)
    total = F.sum(v.cast("decimal(38,12)") * n.cast("decimal(18,0)"))
    made = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("n_null"), F.count("value").alias("n_unique"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.try_divide(total, F.sum(known).cast("decimal(20,0)")).alias("mean"),
        F.sum(known).alias("_n"), F.sum(v * n).alias("_s"), F.sum(v * v * n).alias("_ss"),
    )
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")) / F.nullif(F.col("_n") - 1, F.lit(0)))
    medians = exact_quantiles(df, columns, [0.5])
    median = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(medians[c][0] if medians[c] else None).cast("double"))])
    return made.withColumn("std", deviation).withColumn("median", median[F.col("column")]).drop("_n", "_s", "_ss")


def top_levels(df: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """The commonest levels of every column with their share of all rows; ties by level."""
    counted = unpivot(df, [], columns, "column", "level").groupBy("column", "level").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("column"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "level")
    return counted.withColumn("share", F.col("n") / total).where("level is not null").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def time_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, earliest, latest) of times."""
    one = df.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("earliest"), F.max(c).alias("latest")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in columns])).alias("x")).select("x.column", "x.r.n", "x.r.earliest", "x.r.latest")


def findings(df: DataFrame, columns: list[str], settings: Settings = SETTINGS) -> DataFrame:
    """(column, finding) for columns that are constant, mostly null or like ids; one aggregation."""
    one = df.agg(F.count("*").alias("n"), *[F.struct(F.count(c).alias("known"), F.count_distinct(c).alias("u")).alias(c) for c in columns])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in columns])).alias("x")).select("n", "x.column", "x.r.known", "x.r.u")
    n = F.col("n")
    finding = F.when(F.col("u") <= 1, "constant").when(1 - F.col("known") / n >= settings.high_null_share, "mostly null").when(F.col("u") / n >= settings.high_cardinality_share, "id-like")
    return long.where("n > 0").select("column", finding.alias("finding")).where("finding is not null")


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: how many rows and levels, and "level=count" of each, in order."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("m"))
    return counted.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.count("*").alias("n_levels"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "level", "m"))), ",").alias("text"))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first copy; only hashes of rows are shuffled."""
    hashed = df.select(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns]), 256).alias("h"))
    return hashed.groupBy("h").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    return unpivot(df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]), [], columns, "column", "null_share", "double")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("level")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # a row for each class
    return counted.withColumn("share", F.col("n") / F.sum("n").over(everything)).withColumn("majority_share", F.max("n").over(everything) / F.sum("n").over(everything))


def frame_digest(rows: DataFrame, row_text: str, prefixes: tuple[int, ...] = (5, 2)) -> DataFrame:
    """A fingerprint of the multiset of rows: a tree over hashes of rows, by ever shorter prefixes.

    Equal rows are counted before they are gathered, so copies cost nothing; a million buckets at the lowest level keep
    each small.
    """
    level = rows.groupBy(F.sha2(row_text, 256).alias("h")).agg(F.count("*").alias("n")).select("h", F.concat_ws(":", "h", "n").alias("leaf"), "n")
    for length in (*prefixes, 0):
        gathered = level.groupBy(F.substring("h", 1, length).alias("h") if length else F.lit("").alias("h"))
        level = gathered.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("leaf")), ","), 256).alias("digest"), F.sum("n").alias("n"))
        level = level.select("h", F.concat_ws(":", "h", "digest").alias("leaf"), "digest", "n")
    return level.select(F.col("n").alias("n_rows"), "digest")
