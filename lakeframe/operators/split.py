"""Reproducible splits and folds: what a row gets depends on its key and the seed, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from ..functions.ranks import global_row_number, rank_within
from ..spec import SETTINGS, min_calibration_rows
from .measure import r2


def _hash_rank(df: DataFrame, key: str, seed: int, stream: str, by: list[str]) -> DataFrame:
    """rn: rank of a row by its hash within by, and n: rows there; a class may hold all rows."""
    return rank_within(df.withColumn("_u", hash_uniform(key, seed, stream)), by, ["_u", key]).drop("_u")


def _shares(**shares: float) -> None:
    for name, share in shares.items():
        if not 0 < share < 1:
            raise ValueError(f"{name} must be in (0, 1), not {share!r}")


def _has(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"the frame does not have that column: {missing}; it has {sorted(df.columns)[:12]}")


def _sizes(n: Column, test: float, calibration: float) -> tuple[Column, Column]:
    n_test = F.ceil(F.round(n * test, 9))
    return n_test, F.ceil(F.round((n - n_test) * calibration, 9))


def three_way_split(df: DataFrame, key: str, seed: int, stratum: str | None, test: float = 0.2, calibration: float = 0.25, coverage: float = SETTINGS.requested_coverage) -> DataFrame:
    """Exact shares within each stratum: ceil(test n) for test, ceil(calibration of the rest), the rest to train.

    Without a stratum, or where one has a single row, which no share can be cut from, shares are of the whole frame.
    Refused are shares outside (0, 1), a part without rows, and fewer calibration rows than the coverage needs.
    """
    _shares(test=test, calibration=calibration, coverage=coverage)
    _has(df, key, *([stratum] if stratum else []))
    strata = df.groupBy(stratum).agg(F.count("*").alias("n")) if stratum else df.agg(F.count("*").alias("n"))
    n_test, n_cal = _sizes(F.col("n"), test, calibration)
    sums = [F.sum("n"), F.min("n"), F.sum(n_test), F.sum(n_cal)]
    rows, least, tests, calibrations = (x or 0 for x in strata.agg(*sums).first())
    if stratum and least < 2:
        stratum = None
        tests, calibrations = (x or 0 for x in df.agg(F.count("*").alias("n")).select(n_test, n_cal).first())
    if min(tests, calibrations, rows - tests - calibrations) < 1:
        raise ValueError(f"of {rows} rows {tests} test and {calibrations} calibrate: a part is empty")
    if calibrations < (need := min_calibration_rows(coverage)):
        raise ValueError(f"{calibrations} calibration rows cannot support a coverage of {coverage}: {need} are needed")
    ranked = _hash_rank(df if stratum else df.withColumn("_one", F.lit(1)), key, seed, "split", [stratum or "_one"]).drop("_one")
    part = F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_cal, "calibration").otherwise("train")
    return ranked.withColumn("part", part)


def threshold_split(key: str, seed: int, test: float = 0.2, calibration: float = 0.25) -> Column:
    """The same without exact sizes and without any shuffle."""
    u = hash_uniform(key, seed, "split")
    return F.when(u < test, "test").when(u < test + (1 - test) * calibration, "calibration").otherwise("train")


def grouped_split(df: DataFrame, group: str, seed: int, test: float = 0.2) -> DataFrame:
    """Whole groups to one side: the share is of groups, exactly. Refused are fewer groups than sides."""
    _shares(test=test)
    _has(df, group)
    groups = df.select(group).distinct()
    few = groups.limit(3).count()
    if few < 2:
        raise ValueError("no groups" if not few else "a single group cannot be on both sides")
    if few == 2 and -(-round(2 * test, 9) // 1) > 1:
        raise ValueError(f"with two groups a test share of {test} leaves no group to train on")
    ranked = _hash_rank(groups.withColumn("_one", F.lit(1)), group, seed, "group", ["_one"])
    side = ranked.select(group, F.when(F.col("rn") <= F.ceil(F.round(F.col("n") * test, 9)), "test").otherwise("train").alias("part"))
    return df.join(side, group)


def time_ordered_split(df: DataFrame, time: str, ties: list[str], test: float = 0.2) -> DataFrame:
    """The first int(n (1 - test)) rows by time train."""
    n = df.count()
    cut = int(round(n * (1 - test), 9))
    if not 0 < cut < n:
        raise ValueError("a side of the split is empty")
    return global_row_number(df, time, ties).withColumn("part", F.when(F.col("rn") <= cut, "train").otherwise("test"))


def cv_folds(df: DataFrame, key: str, seed: int, k: int, stratum: str | None = None, group: str | None = None, time: str | None = None) -> DataFrame:
    """Balanced folds 0 to k - 1: rank by hash modulo k, within a stratum if there is one.

    By group, groups are ranked and all rows of one go together. By time, folds are the last k blocks of n // (k + 1)
    rows in order, to be scored by what trained on everything before; the rows before the first block have fold -1.
    Refused are fewer rows or groups than folds, classes rarer than folds, and more than one way at a time.
    """
    if k < 2 or sum(x is not None for x in (stratum, group, time)) > 1:
        raise ValueError("at least two folds, by one of stratum, group and time")
    if group:
        groups = df.select(group).distinct()
        _enough(groups.limit(k).count(), k, "groups")
        ranked = _hash_rank(groups.withColumn("_one", F.lit(1)), group, seed, "fold", ["_one"])
        return df.join(ranked.select(group, (F.col("rn") % k).cast("int").alias("fold")), group)
    if time:
        n = df.count()
        _enough(n, k + 1, "rows")
        block = n // (k + 1)
        fold = F.floor((F.col("_rn") - 1 - (n - k * block)) / block).cast("int")
        return global_row_number(df, time, [key], "_rn").withColumn("fold", F.greatest(fold, F.lit(-1))).drop("_rn")
    ranked = _hash_rank(df if stratum else df.withColumn("_one", F.lit(1)), key, seed, "fold", [stratum or "_one"])
    least = df.groupBy(stratum).count().agg(F.min("count")).first()[0] if stratum else df.limit(k).count()
    _enough(least or 0, k, f"rows of each {stratum}" if stratum else "rows")
    return ranked.withColumn("fold", (F.col("rn") % k).cast("int")).drop("_one", "rn", "n")


def _enough(n: int, k: int, what: str) -> None:
    if n < k:
        raise ValueError(f"{k} folds need {k} {what} at least, not {n}")


def score_holdout(df: DataFrame, key: str, y: str, p: str, seed: int) -> DataFrame:
    """(n_test, r2) of the rows that the seed holds out: a function of the keys and the seed alone."""
    return df.where(threshold_split(key, seed) == "test").agg(F.count("*").alias("n_test"), r2(y, p).alias("r2"))
