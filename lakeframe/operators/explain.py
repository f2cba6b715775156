"""What a scorer answers to its inputs: partial dependence, curves of single rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform

Grids = Mapping[str, Sequence[float] | Sequence[str]]


def _moved(df: DataFrame, grids: Grids) -> DataFrame:
    """A row for each row and grid point, in which that feature has the point's value: nothing of it is ever stored."""
    points = []
    for f, grid in grids.items():
        words = isinstance(grid[0], str)
        for i, v in enumerate(grid):
            points.append(F.struct(F.lit(f).alias("feature"), F.lit(i).alias("point"), F.lit(None if words else float(v)).cast("double").alias("x"), F.lit(v if words else None).cast("string").alias("s")))
    wide = df.withColumn("_g", F.explode(F.array(*points)))
    inputs = [F.when(F.col("_g.feature") == f, F.col("_g.s" if isinstance(grid[0], str) else "_g.x")).otherwise(F.col(f)).alias(f) for f, grid in grids.items()]
    others = [c for c in df.columns if c not in grids]
    return wide.select(*others, *inputs, "_g.feature", "_g.point")


def _nearest(f: str, grid: Sequence) -> Column:
    if isinstance(grid[0], str):
        return F.array_position(F.array(*map(F.lit, grid)), F.col(f)).cast("int") - 1
    share = (F.col(f) - float(grid[0])) / (float(grid[-1]) - float(grid[0]))
    return F.least(F.greatest(F.round(share * (len(grid) - 1)), F.lit(0)), F.lit(len(grid) - 1)).cast("int")


def partial_dependence(df: DataFrame, grids: Grids, score: Callable[[], Column]) -> DataFrame:
    """(feature, point, response, support_share, swing): mean score at each point of a feature's even grid or levels.

    Support is the share of rows nearest to the point; swing the range of a feature's responses. score gives a column
    over the features' names, so that any scorer made of columns will do.
    """
    response = _moved(df, grids).groupBy("feature", "point").agg(F.avg(score()).alias("response"))
    near = F.array(*[F.struct(F.lit(f).alias("feature"), _nearest(f, grid).alias("point")) for f, grid in grids.items()])
    support = df.select(F.explode(near).alias("x")).groupBy("x.feature", "x.point").agg(F.count("*").alias("n"))
    within = Window.partitionBy("feature")  # a row for each point
    joined = response.join(support, ["feature", "point"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("feature", "point", "response", (F.col("n") / F.sum("n").over(within)).alias("support_share"), (F.max("response").over(within) - F.min("response").over(within)).alias("swing"))


def individual_curves(df: DataFrame, key: str, grids: Grids, score: Callable[[], Column], rows: int, seed: int) -> DataFrame:
    """(key, feature, point, response) of a few rows, those of least hash."""
    few = df.orderBy(hash_uniform(key, seed, "ice"), key).limit(rows)
    return _moved(few, grids).select(key, "feature", "point", score().alias("response"))


def _ranks(key: str, pair: Column, n: int, seed: int) -> list[Column]:
    """A permutation of n features for each row and pair: every feature's place, by hash."""
    h = [F.xxhash64(F.col(key).cast("string"), pair, F.lit(f), F.lit(seed)) for f in range(n)]
    return [sum(((h[g] < h[f]) | ((h[g] == h[f]) & F.lit(g < f))).cast("int") for g in range(n) if g != f) + F.lit(0) for f in range(n)]


def attributions(df: DataFrame, key: str, features: Sequence[str], background: DataFrame, score: Callable[[], Column], most: int = 256, seed: int = 7) -> DataFrame:
    """(key, features): what each feature adds to a row's score over the background rows' mean score, by permutations.

    For every background row, at most most of them, a row has a permutation of its own, by hash, and the reverse of it: the
    features go from the background row's values to the row's own one by one, in that order, and each gets the change of
    the score. All is columns over the features' names, as the scorer itself is, and a row's numbers are summed where
    they are made. Exact for scores of at most pairwise interactions; a row's contributions always sum to its score less
    the background's mean. Keys are unique; a null feature stays null in the scorer's hands.
    """
    base = [tuple(r) for r in background.select(*[F.col(f).cast("double") for f in features]).limit(most + 1).collect()]
    if not 0 < len(base) <= most:
        raise ValueError(f"a background has 1 to {most} rows")
    n = len(features)
    rows = F.array(*[F.struct(F.lit(i).alias("pair"), *[F.lit(v).cast("double").alias(f"b{f}") for f, v in enumerate(r)]) for i, r in enumerate(base)])
    paired = df.select(key, *[F.col(c).cast("double").alias(f"_x{f}") for f, c in enumerate(features)], F.explode(rows).alias("_b"))
    placed = paired.select("*", *[r.alias(f"_k{f}") for f, r in enumerate(_ranks(key, F.col("_b.pair"), n, seed))])
    for name, place in (("f", lambda f: F.col(f"_k{f}")), ("r", lambda f: F.lit(n - 1) - F.col(f"_k{f}"))):  # a permutation and its reverse
        for step in range(n + 1):
            inputs = {c: F.when(place(f) < step, F.col(f"_x{f}")).otherwise(F.col(f"_b.b{f}")) for f, c in enumerate(features)}
            placed = placed.withColumns(inputs).withColumn(f"_{name}{step}", score())
    made = []
    for f, c in enumerate(features):
        change = F.lit(0.0)
        for name, place in (("f", F.col(f"_k{f}")), ("r", F.lit(n - 1) - F.col(f"_k{f}"))):
            scores = F.array(*[F.col(f"_{name}{step}") for step in range(n + 1)])
            change = change + F.get(scores, place + 1) - F.get(scores, place)
        made.append(F.avg(change / 2).alias(c))
    return placed.groupBy(key).agg(*made)
