"""Model-level jobs on pyspark.ml: high-cardinality encoding, learnability, cross-validation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from itertools import combinations

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.base import Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, PCA, HashingTF, NGram, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform, unpivot
from ..functions.storage import stored
from ..spec import SETTINGS, Settings
from .measure import r2


def feature_pipeline(df: DataFrame, categorical: list[str], numeric: list[str], threshold: int = 40, grams: int = 512, components: int = 64) -> Pipeline:
    """One-hot up to threshold distinct levels, encoded spellings (string_encoder) above, numbers as they are."""
    levels = unpivot(df, [], categorical, "feature", "level").where("level is not null").distinct() if categorical else None
    counts = {r.feature: r["count"] for r in levels.groupBy("feature").count().collect()} if categorical else {}  # a row for each column
    low = [c for c in categorical if counts.get(c, 0) <= threshold]
    stages, inputs = [], list(numeric)
    if low:
        stages += [
            StringIndexer(inputCols=low, outputCols=[f"{c}_i" for c in low], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_i" for c in low], outputCols=[f"{c}_v" for c in low]),
        ]
    for c in categorical:
        if c not in low:
            stages += string_encoder(c, f"{c}_v", grams, components)
    inputs += [f"{c}_v" for c in [*low, *(c for c in categorical if c not in low)]]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")])


def string_encoder(column: str, output: str, grams: int = 512, components: int = 64) -> list[Estimator | Transformer]:
    """Stages that place strings by their spelling: hashed 3-grams of characters, TF-IDF of unit length, principal components.

    Their covariance (grams x grams) is summed over all rows by the executors, and only it reaches the driver. Case counts
    for nothing; strings that were not fitted on have a place too; null is the empty string.
    """
    text, chars, parts, tf, weighed, unit = (f"{output}_{s}" for s in ("text", "chars", "parts", "tf", "idf", "unit"))
    return [
        SQLTransformer(statement=f"SELECT *, concat('  ', coalesce(cast(`{column}` AS string), ''), ' ') AS `{text}` FROM __THIS__"),
        RegexTokenizer(inputCol=text, outputCol=chars, pattern="(?s).", gaps=False),
        NGram(n=3, inputCol=chars, outputCol=parts),
        HashingTF(numFeatures=grams, inputCol=parts, outputCol=tf),
        IDF(inputCol=tf, outputCol=weighed),
        Normalizer(inputCol=weighed, outputCol=unit),
        PCA(k=min(components, grams), inputCol=unit, outputCol=output),
    ]


def _sided(df: DataFrame, categorical: list[str], numeric: list[str], target: str, key: str, settings: Settings) -> DataFrame:
    """The labelled rows' features and target and whether they are held out, written once: a fit reads them many times."""
    rows = df.where(F.col(target).isNotNull()).na.fill(0.0, numeric)
    return stored(rows.select(*dict.fromkeys([*categorical, *numeric, target]), (hash_uniform(key, settings.random_seed, "learn") < 0.25).alias("_test")))


def _counted(df: DataFrame, features: list[str], target: str, key: str, settings: Settings) -> DataFrame:
    """Labelled rows with equal features, held out (_test) or not, as one: their number, and the target's mean, variance and ends."""
    y = F.col(target).cast("double")
    rows = df.where(F.col(target).isNotNull()).select(*features, y.alias("_y"), (hash_uniform(key, settings.random_seed, "learn") < 0.25).alias("_test"))
    counted = rows.groupBy(*features, "_test").agg(F.count("*").cast("double").alias("_n"), F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_var"), F.min("_y").alias("_low"), F.max("_y").alias("_high"))
    return stored(counted)


def _each(counted: DataFrame, at_once: int = 10_000) -> DataFrame:
    """Every row as often as it was counted, dealt out at_once of them at a time, so that no task has all copies of one."""
    n = F.col("_n").cast("long")
    parts = counted.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / at_once)))).repartition(F.xxhash64(*counted.columns, "_part"))
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(at_once).cast("long"), n - F.col("_part") * at_once)))).drop("_part", "_copy")


def learnability(df: DataFrame, categorical: list[str], numeric: list[str], target: str, key: str, settings: Settings = SETTINGS, max_iter: int = 8) -> DataFrame:
    """Held-out r2 of a quick model against the floor and the ceiling; refuses too few rows or a constant target.

    Rows with equal features are counted first. Trees on the means of their targets, weighed by the counts, split as trees
    on the rows do (what the target varies among equal rows is in every node the same), and r2 is that of the rows. Encoders
    of spellings have no weights, so they are fitted on each row again.
    """
    counted = _counted(df.na.fill(0.0, numeric), list(dict.fromkeys([*categorical, *numeric])), target, key, settings)
    n, low, high = counted.agg(F.sum("_n"), F.min("_low"), F.max("_high")).first()
    if (n or 0) < settings.learnability_min_rows or low == high:
        raise ValueError("too few labelled rows, or a constant target")
    train, test = counted.where("not _test"), counted.where("_test")
    pipeline = feature_pipeline(counted, categorical, numeric)
    fitted = pipeline.fit(_each(train) if any(isinstance(stage, IDF) for stage in pipeline.getStages()) else train)
    model = GBTRegressor(labelCol="_mean", weightCol="_n", featuresCol="features", maxIter=max_iter, maxDepth=4, seed=settings.random_seed).fit(fitted.transform(train))
    weight, mean = F.col("_n"), test.agg(F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).first()[0]
    off = [F.sum(weight * (F.col("_var") + F.pow(F.col("_mean") - c, F.lit(2)))) for c in (F.col("prediction"), F.lit(mean))]
    error, spread = model.transform(fitted.transform(test)).agg(*off).first()
    score = 1 - error / spread if spread else -math.inf
    return df.sparkSession.createDataFrame([(int(n), float(score), score >= settings.learnable_r2_floor, score > settings.too_easy_r2)], "n_rows long, r2 double, learnable boolean, too_easy boolean")


def learnability_classes(df: DataFrame, categorical: list[str], numeric: list[str], target: str, key: str, settings: Settings = SETTINGS) -> DataFrame:
    """Held-out accuracy of a quick model against the floor, or two points above the commonest class, and the ceiling."""
    rows = _sided(df, categorical, numeric, target, key, settings)
    counts = {r[target]: r["count"] for r in rows.groupBy(target).count().collect()}  # a row for each class
    n = sum(counts.values())
    if n < settings.learnability_min_rows or len(counts) < 2:
        raise ValueError("too few labelled rows, or a constant target")
    majority = max(counts.values()) / n
    floor = max(settings.learnable_accuracy_floor, majority + 0.02)
    labels = StringIndexer(inputCol=target, outputCol="_label").fit(rows)
    sided = labels.transform(rows)
    fitted = feature_pipeline(rows, categorical, numeric).fit(sided.where("not _test"))
    model = RandomForestClassifier(labelCol="_label", featuresCol="features", numTrees=20, maxDepth=6, seed=settings.random_seed).fit(fitted.transform(sided.where("not _test")))
    score = model.transform(fitted.transform(sided.where("_test"))).agg(F.avg((F.col("prediction") == F.col("_label")).cast("double"))).first()[0]
    return df.sparkSession.createDataFrame([(n, score, majority, floor, score >= floor, score > settings.too_easy_accuracy)], "n_rows long, accuracy double, majority_share double, floor double, learnable boolean, too_easy boolean")


def cross_validate(folded: DataFrame, estimator: Callable[[], Estimator], categorical: list[str], numeric: list[str], target: str) -> DataFrame:
    """(fold, n, r2, mae) of a fresh estimator, fitted on the other folds (by time: on what comes before)."""
    kept = stored(folded.select(*dict.fromkeys([*categorical, *numeric, target, "fold"])))
    folds = sorted(r.fold for r in kept.select("fold").distinct().collect())  # a row for each fold
    made = None
    for k in [f for f in folds if f >= 0]:
        train = kept.where(F.col("fold") < k) if folds[0] < 0 else kept.where(F.col("fold") != k)
        fitted = feature_pipeline(train, categorical, numeric).fit(train)
        scored = estimator().fit(fitted.transform(train)).transform(fitted.transform(kept.where(F.col("fold") == k)))
        one = scored.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), r2(target, "prediction").alias("r2"), F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae"))
        made = one if made is None else made.unionByName(one)
    return made.sparkSession.createDataFrame(made.collect(), made.schema)  # a row for each fold


def nested_cv(folded: DataFrame, candidates: dict[str, Callable[[], Estimator]], target: str) -> DataFrame:
    """(outer_fold, candidate, inner_r2, outer_r2, n, n_chosen): the candidate chosen without each fold, and how it does there.

    Inner folds are the other folds. A fit that leaves out two folds serves both as the outer one, so k folds take
    k (k - 1) / 2 fits of each candidate, and one of the chosen for each fold. Mean scores that are equal to nine places go
    to the first candidate; a fold without a score (its target does not vary) is left out of the mean. Candidates are
    pipelines on the frame's own columns. Refused are fewer than three folds, null folds and no candidates.
    """
    kept = stored(folded)
    folds = sorted((r.fold for r in kept.select("fold").distinct().collect()), key=lambda f: -1 if f is None else f)  # a row for each fold
    if len(folds) < 3 or None in folds or not candidates:
        raise ValueError("nested folds need three folds without nulls, and a candidate")
    inner: dict[tuple[str, int], list[float]] = {(c, o): [] for c in candidates for o in folds}
    for name, estimator in candidates.items():
        for a, b in combinations(folds, 2):
            model = estimator().fit(kept.where(~F.col("fold").isin(a, b)))
            scored = model.transform(kept.where(F.col("fold").isin(a, b)))
            found = {r.fold: r.r2 for r in scored.groupBy("fold").agg(r2(target, "prediction").alias("r2")).collect()}  # two rows
            for outer, held_out in ((a, b), (b, a)):
                if found.get(held_out) is not None:
                    inner[name, outer].append(found[held_out])
    rows = []
    for o in folds:
        means = {c: sum(inner[c, o]) / len(inner[c, o]) for c in candidates if inner[c, o]}
        if not means:
            raise ValueError(f"no candidate has a score without fold {o}")
        chosen = max(means, key=lambda c: round(means[c], 9))  # the first of equals
        scored = candidates[chosen]().fit(kept.where(F.col("fold") != o)).transform(kept.where(F.col("fold") == o))
        n, score = scored.agg(F.count("*"), r2(target, "prediction")).first()
        rows.append((o, chosen, means[chosen], score, n))
    tally = Counter(r[1] for r in rows)
    return folded.sparkSession.createDataFrame([(*r, tally[r[1]]) for r in rows], "outer_fold int, candidate string, inner_r2 double, outer_r2 double, n long, n_chosen long")
