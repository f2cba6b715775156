"""Performance without labels: what probabilities and learned losses let one expect, chunk by chunk."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_sums
from ..spec import SETTINGS, Settings


def enough_rows(reference: DataFrame, current: DataFrame, settings: Settings = SETTINGS) -> None:
    """Refuse too small a reference, or less than a chunk to estimate."""
    if reference.limit(settings.estimate_min_reference).count() < settings.estimate_min_reference:
        raise ValueError(f"an estimate needs {settings.estimate_min_reference} labelled reference rows")
    if current.limit(settings.estimate_min_chunk).count() < settings.estimate_min_chunk:
        raise ValueError(f"an estimate needs {settings.estimate_min_chunk} current rows")


def expected_scores(df: DataFrame, chunk: str, confidence: Column, positive: Column, hit: Column, places: int = 9) -> DataFrame:
    """By chunk: expected accuracy from the confidence, expected f1 (at 0.5) and AUC of a class from its probability.

    A row counts as positive to the share of its probability, and as negative for the rest. headline marks the last chunk.
    """
    p = positive.alias("_p")
    called = F.col("_p") >= 0.5
    base = df.select(chunk, p, confidence.alias("_c"), hit.cast("double").alias("_h"))
    f1 = F.try_divide(2 * F.sum(F.when(called, F.col("_p")).otherwise(0.0)), F.sum(called.cast("long")) + F.sum("_p"))
    scores = base.groupBy(chunk).agg(F.count("*").alias("n"), F.avg("_c").alias("estimated_accuracy"), f1.alias("estimated_f1"), F.avg("_h").alias("realised_accuracy"))
    values = base.groupBy(chunk, F.round("_p", places).alias("s")).agg(F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg"))
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    areas = running_sums(values, [chunk], "s", ["neg"]).groupBy(chunk).agg(F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg")).alias("estimated_roc_auc"))
    return scores.join(areas, chunk).withColumn("headline", F.col(chunk) == F.max(chunk).over(Window.partitionBy()))  # a row for each chunk


def isotonic(reference: DataFrame, current: DataFrame, score: str, hit: str, places: int = 3, settings: Settings = SETTINGS) -> DataFrame:
    """current with calibrated: the share of hits at the score, never falling, as learned from the reference.

    The fit sees one weighted row for each score rounded to places, however many rows there are.
    """
    enough_rows(reference, current, settings)
    binned = reference.groupBy(F.round(score, places).alias("_x")).agg(F.avg(F.col(hit).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    features = VectorAssembler(inputCols=["_x"], outputCol="_v")
    model = IsotonicRegression(featuresCol="_v", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(features.transform(binned))
    return model.transform(features.transform(current.withColumn("_x", F.round(score, places)))).drop("_v", "_x")


def expected_losses(reference: DataFrame, current: DataFrame, features: list[str], y: str, p: str, settings: Settings = SETTINGS) -> DataFrame:
    """current with expected_loss: the absolute error that boosted trees learned to expect from features and prediction."""
    enough_rows(reference, current, settings)
    assembler = VectorAssembler(inputCols=[*features, p], outputCol="_v")
    learned = assembler.transform(reference.withColumn("_loss", F.abs(F.col(y) - F.col(p))))
    model = GBTRegressor(featuresCol="_v", labelCol="_loss", predictionCol="expected_loss", maxIter=8, maxDepth=4, seed=settings.random_seed).fit(learned)
    return model.transform(assembler.transform(current)).drop("_v")
