"""Structured streaming over the prediction log; each runs to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import unpivot
from ..functions.ranks import bucket_of
from ..functions.storage import fresh_path
from ..operators import drift
from ..spec import SETTINGS

LOG_SCHEMA = "event_id long, ts timestamp, run_id string, tenant_id long, feature_digest string, prediction double"


def source(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Write the stream as parquet under folder (or hand its batches on) until all input there is has been read."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    return f"{folder}/out"


def prediction_log_stream(stream: DataFrame) -> DataFrame:
    return stream.select("event_id", "ts", "run_id", "feature_digest", "prediction")


def traffic_volume(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts per run and window; rows later than the watermark go, windows are given once they are closed."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "run_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "run_id", "n")


def dedupe_inputs(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "feature_digest"])


def drift_per_batch(reference: DataFrame, out: str, columns: list[str], least: int = SETTINGS.alert_min_rows) -> Callable[[DataFrame, int], None]:
    """For each micro-batch of enough rows: statistics against a frozen reference, verdict and alerts, as parquet.

    Each batch has a folder of its own, which a replay of the batch writes anew.
    """

    def judge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns)
        n = rows.count()
        if n < least:
            return
        both = reference.select(F.lit("reference").alias("side"), *columns).unionByName(rows.select(F.lit("current").alias("side"), *columns))
        found = drift.drift_statistics(both, "side", columns, []).withColumn("role", F.lit("feature")).persist()
        verdict = drift.drift_verdict(found)
        reports = verdict.select(F.lit(str(number)).alias("run_id"), F.lit(n).alias("n_rows"), "share", "target_p", "prediction_p")
        codes = drift.drift_alerts(reports).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "severity", "code"))), ",").alias("alerts"))
        one = verdict.select("share", "verdict").crossJoin(codes)  # one row each
        found.crossJoin(one).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")
        found.unpersist()

    return judge


def cells(df: DataFrame, keys: Sequence[str], edges: dict[str, list[float]], levels: Sequence[str]) -> DataFrame:
    """(keys, feature, cell) of every value that is not missing: numbers by how many edges are not above them, levels by name."""
    named = [F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), bucket_of(F.col(c), sorted(e)).cast("string")).alias(c) for c, e in edges.items()]
    binned = df.select(*keys, *named, *[F.col(c).cast("string").alias(c) for c in levels])
    return unpivot(binned, keys, [*edges, *levels], "feature", "cell").where("cell is not null")


def reference_cells(reference: DataFrame, edges: dict[str, list[float]], levels: Sequence[str]) -> DataFrame:
    """(feature, cell, n_ref) of a frozen reference: a row for each bin and level."""
    return cells(reference, [], edges, levels).groupBy("feature", "cell").agg(F.count("*").alias("n_ref"))


def windowed_cells(stream: DataFrame, edges: dict[str, list[float]], levels: Sequence[str], window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, feature, cell, n_cur) of each window of event time, given once, when the watermark has passed its end."""
    timed = cells(stream.withWatermark("ts", late), ["ts"], edges, levels)
    return timed.groupBy(F.window("ts", window), "feature", "cell").agg(F.count("*").alias("n_cur")).select(F.col("window.start").alias("start"), "feature", "cell", "n_cur")


def compare_cells(current: DataFrame, reference: DataFrame, threshold: float, least: int) -> DataFrame:
    """(start, feature, n, tv, drifted, share, verdict) of windows with at least least values of a feature.

    tv is half the sum of the differences of shares over the cells of either side; share that of a window's features
    with tv over the threshold. Works on counts alone: a row for each window, feature and cell.
    """
    size = F.sum("n_cur").over(Window.partitionBy("start", "feature"))
    now = current.withColumn("n", size).where(F.col("n") >= least).withColumn("p_cur", F.col("n_cur") / F.col("n"))
    then = reference.withColumn("p_ref", F.col("n_ref") / F.sum("n_ref").over(Window.partitionBy("feature"))).select("feature", "cell", "p_ref")
    met = now.join(then, ["feature", "cell"], "left").withColumn("p_ref", F.coalesce("p_ref", F.lit(0.0)))
    tv = (F.sum(F.abs(F.col("p_cur") - F.col("p_ref"))) + 1 - F.sum("p_ref")) / 2  # what the window has no value of counts as a whole
    judged = met.groupBy("start", "feature").agg(F.max("n").alias("n"), tv.alias("tv")).withColumn("drifted", F.col("tv") > threshold)
    return judged.withColumn("share", F.avg(F.col("drifted").cast("double")).over(Window.partitionBy("start"))).withColumn("verdict", _verdict(F.col("share")))


def _verdict(share: Column) -> Column:
    return F.when(share >= SETTINGS.drift_block, "block").when(share >= SETTINGS.drift_warn, "warn").otherwise("pass")


def drift_by_window(reference: DataFrame, out: str, threshold: float = 0.1, least: int = SETTINGS.drift_min_rows) -> Callable[[DataFrame, int], None]:
    """For each batch of closed windows their comparison with the reference, once: a replayed batch overwrites its own folder."""

    def judge(batch: DataFrame, number: int) -> None:
        compare_cells(batch, reference, threshold, least).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return judge


def drifted_windows(spark: SparkSession, out: str) -> DataFrame:
    """What drift_by_window has written; empty before the first window has closed."""
    schema = "start timestamp, feature string, n long, tv double, drifted boolean, share double, verdict string, batch int"
    return spark.read.schema(schema).parquet(out)


def log_files(spark: SparkSession, log: DataFrame, parts: int = 8) -> str:
    """The log as JSON files in the order of time, as a service would have left them."""
    path = fresh_path(spark, "stream-in")
    log.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.json(path)
    return path
