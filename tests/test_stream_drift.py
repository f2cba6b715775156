"""Drift by event time: late rows, windows, replays."""

import datetime

from pyspark.sql import functions as F

from lakeframe.streaming import jobs as stream

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, run_id string, tenant_id long, feature_digest string, prediction double"


def log(spark, days, value):
    rows = [(d * 1000 + i, START + datetime.timedelta(days=d, minutes=14 * i), "ab"[i % 2], 1, "x", value(d, i)) for d in range(days) for i in range(100)]
    return spark.createDataFrame(rows, SCHEMA)


def test_windows_are_judged_once(spark, tmp_path):
    edges = {"prediction": [10.0, 20.0]}
    reference = stream.reference_cells(log(spark, 4, lambda d, i: float(i % 30)), edges, ["run_id"]).cache()
    current = log(spark, 5, lambda d, i: None if i == 7 else float(i % 30) + (50 if d == 2 else 0))
    for d in range(5):  # a file a day, one after the other
        current.where(F.datediff("ts", F.lit(START)) == d).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    rows = stream.source(spark, str(tmp_path / "in"), 1)
    calls, judge = [], stream.drift_by_window(reference, str(tmp_path / "out"))

    def twice(batch, number):
        """A batch that is replayed after its output was written."""
        judge(batch, number)
        calls.append(number)
        judge(batch, number)

    stream.run_to_end(stream.windowed_cells(rows, edges, ["run_id"]), str(tmp_path), each=twice)
    found = {(r.start.day, r.feature): r for r in stream.drifted_windows(spark, str(tmp_path / "out")).collect()}
    assert len(calls) > 2 and stream.drifted_windows(spark, str(tmp_path / "out")).count() == len(found)
    assert set(found) >= {(d, f) for d in (1, 2, 3, 4) for f in ("prediction", "run_id")}
    assert found[3, "prediction"].drifted and found[3, "prediction"].verdict == "block" and found[3, "prediction"].n == 99
    assert not found[2, "prediction"].drifted and found[2, "run_id"].tv == 0 and found[2, "run_id"].verdict == "pass"
    wanted = {r.feature: r.tv for r in stream.compare_cells(stream.cells(current.where("to_date(ts) = '2024-01-03'"), [], edges, ["run_id"]).groupBy("feature", "cell").agg(F.count("*").alias("n_cur")).withColumn("start", F.lit(0)), reference, 0.1, 30).collect()}
    assert all(abs(found[3, f].tv - tv) < 1e-12 for f, tv in wanted.items())


def test_micro_batches_overwrite_their_own_folder(spark, tmp_path):
    reference = log(spark, 3, lambda d, i: float(i % 30))
    judge = stream.drift_per_batch(reference, str(tmp_path / "out"), ["prediction"], 50)
    batch = log(spark, 2, lambda d, i: float(i % 30))
    for number in (0, 1, 1):
        judge(batch, number)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().orderBy("batch").collect() == [(0, 1), (1, 1)]


def test_few_values_and_unseen_levels(spark):
    reference = spark.createDataFrame([("f", "a", 8), ("f", "b", 2)], "feature string, cell string, n_ref long")
    current = spark.createDataFrame([(1, "f", "a", 30), (1, "f", "new", 10), (2, "f", "a", 5)], "start int, feature string, cell string, n_cur long")
    found = stream.compare_cells(current, reference, 0.1, 30).collect()
    assert [(r.start, r.n, round(r.tv, 9), r.verdict) for r in found] == [(1, 40, 0.25, "block")]
