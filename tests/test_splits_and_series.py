import datetime

import pytest
from pyspark.sql import functions as F

from lakeframe.functions.exprs import hash_normal, hash_uniform
from lakeframe.jobs import QUERIES
from lakeframe.operators import explain, forecast, noise, split, stress, synth, world
from lakeframe.operators.latent import Driver, Interaction, LatentModel, Levels
from lakeframe.streaming import jobs as stream


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"k{i}", "ab"[i % 10 == 0], i % 40, i) for i in range(1000)], "key string, c string, g long, t long")


def parts_of(df):
    return {r.key: r.part for r in df.select("key", "part").collect()}


def test_three_way_split(rows):
    found = parts_of(split.three_way_split(rows, "key", 7, "c"))
    assert found == parts_of(split.three_way_split(rows.repartition(13), "key", 7, "c")) != parts_of(split.three_way_split(rows, "key", 8, "c"))
    sizes = [sum(p == x for p in found.values()) for x in ("test", "calibration", "train")]
    assert sizes == [200, 200, 600]
    rare = [found[f"k{i}"] for i in range(0, 1000, 10)]
    assert [rare.count(x) for x in ("test", "calibration", "train")] == [20, 20, 60]


def test_groups_and_time(rows):
    sides = {}
    for r in split.grouped_split(rows, "g", 7).collect():
        sides.setdefault(r.g, set()).add(r.part)
    assert all(len(s) == 1 for s in sides.values()) and sum(s == {"test"} for s in sides.values()) == 8
    found = split.time_ordered_split(rows, "t", ["key"]).collect()
    assert max(r.t for r in found if r.part == "train") < min(r.t for r in found if r.part == "test")
    with pytest.raises(ValueError):
        split.time_ordered_split(rows, "t", ["key"], test=1.0)


def test_folds(rows):
    counts = split.cv_folds(rows, "key", 7, 5, stratum="c").groupBy("c", "fold").count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts} == {180, 20}
    grouped = split.cv_folds(rows, "key", 7, 5, group="g").groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in grouped)
    timed = {r.t: r.fold for r in split.cv_folds(rows, "key", 7, 3, time="t").collect()}
    assert [timed[t] for t in (0, 249, 250, 499, 500, 749, 750, 999)] == [-1, -1, 0, 0, 1, 1, 2, 2]
    for bad in (dict(k=1), dict(k=101, stratum="c"), dict(k=41, group="g"), dict(k=1001), dict(k=3, stratum="c", time="t")):
        with pytest.raises(ValueError):
            split.cv_folds(rows, "key", 7, **bad)


def test_hashes(spark):
    df = spark.range(20000).select(hash_uniform("id", 7, "a").alias("u"), hash_uniform("id", 7, "b").alias("v"), hash_normal("id", 7, "n").alias("z"))
    r = df.agg(F.avg("u").alias("m"), F.corr("u", "v").alias("c"), F.avg("z").alias("zm"), F.stddev("z").alias("zs")).first()
    assert abs(r.m - 0.5) < 0.01 and abs(r.c) < 0.03 and abs(r.zm) < 0.03 and abs(r.zs - 1) < 0.03


def test_latent(spark):
    model = LatentModel(1.0, (Driver("x", 2.0, "square", 1.0, 2.0), Levels("c", {"a": 3.0}), Interaction("x", "c", 10.0, "b")), 0.0, 20.0)
    df = spark.createDataFrame([(3.0, "a"), (None, "a"), (5.0, "b"), (None, None)], "x double, c string")
    assert [r.s for r in df.select(model.signal().alias("s")).collect()] == [6.0, 4.0, 20.0, 1.0]


def days(spark, values):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", start + datetime.timedelta(days=i), v) for i, v in enumerate(values) if v is not None], "unique_id string, ds timestamp, y double")


def test_series(spark):
    filled = forecast.fill_gaps(days(spark, [1.0, None, 3.0])).orderBy("ds").collect()
    assert [r.y for r in filled] == [1.0, 0.0, 3.0]
    values = [float(i % 7) for i in range(70)]
    found = forecast.seasonal_naive(days(spark, values), 7, 10).orderBy("step").collect()
    assert [r.forecast for r in found] == [float(i % 7) for i in range(70, 80)]
    scored = forecast.backtest_seasonal_naive(days(spark, values), 7, 10, 3)
    assert scored.count() == 30 and scored.where("y <> forecast").count() == 0
    with pytest.raises(ValueError):
        forecast.rolling_origin(days(spark, values), 10, 1)


def test_world(spark):
    start = datetime.datetime(2024, 1, 1)
    bookings = spark.createDataFrame([(i, i % 40, i % 60, start + datetime.timedelta(hours=i), i % 4 > 0) for i in range(2000)], "shipment_id long, carrier_id long, facility_id long, booked_at timestamp, delivered boolean")
    carrier, facility = world.carriers(spark.range(39).toDF("carrier_id")), world.facilities(spark.range(60).toDF("facility_id"))
    rows = {r.shipment_id: r for r in world.shipments(bookings, carrier, facility).collect()}
    again = {r.shipment_id: r for r in world.shipments(bookings.repartition(7), carrier, facility).collect()}
    assert all(abs((r.spoilage_risk_pct or 0) - (again[i].spoilage_risk_pct or 0)) < 1e-6 and r.route_class == again[i].route_class for i, r in rows.items())
    for r in rows.values():
        low, high, least, most = world.JOURNEYS[r.route_class]
        assert low <= r.transit_hours <= high and least <= r.handoff_count <= most and -4 <= r.ambient_temp_c <= 40 and 5 <= r.payload_kg <= 900
        assert (r.spoilage_risk_pct is None) == (not r.delivered) and r.dispatched_at > r.booked_at
        assert r.carrier_id != 39 or r.carrier_tier == "standard"
    labelled = [r for r in rows.values() if r.delivered]
    mean = sum(r.spoilage_risk_pct for r in labelled) / len(labelled)
    r2 = 1 - sum((r.spoilage_risk_pct - r.signal) ** 2 for r in labelled) / sum((r.spoilage_risk_pct - mean) ** 2 for r in labelled)
    assert abs(r2 - 0.74) < 0.04
    read_out = world.readings(world.shipments(bookings, carrier, facility), spark.range(500).selectExpr("id as shipment_id", "1 as nth")).collect()
    assert len(read_out) == 500 and all(2.1 <= r.temperature_c <= 7.9 and 18 <= r.battery_pct <= 100 for r in read_out)


def test_stress_shift(spark):
    df = spark.createDataFrame([(str(i), float(i), "ab"[i % 10 == 0], "x") for i in range(1000)], "key string, n double, c string, one string")
    found = stress.stress_shift(df, "key", ["n"], ["c", "one"], 0.5, 7).collect()
    sd = (sum((i - 499.5) ** 2 for i in range(1000)) / 999) ** 0.5
    assert all(abs(r.n - (1.5 * int(r.key) + 0.5 * sd)) < 1e-6 for r in found)
    rare = [r for r in found if r.c == "b"]
    assert {r.copy for r in rare} == {1, 2, 3} and {r.copy for r in found if r.c == "a"} == {1} and len(rare) % 3 == 0
    kept = [int(r.key) for r in found if r.copy == 1]
    assert 450 < len(kept) < 700 and sum(k > 500 for k in kept) > 1.8 * sum(k < 500 for k in kept)


def test_noise(spark):
    df = spark.range(20_000).select(hash_normal("id", 1, "s").alias("s"), hash_normal("id", 1, "z").alias("z"))
    r = noise.regression_budget(df, F.col("s"), 3 * F.col("z"), 0.5, 0.2).first()
    assert abs(r.sigma**2 - 0.8 * r.signal_variance) < 1e-9 and abs(r.confounder_scale * 3 - (0.2 * r.signal_variance) ** 0.5) < 0.02 and abs(r.ceiling - 0.5) < 1e-9
    assert noise.regression_budget(df, F.col("s"), F.lit(0.0), 0.5, 0.2).first().confounder_variance == 0
    found = noise.classification_sigma(df, F.col("s"), F.col("z"), [0.5], 0.8).first()
    assert abs(found.accuracy - 0.8) < 0.01 and 0.6 < found.sigma < 0.85  # arctan(sigma) / pi is the share that crosses
    for bad in ((0.0, 0.2), (0.5, 1.0)):
        with pytest.raises(ValueError):
            noise.regression_budget(df, F.col("s"), F.col("z"), *bad)


def test_markdown_files(spark, tmp_path):
    from lakeframe.sources import io

    (tmp_path / "b.md").write_text("---\ntitle: B\ntags: [x, y]\n---\n\nBody of b\n")
    (tmp_path / "a.md").write_text("---\nid: z\ntitle: A\n---\nBody")
    (tmp_path / "open.md").write_text("---\ntitle: never closed\nBody")
    (tmp_path / "plain.md").write_text("no block")
    (tmp_path / "note.txt").write_text("---\ntitle: T\n---\n")
    found = io.read_markdown(spark, str(tmp_path)).collect()
    assert [(r.id, r.meta["title"], r.tags, r.body) for r in found] == [("b", "B", ["x", "y"], "Body of b"), ("z", "A", None, "Body")] or found[1].tags == [""]


def test_jobs_without_twins(spark):
    """What the jobs that fit or stream return, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    width = {r.width for r in QUERIES["vectorize_high_cardinality"](spark, sf).select("width").distinct().collect()}
    assert len(width) == 1 and width.pop() > 64
    found = QUERIES["rebuild_run_index"](spark, sf).collect()
    assert found == sorted(found, key=lambda r: (r.created_at, r.run_id), reverse=True) and all(r.run_id for r in found) and len(found) > 100
    binned = {r.feature: r.r2 for r in QUERIES["leakage_single_feature_binned"](spark, sf).collect()}
    assert binned["settled"] > 0.95 > binned["l_discount"]
    drifted = QUERIES["stream_drift"](spark, sf).collect()
    assert drifted and all(r.verdict in ("pass", "warn", "block") and 0 <= r.statistic <= 1 for r in drifted)
    verdict = QUERIES["contract_check"](spark, sf).first()
    assert (verdict.missing, verdict.ok, verdict.first_failure) == ("l_tax", False, "missing columns")
    classes = QUERIES["learnability_classes"](spark, sf).first()
    assert classes.floor >= classes.majority_share + 0.02 - 1e-9 and classes.learnable == (classes.accuracy >= classes.floor)
    folds = QUERIES["cross_validate_estimator"](spark, sf).collect()
    assert [r.fold for r in sorted(folds)] == [0, 1, 2] and all(0.5 < r.r2 < 0.9 for r in folds)
    for name in ("estimate_performance_calibrated", "estimate_performance_features"):
        for r in QUERIES[name](spark, sf).collect():
            estimated, realised = (r.estimated_accuracy, r.realised_accuracy) if "accuracy" in str(r) else (r.estimated_mae, r.realised_mae)
            assert abs(estimated - realised) < 0.25 * realised


def test_attributions(spark):
    """Additive scores give coefficient times distance from the background's mean; three-way ones still sum to the difference."""
    df = spark.createDataFrame([(str(i), float(i), float(i % 3), float(i % 5)) for i in range(20)], "key string, a double, b double, c double")
    background = df.where("a < 7")
    rows = [(r.a, r.b, r.c) for r in background.collect()]
    mean = [sum(x) / len(rows) for x in zip(*rows)]
    found = explain.attributions(df, "key", ["a", "b", "c"], background, lambda: 2 * F.col("a") + 3 * F.col("b") - F.col("c"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        i = int(r.key)
        assert abs(r.a - 2 * (i - mean[0])) < 1e-9 and abs(r.b - 3 * (i % 3 - mean[1])) < 1e-9 and abs(r.c + i % 5 - mean[2]) < 1e-9
    product = lambda a, b, c: a * b * c + a
    level = sum(product(*r) for r in rows) / len(rows)
    for r in explain.attributions(df, "key", ["a", "b", "c"], background, lambda: F.col("a") * F.col("b") * F.col("c") + F.col("a")).collect():
        i = int(r.key)
        assert abs(r.a + r.b + r.c - (product(i, i % 3, i % 5) - level)) < 1e-9
    with pytest.raises(ValueError):
        explain.attributions(df, "key", ["a"], df, lambda: F.col("a"), most=3)


def test_copula_keeps_dependence(spark):
    df = spark.range(2000).select(hash_normal("id", 1, "x").alias("x")).withColumn("y", F.col("x") * 2 + hash_normal(F.col("x").cast("string"), 1, "e"))
    made = synth.copula_synthesize(df, ["x", "y"], 2000)
    assert made.count() == 2000 and made.agg(F.corr("x", "y")).first()[0] > 0.7
    with pytest.raises(ValueError):
        synth.copula_synthesize(df.limit(10), ["x"], 5)


def test_stream_dedupe_and_windows(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), "r", 1, f"d{i % 10}", 1.0) for i in range(600)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, run_id string, tenant_id long, feature_digest string, prediction double")
    path = stream.log_files(spark, log)
    once = spark.read.parquet(stream.run_to_end(stream.dedupe_inputs(stream.source(spark, path), "30 days"), str(tmp_path / "d")))
    assert once.count() == 10
    counts = spark.read.parquet(stream.run_to_end(stream.traffic_volume(stream.source(spark, path)), str(tmp_path / "v")))
    assert {r.n for r in counts.collect()} == {60} and counts.count() >= 6


def test_split_refusals(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("key"), (F.col("id") % 4).alias("g"), F.lit("one").alias("same"))
    for bad in (0.0, 1.0, -0.1, 1.5):
        for shares in ({"test": bad}, {"calibration": bad}, {"coverage": bad}):
            with pytest.raises(ValueError, match="must be in"):
                split.three_way_split(df, "key", 1, "g", **shares)
    with pytest.raises(ValueError, match="are needed"):
        split.three_way_split(df, "key", 1, "g", coverage=0.995)
    with pytest.raises(ValueError, match="empty"):
        split.three_way_split(df.limit(2), "key", 1, None)
    with pytest.raises(ValueError, match="empty"):
        split.three_way_split(df.limit(0), "key", 1, "g")
    with pytest.raises(ValueError, match="that column"):
        split.three_way_split(df, "key", 1, "absent")
    rare = df.withColumn("g", F.when(F.col("key") == "7", 9).otherwise(F.col("g")))  # a class of one row: no strata
    parts = {r.part: r["count"] for r in split.three_way_split(rare, "key", 1, "g").groupBy("part").count().collect()}
    assert parts == {"test": 20, "calibration": 20, "train": 60}
    with pytest.raises(ValueError, match="that column"):
        split.grouped_split(df, "absent", 1)
    with pytest.raises(ValueError, match="single group"):
        split.grouped_split(df, "same", 1)
    with pytest.raises(ValueError, match="no group to train"):
        split.grouped_split(df.where("g < 2"), "g", 1, 0.9)
