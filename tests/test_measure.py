import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lakeframe.functions.ranks import exact_quantiles, global_row_number, higher_rank, in_order, order_statistics, rank_within, running_sums
from lakeframe.operators import drift, estimate, measure
from lakeframe.operators.registry_ops import CRITERIA, GateConfig, champion_challenger, latest_per_key, promotion_gate, rank_leaderboard, reason_codes
from lakeframe.spec import Feature, Problem


def test_regression_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "y double, p double")
    r = measure.regression_metrics(df, "y", "p").first()
    assert r.mape is None and r.mape_n_excluded == 2 and r.r2 is None and r.mae == 1.0
    assert measure.regression_metrics(df.limit(0), "y", "p").first().n == 0


def test_classification_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "t string, p string")
    r = measure.classification_metrics(df, "t", "p").first()
    assert (r.accuracy, r.balanced_accuracy, r.n_classes) == (0.5, 0.5, 3)
    assert math.isclose(r.recall, 1 / 3) and math.isclose(r.precision, 0.5) and math.isclose(r.f1_macro, (2 / 3 + 1 / 2 + 0) / 3)


def test_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(300)]
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    wanted = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "t boolean, s double")
    assert math.isclose(measure.auc(df, F.col("t"), F.col("s")).first().roc_auc, wanted)


def test_quantile_higher_is_exact(spark):
    rng = random.Random(3)
    for n in (1, 2, 19, 500):
        values = sorted(rng.choice([rng.random(), 0.5]) for _ in range(n))
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for level in (0.0, 0.5, 0.9, 1.0):
            got = df.select(measure.quantile_higher(df, F.col("v"), level, at_once=40).alias("q")).first().q
            assert got == values[higher_rank(n, level) - 1]


def test_quantiles_are_exact(spark):
    rng = random.Random(6)
    rows = [(rng.choice([rng.random(), 0.5, None]), float(rng.randrange(4)), None) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, empty double")
    levels = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    wanted = df.agg(*[F.percentile(c, F.array(*map(F.lit, levels))).alias(c) for c in ("a", "b")]).first()
    for at_once in (1, 30, 10_000):
        found = exact_quantiles(df, ["a", "b", "empty"], levels, at_once)
        assert found["empty"] is None
        for c in ("a", "b"):
            assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(found[c], wanted[c], strict=True))


def test_a_common_value_fills_no_task(spark):
    """Nine rows in ten have one value: every part holds less than twice the mean, and numbers are right."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(7.0).alias("v"), F.lit("x").alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    parts = [r["count"] for r in in_order(df, ["v", "id"]).groupBy("_p").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 2 and max(parts) < 2 * sum(parts) / len(parts)
    ranked = rank_within(df, ["g"], ["v", "id"]).select("id", "v", "rn", "n").collect()
    order = {r.id: i + 1 for i, r in enumerate(sorted(ranked, key=lambda r: (r.v, r.id)))}
    assert all(r.rn == order[r.id] and r.n == 20_000 for r in ranked)


def test_running_sums(spark):
    rng = random.Random(7)
    rows = [(g, float(i), rng.randrange(9)) for g in (None, "a", "b") for i in range(100)]
    found = running_sums(spark.createDataFrame(rows, "g string, v double, n long").where("g is not null"), ["g"], "v", ["n"]).collect()
    assert len(found) == 200
    for r in found:
        assert r.cum_n == sum(n for g, v, n in rows if g == r.g and v <= r.v) and r.total_n == sum(n for g, _, n in rows if g == r.g)


def test_coverage_skips_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0)] * 25 + [("b", 1.0)] * 5, "g string, y double")
    found = {r.g: r for r in measure.coverage_report(df, F.col("y") <= 1, F.lit(2.0), ["g"]).collect()}
    assert found["a"].measured == 1.0 and found["a"].meets_request and found["b"].skipped and found["b"].measured is None


def test_slices_are_skipped_not_dropped(spark):
    rows = [("a", float(i % 9), float(i % 9)) for i in range(40)] + [("b", 1.0, 1.0)] * 40 + [("c", 2.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "g string, y double, p double").withColumn("n", F.col("y")).withColumn("same", F.lit(1.0))
    report = measure.slice_report(df, {"g": ("a", "z")}, ["n", "same"], "y", "p").collect()
    found = {(r.feature, r.level): r for r in report}
    assert found["g", "a"].value == 1.0 and found["g", "b"].skipped == "undefined" and found["g", "c"].skipped == "too few rows"
    assert (found["g", "z"].n_rows, found["g", "z"].skipped) == (0, "absent") and not any(f == "same" for f, _ in found)
    assert "q1 (0, 1]" in {level for f, level in found if f == "n"}
    wrong = df.withColumn("p", F.when(F.col("g") == "a", -1.0).otherwise(F.col("p")))
    worst = [r for r in measure.slice_report(wrong, {"g": ()}, [], "y", "p", "mae").collect() if r.is_worst]
    assert [(r.level, r.gap > 0) for r in worst] == [("a", True)]


def test_score_refuses_what_it_cannot_measure(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert {r.metric for r in measure.score(df, "regression", "y", "p").collect() if r.is_primary} == {"r2"}
    assert {r.metric: r.higher_is_better for r in measure.score(df, "regression", "y", "p", "mae").collect()} == {"r2": True, "rmse": False, "mae": False, "median_ae": False, "mape": False}
    with pytest.raises(ValueError):
        measure.score(df, "regression", "y", "p", "accuracy")


def test_rolling_residuals(spark):
    rng = random.Random(12)
    rows = [(str(i), rng.random(), rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, pred double, e double")
    found = {r.key: r for r in measure.rolling_residuals(df, "pred", "e", "key").collect()}
    e = [x for _, _, x in sorted(rows, key=lambda r: (r[1], r[0]))]
    for i, (key, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        some = e[max(0, i - 10) : i + 10]  # 20 rows around
        mean = sum(some) / len(some)
        assert math.isclose(found[key].rolling_mean, mean, abs_tol=1e-9)
        assert math.isclose(found[key].rolling_std, (sum((x - mean) ** 2 for x in some) / (len(some) - 1)) ** 0.5, abs_tol=1e-9)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_global_row_number(spark, parts):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1.0, 1.0, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v double").repartition(parts)
    got = {r.i: r.rn for r in global_row_number(df, "v", ["i"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {i: k + 1 for k, (i, _) in enumerate(order)}
    assert global_row_number(df.limit(0), "v", ["i"]).count() == 0


def test_tails():
    assert math.isclose(drift.chi2_sf(3.0, 2), math.exp(-1.5), rel_tol=1e-12)
    assert math.isclose(drift.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(drift.chi2_sf(40.0, 2), math.exp(-20), rel_tol=1e-9)
    assert drift.chi2_sf(0.0, 3) == 1.0 and drift.chi2_sf(None, 3) is None


def test_drift(spark):
    rng = random.Random(5)
    once = [(rng.gauss(0, 1), rng.choice("aab"), rng.gauss(0, 1), 1.0) for _ in range(400)]
    rows = [(side, *r) for side in ("reference", "current") for r in once]
    df = spark.createDataFrame(rows, "side string, x double, c string, t double, y_pred double")
    problem = Problem((Feature("x", "numeric"), Feature("c", "categorical", ("a",)), Feature("gone", "numeric"), Feature("d", "datetime")), Feature("t", "numeric"))
    report = lambda f: drift.drift_report(f.where("side = 'reference'"), f.where("side = 'current'"), problem)
    assert {(r.feature, r.role, r.test) for r in report(df).collect()} == {("x", "feature", "ks"), ("c", "feature", "chi_square"), ("t", "target", "ks"), ("y_pred", "prediction", "ks")}
    assert drift.drift_verdict(report(df)).first().verdict in ("pass", "warn")
    current = F.col("side") == "current"
    moved = df.withColumn("x", F.when(current, F.col("x") + 3).otherwise(F.col("x"))).withColumn("c", F.when(current, "b").otherwise(F.col("c"))).withColumn("t", F.when(current, F.col("t") + 9).otherwise(F.col("t")))
    r = drift.drift_verdict(report(moved)).first()
    assert (r.verdict, r.drifted, r.n_features) == ("block", "c,x", 2) and r.target_p < 0.01 and r.prediction_p > 0.9
    only = drift.drift_verdict(report(df.withColumn("t", F.when(current, F.col("t") + 9).otherwise(F.col("t"))))).first()
    assert only.share == drift.drift_verdict(report(df)).first().share and only.target_p < 0.01  # the target is not in the share
    for bad in (df.limit(10), df.drop("x", "c"), df.where("side = 'reference'")):
        with pytest.raises(ValueError):
            report(bad)
    d = {r.feature: r.d for r in drift.ks_statistic(spark.createDataFrame([("reference", 1.0), ("reference", 2.0), ("current", 2.0), ("current", None)], "side string, x double"), "side", ["x"]).collect()}
    assert d == {"x": 0.5}


def test_alerts(spark):
    reports = spark.createDataFrame([("a", 500, 0.5, 0.001, None, 0.4), ("b", 100, 0.3, 0.5, 0.001, None), ("c", 500, 0.1, None, None, 0.9)], "run_id string, n_rows long, share double, target_p double, prediction_p double, estimated_metric double")
    found = {(r.run_id, r.severity, r.code) for r in drift.drift_alerts(reports, metric_floor=0.6).collect()}
    assert found == {("a", "block", "drift.share.block"), ("a", "warn", "drift.target"), ("a", "warn", "perf.estimated.below_floor"), ("b", "info", "drift.sample.small"), ("b", "info", "drift.share.warn"), ("b", "warn", "drift.prediction")}
    assert not any(r.code.startswith("perf") for r in drift.drift_alerts(reports).collect())


def run(id_, stage, value, coverage=0.9, worst=0.3, ok=True, leaks=0, domain="d", at="2024-01-01", metric="r2"):
    return (id_, domain, at, stage, metric, value, coverage, worst, ok, leaks)


def test_gate(spark):
    schema = "run_id string, domain_id string, created_at string, stage string, metric_name string, metric_value double, coverage double, worst_slice double, contract_ok boolean, n_leaks long"
    rows = [
        run("champion", "production", 0.7), run("old", "production", 0.9, at="2020-01-01"), run("good", "staging", 0.705), run("small", "staging", 0.704), run("uncovered", "staging", 0.8, coverage=0.84),
        run("unmeasured", "staging", 0.8, coverage=None), run("unchecked", "staging", 0.8, ok=None), run("worse", "staging", 0.8, worst=0.2), run("noslices", "staging", 0.8, worst=None), run("leaky", "staging", 0.8, leaks=1),
        run("unaudited", "staging", 0.8, leaks=None), run("first", "staging", 0.1, domain="new"), run("other", "staging", 0.1, metric="rmse"), run("unknown", "staging", 0.8, metric="odd", domain="new"),
        run("rmse", "production", 5.0, worst=9.0, domain="e", metric="rmse"), run("lower", "staging", 4.9, worst=8.0, domain="e", metric="rmse"), run("higher", "staging", 5.1, worst=9.5, domain="e", metric="rmse"),
    ]
    pairs = champion_challenger(spark.createDataFrame(rows, schema))
    judge = lambda *config: {r.run_id: r for r in promotion_gate(pairs, *config).collect()}
    found = judge()
    assert {k: [c for c in CRITERIA if not r.checks[c]] for k, r in found.items()} == {
        "good": [], "small": ["beats_champion"], "uncovered": ["coverage_meets_request"], "unmeasured": ["coverage_meets_request"], "unchecked": ["contracts_pass"], "worse": ["worst_slice_not_worse"],
        "noslices": ["worst_slice_not_worse"], "leaky": ["no_target_leakage"], "unaudited": ["no_target_leakage"], "first": [], "other": ["beats_champion"], "unknown": ["beats_champion", "worst_slice_not_worse"],
        "lower": [], "higher": ["beats_champion", "worst_slice_not_worse"],
    }
    assert all(r.promoted == all(r.checks.values()) and len(r.reasons) == 5 for r in found.values())
    assert math.isclose(found["lower"].metrics["gain"], 0.1) and math.isclose(found["lower"].metrics["worst_slice_delta"], 1.0) and "gain" not in found["first"].metrics
    waived = judge(GateConfig(require_coverage=False, require_contracts=False, slice_tolerance=0.2))
    assert "WAIVED coverage_meets_request" in waived["unmeasured"].reasons and "SKIPPED contracts_pass" in waived["good"].reasons and not waived["good"].promoted
    assert waived["worse"].checks["worst_slice_not_worse"]
    latest = latest_per_key(spark.createDataFrame(rows, schema).where("stage = 'production'"), "domain_id", "created_at", "run_id").collect()
    assert sorted(r.run_id for r in latest) == ["champion", "rmse"]


def test_leaderboard(spark):
    rows = [("d", "ridge", "r2", 0.746, 1, 0.1, False), ("d", "xgb", "r2", 0.738, 0, 0.2, True), ("d", "rf", "r2", 0.738, 0, 0.1, True), ("d", "deep", "r2", None, 2, None, True), ("e", "a", "rmse", 2.0, 0, 0.1, True), ("e", "b", "rmse", 1.0, 0, 0.1, True)]
    ranked = rank_leaderboard(spark.createDataFrame(rows, "domain_id string, name string, metric_name string, metric_value double, tier int, fit_seconds double, portable boolean"), "domain_id").collect()
    by = {r.name: r for r in ranked}
    assert [by[n].place for n in ("ridge", "rf", "xgb", "deep", "b", "a")] == [1, 2, 3, None, 1, 2]
    assert [n for n, r in by.items() if r.selected] == ["rf", "b"] and math.isclose(by["ridge"].gap, 0.008) and by["deep"].skipped


def test_expected_scores_and_calibration(spark):
    rng = random.Random(11)
    rows = [(i % 3, rng.random()) for i in range(900)]
    rows = [(c, s, rng.random() < s * s) for c, s in rows]
    df = spark.createDataFrame(rows, "chunk int, s double, hit boolean")
    found = {r.chunk: r for r in estimate.expected_scores(df, "chunk", F.col("s"), F.col("s"), F.col("hit")).collect()}
    for c in range(3):
        p = [s for k, s, _ in rows if k == c]
        tp = sum(s for s in p if s >= 0.5)
        assert math.isclose(found[c].estimated_f1, 2 * tp / (2 * tp + sum(1 - s for s in p if s >= 0.5) + sum(s for s in p if s < 0.5)))
        wins = sum(a * (1 - b) * ((a > b) + (a == b) / 2) for a in p for b in p)
        assert math.isclose(found[c].estimated_roc_auc, wins / (sum(p) * sum(1 - s for s in p)), rel_tol=1e-6) and found[c].headline == (c == 2)
    bins = {}
    for _, s, hit in rows:
        n, h = bins.get(round(s, 3), (0, 0))
        bins[round(s, 3)] = n + 1, h + hit
    blocks = []  # pools adjacent violators
    for x in sorted(bins):
        blocks.append([bins[x][0], bins[x][1], [x]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] > blocks[-1][1] / blocks[-1][0]:
            n, h, xs = blocks.pop()
            blocks[-1][0] += n
            blocks[-1][1] += h
            blocks[-1][2] += xs
    wanted = {x: h / n for n, h, xs in blocks for x in xs}
    for r in estimate.isotonic(df, df, "s", "hit").collect():
        assert math.isclose(r.calibrated, wanted[round(r.s, 3)], abs_tol=1e-9)
    with pytest.raises(ValueError):
        estimate.isotonic(df.limit(100), df, "s", "hit")


def test_reasons_read_well(spark):
    df = spark.createDataFrame([(12.5, -3.0, 0.0604), (7.0, 0.25, None)], "a double, b double, c double")
    text = reason_codes([("a", F.col("a"), F.col("b"), "h"), ("c", F.col("c"), F.lit(0.5), "")], 2, None, "days")
    assert [r.t for r in df.select(text.alias("t")).collect()] == [["a = 12.5 h pushed the estimate down by 3 days", "c = 0.0604 pushed the estimate up by 0.5 days"], ["c = unknown pushed the estimate up by 0.5 days", "a = 7 h pushed the estimate up by 0.25 days"]]


def test_order_statistics_of_skewed_columns(spark):
    """Far outliers, infinities, both signs and one value for most rows: exact with any number of values at once."""
    rng = random.Random(21)
    rows = [(rng.gauss(0, 1) * 10.0 ** rng.randrange(-200, 200), rng.choice([1e300, 0.0, -0.0, rng.random()]), rng.choice([float("inf"), -float("inf"), 1e308, -1e308, rng.random()])) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("d", F.lit(5.0))
    levels = [i / 64 for i in range(65)]
    for at_once in (1, 20):
        found = order_statistics(df, {c: F.col(c) for c in "abcd"}, lambda _, n: [higher_rank(n, p) for p in levels], at_once)
        for k, c in enumerate("abcd"):
            values = sorted((*r, 5.0)[k] for r in rows)
            assert found[c] == (500, {higher_rank(500, p): values[higher_rank(500, p) - 1] for p in levels})


def test_many_quantiles_take_few_rows(spark):
    """63 quantiles of four columns beyond what is ordered at once: passes are a few counts, no aggregate for each rank."""
    df = spark.range(20_000).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_007)).cast("double").alias(f"x{k}") for k in range(4)])
    levels = [i / 64 for i in range(1, 64)]
    began = time.time()
    found = exact_quantiles(df, df.columns, levels, at_once=500)
    assert time.time() - began < 60  # an aggregate and two counts for each rank took minutes
    wanted = df.agg(*[F.percentile(c, F.array(*map(F.lit, levels))).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(found[c], wanted[c], strict=True))
