import pytest
from pyspark.sql import functions as F

from lakeframe.functions import ranks
from lakeframe.operators import contract, profile
from lakeframe.spec import Feature, Problem, compare_schema, min_calibration_rows

PROBLEM = Problem((Feature("a", "categorical", ("x", "y")), Feature("n", "numeric", minimum=0, maximum=10, nullable=True), Feature("b", "boolean", nullable=True)), Feature("t", "numeric"))
ROWS = [("1", "x", "3", True, 1.0), ("2", "z", "11", None, 2.0), ("3", None, "no", False, None), ("4", "y", "-1", True, 4.0), ("5", "y", None, True, 5.0)]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "id string, a string, n string, b boolean, t double")


def test_spec_refuses():
    for bad in (lambda: Feature("1a", "numeric"), lambda: Feature("a", "categorical"), lambda: Feature("a", "numeric", ("x",)), lambda: Feature("a", "odd"), lambda: Problem((Feature("t", "numeric"),), Feature("t", "numeric")), lambda: Problem((), Feature("t", "categorical", ("one",)))):
        with pytest.raises(ValueError):
            bad()
    assert compare_schema(PROBLEM, ["a", "n", "x"], strict=True) == (["b", "t"], ["x"])
    assert compare_schema(PROBLEM, ["a", "n", "b"], inference=True) == ([], [])
    assert [min_calibration_rows(c) for c in (0.5, 0.9, 0.95)] == [1, 9, 19]
    with pytest.raises(ValueError):
        min_calibration_rows(1.0)


def test_all_violations_at_once(frame):
    found = {(r["column"], r["check"], r["row"]) for r in contract.violations(frame, PROBLEM, "id").collect()}
    assert found == {("a", "level", "2"), ("a", "null", "3"), ("n", "maximum", "2"), ("n", "minimum", "4"), ("n", "dtype", "3"), ("t", "null", "3")}
    assert contract.violations(frame.limit(0), PROBLEM, "id").collect() == []


def test_coerce_and_encode(frame):
    coerced = contract.coerce(frame, PROBLEM)
    assert [r.n for r in coerced.orderBy("id").collect()] == [3.0, 11.0, None, -1.0, None]
    rows = contract.one_hot(coerced, PROBLEM, ["id"]).orderBy("id").collect()
    assert [(r.a_x, r.a_y) for r in rows] == [(1, 0), (0, 0), (0, 0), (0, 1), (0, 1)]
    assert rows[0].b == 1.0 and "t" not in rows[0]
    with pytest.raises(ValueError):
        contract.one_hot(coerced.drop("n"), PROBLEM, ["id"])


def test_impute(frame):
    filled = contract.impute(contract.coerce(frame, PROBLEM), contract.coerce(frame, PROBLEM), ["n"], ["a"]).orderBy("id").collect()
    assert [r.n for r in filled] == [3.0, 11.0, 3.0, -1.0, 3.0]
    assert filled[2].a == "y" and filled[2].imputed_features == ["n", "a"] and filled[0].imputed_features == []


def test_leakage(spark):
    rows = [(float(i), str(float(i)), i * 1.0001, 5.0, float(i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "t double, copy string, settled double, constant double, other double")
    assert {r.feature: round(r.share, 3) for r in contract.duplicate_shares(df, ["copy", "other"], "t").collect()} == {"copy": 1.0, "other": 0.03}
    found = {r.feature: r.correlation for r in contract.correlations(df, ["settled", "constant", "other"], "t").collect()}
    assert found["settled"] > 0.98 and found["constant"] is None and found["other"] < 0.2


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "a", None), (1.0, "a", None), (3.0, None, None), (None, "b", None)], "x double, c string, empty string")
    r = profile.profile_numeric(df, ["x"]).first()
    assert (r.n_rows, r.n_null, r.n_unique, r.minimum, r.maximum, r["median"]) == (4, 1, 2, 1.0, 3.0, 1.0)
    assert [(r.level, r.n, r.share) for r in profile.top_levels(df, ["c"]).orderBy("nth").collect()] == [("a", 2, 0.5), ("b", 1, 0.25)]
    assert profile.duplicate_rows(df, ["x", "c", "empty"]).first().duplicate_rows == 1
    assert profile.duplicate_rows(df.limit(0), ["x"]).first().duplicate_rows == 0
    assert profile.missingness(df, ["empty"]).first().null_share == 1.0


def test_digest_is_of_the_multiset(spark):
    rows = [(str(i % 7),) for i in range(50)]
    digest = lambda r, n: profile.frame_digest(spark.createDataFrame(r, "row string").repartition(n), "row").first().digest
    assert digest(rows, 1) == digest(rows[::-1], 13)
    assert digest(rows, 1) != digest([*rows[1:], ("x",)], 1) and digest(rows, 1) != digest(rows[1:], 1)


LEAKY = Problem((Feature("a", "categorical", ("x", "y")), Feature("copy", "categorical", ("1.0",)), Feature("settled", "numeric"), Feature("other", "numeric"), Feature("flat", "numeric")), Feature("t", "numeric"))


@pytest.fixture
def leaky(spark):
    rows = [(str(i), "xy"[i % 2], f" {float(i)} ", i * 2.0 + 1, float(i * 7919 % 101), 5.0, float(i)) for i in range(400)]
    return spark.createDataFrame(rows, "id string, a string, copy string, settled double, other double, flat double, t double")


def train(df):
    return F.col("t").cast("int") % 4 != 0


def test_signals_name_feature_and_probe(leaky):
    found = {(r.feature, r.kind): (r.score, r.leaks) for r in contract.leakage_signals(leaky, LEAKY, train(leaky)).collect()}
    assert {k for k, (_, leaks) in found.items() if leaks} == {("copy", "duplicate"), ("settled", "correlation"), ("settled", "single_feature")}
    assert found["flat", "correlation"][0] is None and abs(found["other", "correlation"][0]) < 0.2
    assert len(found) == 5 + 3 + 5
    allowed = contract.leakage_signals(leaky, LEAKY, train(leaky), allow=("settled",)).collect()
    assert "settled" not in {r.feature for r in allowed}
    with pytest.raises(ValueError):
        contract.leakage_signals(leaky.limit(39), LEAKY, train(leaky))


def test_signals_of_classes(leaky):
    problem = Problem((Feature("settled", "numeric"), Feature("other", "numeric")), Feature("truth", "categorical", ("no", "yes")))
    df = leaky.withColumn("truth", F.when(F.col("t") < 100, "no").otherwise("yes"))
    found = {(r.feature, r.kind): r for r in contract.leakage_signals(df, problem, train(df)).collect()}
    assert {kind for _, kind in found} == {"duplicate", "single_feature"}
    assert found["settled", "single_feature"].leaks and not found["other", "single_feature"].leaks
    assert abs(found["other", "single_feature"].baseline - 0.75) < 0.01


def verdict_of(df, leaks=None, probe=(400, 0.5, True, False), strict=False):
    row = df.sparkSession.createDataFrame([probe], "n_rows long, r2 double, learnable boolean, too_easy boolean") if probe else None
    return contract.contract_verdict(df, LEAKY, "id", leaks, row, strict)


def test_verdict_names_what_it_finds(leaky):
    valid = leaky.withColumn("copy", F.lit("1.0"))
    r = verdict_of(valid).first()
    assert r.ok and r.schema_ok and r.issues == "" and r.first_failure is None
    assert r.warnings == "leakage was not measured | copy: constant | flat: constant"
    r = verdict_of(valid, contract.leakage_signals(valid, LEAKY, train(valid)), (400, 0.99, True, True)).first()
    assert (r.ok, r.first_failure, r.leaking) == (False, "leakage", "settled: correlation, settled: single_feature")
    assert r.issues == "leakage: 2 signals, strongest is settled: correlation" and r.warnings.startswith("too easy | ")
    assert verdict_of(valid, probe=None).first().issues == "learnability was not measured"
    assert verdict_of(valid, probe=(400, 0.0, False, False)).first().first_failure == "not learnable"
    r = verdict_of(leaky.drop("a")).first()
    assert (r.missing, r.schema_ok, r.first_failure, r.n_violations) == ("a", False, "missing columns", 400)
    assert r.issues == "missing columns: a | contract: 400 violations" and r.warnings.startswith("a: absent | ")
    assert verdict_of(valid.limit(0)).first().ok  # an empty frame breaks nothing
    with pytest.raises(ValueError, match="undeclared columns"):
        verdict_of(valid, strict=True)


def test_ranks_within_groups_of_any_size(spark, monkeypatch):
    """One group holds most rows; null is a group; with the table of parts broadcast and joined by both keys."""
    rows = [("hot" if i % 3 else None if i % 2 else "b", i * 7919 % 1009, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    wanted = {}
    for g in ("hot", None, "b"):
        members = sorted((v, i) for k, v, i in rows if k == g)
        wanted |= {i: (nth + 1, len(members)) for nth, (_, i) in enumerate(members)}
    for few in (ranks.FEW, 0):
        monkeypatch.setattr(ranks, "FEW", few)
        assert {r.id: (r.rn, r.n) for r in ranks.rank_within(df, ["g"], ["v", "id"]).collect()} == wanted
    assert ranks.rank_within(df.limit(0), ["g"], ["v"]).collect() == []
