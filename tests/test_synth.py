import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from lakeframe.functions.exprs import hash_normal, hash_uniform
from lakeframe.operators import synth


@pytest.fixture(scope="module")
def mixed(spark):
    """Numbers, levels, booleans, dates, times and nulls that all go with one hidden number."""
    z = hash_normal("id", 1, "z")
    df = spark.range(6000).withColumn("z", z)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("z") * 10 + 100).cast("int"))
    return df.select(
        F.exp("z").alias("x"), (F.col("z") * 2 + hash_normal("id", 1, "e")).alias("y"), F.floor(F.col("z") * 3).cast("int").alias("n"),
        F.when(F.col("z") < -0.5, "a").when(F.col("z") < 1, "b").otherwise("c").alias("level"), (F.col("z") > 0.3).alias("flag"), day.alias("day"),
        F.timestamp_seconds((F.col("z") * 1e5 + 1.7e9).cast("long")).alias("w"),
        F.when(hash_uniform("id", 1, "hole") > 0.2, F.round("z", 1)).cast("decimal(6,2)").alias("amount"), F.lit(4.0).alias("same"),
    )


@pytest.fixture(scope="module")
def made(mixed):
    return synth.copula_synthesize(mixed, mixed.columns, 6000).cache()


def test_types_shares_and_tails(mixed, made):
    assert made.count() == 6000 == made.select("id").distinct().count()
    assert dict(made.drop("id").dtypes) == dict(mixed.dtypes)
    for c in ("level", "flag"):
        real, drawn = ({r[0]: r[1] / 6000 for r in df.groupBy(c).count().collect()} for df in (mixed, made))
        assert set(real) == set(drawn) and all(abs(real[v] - drawn[v]) < 0.03 for v in real)
    holes = [df.where("amount is null").count() / 6000 for df in (mixed, made)]
    assert abs(holes[0] - holes[1]) < 0.03
    ends = [df.agg(F.min("x"), F.max("x"), F.min("day"), F.max("day")).first() for df in (mixed, made)]
    assert ends[0][0] <= ends[1][0] < 0.1 and 15 < ends[1][1] <= ends[0][1]
    assert (ends[1][2] - ends[0][2]).days < 8 and (ends[0][3] - ends[1][3]).days < 8
    assert made.select("same").distinct().collect() == [(4.0,)]
    # whole numbers stay whole, numbers seen once are not copied
    assert made.join(mixed.select("n").distinct(), "n", "left_anti").count() == 0
    assert made.join(mixed.select("x").distinct(), "x").count() < 60


def test_dependence_is_kept(mixed, made):
    def together(df):
        w = F.col("w").cast("double")
        flag = F.col("flag").cast("double")
        return df.agg(F.corr(F.log("x"), "y"), F.corr("y", "n"), F.corr("y", w), F.corr("y", flag), F.corr("y", F.unix_date("day"))).first()

    assert all(abs(r - s) < 0.06 for r, s in zip(together(mixed), together(made)))
    means = [{r[0]: r[1] for r in df.groupBy("level").agg(F.avg("y")).collect()} for df in (mixed, made)]
    assert all(abs(means[0][v] - means[1][v]) < 0.5 for v in "abc")


def test_values_that_are_not_broadcast(mixed, monkeypatch):
    """Frequent values by broadcast, others by join, and many parts: the same rows."""
    columns = ["x", "n", "level"]

    def drawn(fitted):
        return [(r.id, round(r.x, 6), r.n, r.level) for r in fitted.sample(2000).orderBy("id").collect()]

    wanted = drawn(synth.fit_copula(mixed, columns))
    monkeypatch.setattr(synth, "SMALL", 20)
    monkeypatch.setattr(synth, "DRAWS", 10)
    assert drawn(synth.fit_copula(mixed, columns)) == wanted


def test_repeats_nan_and_refusals(spark):
    rows = spark.createDataFrame([(float("nan"), "a"), (None, None), (1.0, ""), (-0.0, "a"), (0.0, "a")] * 40, "id_ double, w string")
    fitted = synth.fit_copula(rows, ["id_", "w"])
    assert fitted.distinct == (3, 3)
    drawn = fitted.sample(500, key="row")
    assert drawn.columns == ["row", "id_", "w"] and {r.id_ for r in drawn.collect()} == {None, 0.0, 1.0} and {r.w for r in drawn.collect()} == {None, "", "a"}
    assert fitted.sample(0).count() == 0
    other = rows.withColumn("l", F.array("w"))
    for bad in (lambda: synth.fit_copula(rows.limit(49), ["w"]), lambda: synth.fit_copula(rows, []), lambda: synth.fit_copula(rows, ["w", "no"]), lambda: synth.fit_copula(other, ["l"]), lambda: fitted.sample(5, key="w"), lambda: synth.fit_copula(rows.limit(0), ["w"])):
        with pytest.raises(ValueError):
            bad()


def test_quality_of_a_copy_and_of_noise(spark, mixed, made):
    columns = ["x", "y", "level", "flag", "w", "amount"]
    real, drawn = mixed.select(*columns), made.select(*columns)
    copied = synth.quality_report(real, real.select(*reversed(columns))).first()
    assert (copied.shape_score, copied.pair_score, copied.novelty, copied.note) == (1.0, 1.0, 0.0, "copying")
    good = synth.quality_report(real, drawn).first()
    assert good.shape_score > 0.95 and good.pair_score > 0.9 and good.novelty > 0.95 and good.note is None
    broken = drawn.withColumns({"y": hash_normal(F.col("x").cast("string"), 3, "y") - 9, "level": F.lit("d"), "x": -F.col("x"), "w": F.lit(datetime.datetime(2000, 1, 1)), "flag": F.lit(None).cast("boolean"), "amount": F.lit(decimal.Decimal("99.00"))})
    poor = synth.quality_report(real, broken).first()
    assert poor.quality < 0.6 and poor.note == "inventing"
    with pytest.raises(ValueError, match="amount"):
        synth.quality_report(real, drawn.drop("amount"))


def test_pairs_by_hand(spark):
    real = spark.createDataFrame([(0.0, 0.0, "a"), (10.0, 1.0, "b"), (5.0, None, None), (None, 0.5, "a")], "p double, q double, l string")
    made = spark.createDataFrame([(10.0, 0.0, "a"), (0.0, 1.0, "b"), (11.0, 0.5, None), (-1.0, 0.5, "a")], "p double, q double, l string")
    found = {(r.a, r.b): (r.kind, round(r.score, 9)) for r in synth.pair_trends(real, made).collect()}
    x, y = [10, 0, 11, -1], [0, 1, 0.5, 0.5]
    mx, my = sum(x) / 4, sum(y) / 4
    r = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert found["p", "q"] == ("numbers", round(1 - (1 - r) / 2, 9))
    assert found["p", "l"] == ("mixed", 0.0)  # no cell is in both
    assert found["q", "l"] == ("mixed", 0.75)  # (null, null) became (5, null)
    alone = synth.quality_report(real.select("l"), made.select("l")).first()
    assert alone.pair_score is None and alone.quality == alone.shape_score == 1.0
