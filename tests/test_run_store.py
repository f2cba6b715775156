import pytest
from pyspark.sql import functions as F

from lakeframe.operators import run_store


def frame(spark, rows):
    return spark.createDataFrame(rows, "run_id string, at long, r2 double")


def table(spark, path, number=None):
    return {r.run_id: (r.at, r.r2) for r in run_store.read(spark, path, number).collect()}


def test_replaces_adds_and_keeps_versions(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert run_store.version(spark, path) is None
    with pytest.raises(LookupError):
        run_store.read(spark, path)
    first = run_store.upsert(spark, path, frame(spark, [(f"r{i}", 1, float(i)) for i in range(100)]), "run_id", ["at"], buckets=8)
    assert first.number == 1 and set(first.folders) == set(range(8))
    # the last change to a key counts, in any order of rows and columns
    changes = frame(spark, [("r5", 3, None), ("r5", 2, 7.0), ("new", None, 1.0), ("r6", None, 2.0), ("r6", 0, 3.0)]).select("r2", "run_id", "at")
    second = run_store.upsert(spark, path, changes, "run_id", ["at"], expected=1)
    wanted = {f"r{i}": (1, float(i)) for i in range(100)} | {"r5": (3, None), "r6": (0, 3.0), "new": (None, 1.0)}
    assert table(spark, path) == wanted and run_store.read(spark, path).columns == ["run_id", "at", "r2"]
    assert table(spark, path, 1)["r5"] == (1, 5.0) and len(table(spark, path, 1)) == 100
    # buckets without changes stay where they lie
    same = [b for b in range(8) if second.folders[b] == first.folders[b]]
    assert 4 < len(same) + 1 and len(same) < 8
    third = run_store.upsert(spark, path, changes.limit(0), "run_id", ["at"])
    assert third.folders == second.folders and run_store.versions(spark, path) == [1, 2, 3]
    with pytest.raises(LookupError):
        run_store.read(spark, path, 9)


def test_lost_updates_are_refused(spark, tmp_path, monkeypatch):
    path, one = str(tmp_path / "runs"), frame(spark, [("a", 1, 1.0)])
    run_store.upsert(spark, path, one, "run_id", ["at"])
    run_store.upsert(spark, path, one.withColumn("r2", F.lit(2.0)), "run_id", ["at"], expected=1)
    with pytest.raises(run_store.LostUpdate):
        run_store.upsert(spark, path, one, "run_id", ["at"], expected=1)
    # both have read version 2, the other publishes first
    publish = run_store._publish

    def late(spark_, path_, made):
        monkeypatch.setattr(run_store, "_publish", publish)
        run_store.upsert(spark_, path_, one.withColumn("r2", F.lit(3.0)), "run_id", ["at"])
        publish(spark_, path_, made)

    monkeypatch.setattr(run_store, "_publish", late)
    with pytest.raises(run_store.LostUpdate):
        run_store.upsert(spark, path, one.withColumn("r2", F.lit(4.0)), "run_id", ["at"])
    assert table(spark, path) == {"a": (1, 3.0)} and run_store.versions(spark, path) == [1, 2, 3]


def test_failed_writers_leave_the_old_version(spark, tmp_path):
    path, one = str(tmp_path / "runs"), frame(spark, [("a", 1, 1.0)])
    run_store.upsert(spark, path, one, "run_id", ["at"])
    broken = one.withColumn("r2", F.expr("if(at = 1, double(raise_error('lost')), r2)"))
    with pytest.raises(Exception, match="lost"):
        run_store.upsert(spark, path, broken, "run_id", ["at"])
    (tmp_path / "runs" / "rows" / "half").mkdir()
    (tmp_path / "runs" / "versions" / ".draft-x").write_text("{")
    assert table(spark, path) == {"a": (1, 1.0)} and run_store.versions(spark, path) == [1]
    for bad in (frame(spark, [(None, 1, 1.0)]), one.drop("at"), one.withColumn("at", F.lit("x")), one.withColumn("_bucket", F.lit(1))):
        with pytest.raises(ValueError):
            run_store.upsert(spark, path, bad, "run_id", ["at"])
    with pytest.raises(ValueError):
        run_store.upsert(spark, path, one, "at", ["at"])
    assert table(spark, path) == {"a": (1, 1.0)}


def test_an_empty_table(spark, tmp_path):
    path, none = str(tmp_path / "runs"), frame(spark, [])
    assert run_store.upsert(spark, path, none, "run_id", ["at"]).number == 1
    assert run_store.read(spark, path).count() == 0
    run_store.upsert(spark, path, frame(spark, [("a", 1, 1.0)]), "run_id", [])
    assert table(spark, path) == {"a": (1, 1.0)}
