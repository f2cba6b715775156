from lakeframe.jobs import QUERIES, learning
from lakeframe.jobs.frames import line
from lakeframe.operators import learn

SF = "/root/testdata/sf0.001"


def test_learnability_of_all_rows(spark, monkeypatch):
    """Counted, fitted and scored on the whole frame, however many rows it has."""
    monkeypatch.setattr(learning, "PROBE_ROWS", 1000, raising=False)
    df = line(spark, SF)
    wanted = learn.learnability(df, ["l_returnflag", "o_orderpriority"], ["l_quantity", "l_discount", "p_size"], "y", "key").first()
    found = QUERIES["learnability"](spark, SF).first()
    assert found.n_rows == df.where("y is not null").count() > 2000
    assert abs(found.r2 - wanted.r2) < 1e-6
    assert (found.learnable, found.too_easy) == (wanted.learnable, wanted.too_easy)
