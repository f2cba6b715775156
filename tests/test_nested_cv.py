from functools import partial

import pytest
from pyspark.ml import Estimator, Model
from pyspark.sql import functions as F

from lakeframe.operators import learn


class GroupMean(Estimator):
    """Predicts the mean of the target in a row's group."""

    fits = []

    def __init__(self, group):
        super().__init__()
        self.group = group

    def _fit(self, df):
        self.fits.append(self.group)
        return Means(self.group, df.groupBy(self.group).agg(F.avg("y").alias("prediction")))


class Means(Model):
    def __init__(self, group, means):
        super().__init__()
        self.group, self.means = group, means

    def _transform(self, df):
        return df.join(F.broadcast(self.means), self.group)


@pytest.fixture(scope="module")
def folded(spark):
    rows = [(i % 3, "abc"[i // 3 % 3], "xy"[i // 2 % 2], float(i // 3 % 3 * (1 + i % 3) + i // 2 % 2 * 2 + i % 4 / 4)) for i in range(120)]
    return spark.createDataFrame(rows, "fold int, a string, b string, y double").coalesce(1)


def by_hand(rows, names):
    def score(group, left_out, judged):
        train = [r for r in rows if r.fold not in left_out]
        held = [r for r in rows if r.fold == judged]
        mean = {g: sum(r.y for r in train if r[group] == g) / sum(r[group] == g for r in train) for g in {r[group] for r in train}}
        middle = sum(r.y for r in held) / len(held)
        return 1 - sum((r.y - mean[r[group]]) ** 2 for r in held) / sum((r.y - middle) ** 2 for r in held)

    made = {}
    for o in range(3):
        inner = {n: sum(score(n, {o, i}, i) for i in range(3) if i != o) / 2 for n in names}
        best = max(names, key=lambda n: round(inner[n], 9))
        made[o] = (best, round(inner[best], 9), round(score(best, {o}, o), 9))
    return made


def test_nested_folds_by_hand(folded):
    GroupMean.fits.clear()
    found = learn.nested_cv(folded, {n: partial(GroupMean, n) for n in "ab"}, "y").collect()
    assert {r.outer_fold: (r.candidate, round(r.inner_r2, 9), round(r.outer_r2, 9)) for r in found} == by_hand(folded.collect(), "ab")
    assert len(GroupMean.fits) == 2 * 3 + 3  # a fit without two folds serves both
    chosen = [r.candidate for r in found]
    assert all(r.n_chosen == chosen.count(r.candidate) and r.n == 40 for r in found)


def test_ties_and_refusals(folded):
    twins = {"second": partial(GroupMean, "a"), "first": partial(GroupMean, "a")}
    assert {r.candidate for r in learn.nested_cv(folded, twins, "y").collect()} == {"second"}
    one = {"a": partial(GroupMean, "a")}
    for bad in ((folded.where("fold < 2"), one), (folded, {}), (folded.withColumn("fold", F.when(F.col("y") < 3, F.col("fold"))), one), (folded.withColumn("y", F.lit(1.0)), one), (folded.limit(0), one)):
        with pytest.raises(ValueError):
            learn.nested_cv(*bad, "y")
