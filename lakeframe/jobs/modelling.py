"""Jobs on splits, folds, synthetic data, series, scoring and explanation."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_normal, hash_uniform, rounded, unpivot
from ..functions.ranks import digitize, exact_quantiles, global_row_number
from ..functions.storage import fresh_path, stored
from ..operators import forecast, measure, noise, profile, realism, split, synth
from ..operators.stress import average_ranks
from ..sources import io
from ..spec import Feature, Problem
from .frames import CLASSES, HOLES_SQL, LINE, LINE_SQL, MODEL, SCORER, SEED, SERIES_SQL, SIGMA, SIGNAL_SQL, _uniform, holes, line, read, series
from .registry import job

_U_SPLIT = _uniform("key", SEED, "split")


def _rank_sql(by: str, stream: str, frame: str = "line") -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {_uniform('key', SEED, stream)}, key) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {frame}"


@job(f"""
    WITH {LINE_SQL}, r AS (SELECT key, l_returnflag, {_rank_sql('l_returnflag', 'split')}), t AS (SELECT *, ceil(round(n * 0.2, 9)) AS nt FROM r)
    SELECT key, l_returnflag, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + ceil(round((n - nt) * 0.25, 9)) THEN 'calibration' ELSE 'train' END AS part FROM t""")
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.three_way_split(line(spark, sf_dir).select("key", "l_returnflag"), "key", SEED, "l_returnflag").select("key", "l_returnflag", "part")


@job(f"""
    WITH g AS (SELECT DISTINCT l_partkey AS g FROM lineitem), r AS (SELECT g, row_number() OVER (ORDER BY {_uniform("g", SEED, "group")}, g) AS rn, count(*) OVER () AS n FROM g)
    SELECT l_partkey, CASE WHEN rn <= ceil(round(n * 0.2, 9)) THEN 'test' ELSE 'train' END AS part, count(*) AS n_rows FROM lineitem JOIN r ON g = l_partkey GROUP BY 1, 2""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.grouped_split(read(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey", SEED).groupBy("l_partkey", "part").agg(F.count("*").alias("n_rows"))


@job("""
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN rn <= floor(round(n * 0.8, 9)) THEN 'train' ELSE 'test' END AS part FROM r""")
def time_ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.time_ordered_split(read(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", ["o_orderkey"]).select("o_orderkey", "part")


@job(f"""
    WITH {LINE_SQL}, s AS (SELECT key, l_partkey, CASE WHEN {_U_SPLIT} < 0.2 THEN 'test' WHEN {_U_SPLIT} < 0.4 THEN 'calibration' ELSE 'train' END AS part FROM line)
    SELECT count(*) AS n, count(DISTINCT key) AS n_keys, count(DISTINCT key || part) - count(DISTINCT key) AS n_in_two_parts, count(*) FILTER (part = 'test') AS n_test, count(*) FILTER (part = 'calibration') AS n_calibration FROM s""")
def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are disjoint and complete: set operations on the parts themselves."""
    df = line(spark, sf_dir).select("key")
    parts = df.withColumn("part", split.threshold_split("key", SEED))
    test, calibration, train = (parts.where(F.col("part") == p).select("key") for p in ("test", "calibration", "train"))
    shared = test.intersect(calibration).union(test.intersect(train)).union(calibration.intersect(train))
    left = df.exceptAll(test.unionAll(calibration).unionAll(train))
    counts = parts.agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.count_if(F.col("part") == "test").alias("n_test"), F.count_if(F.col("part") == "calibration").alias("n_calibration"))
    outside = shared.unionAll(left).agg(F.count("*").alias("n_in_two_parts"))
    return counts.crossJoin(outside)  # one row each


@job(f"WITH {LINE_SQL}, r AS (SELECT key, {_rank_sql('l_returnflag', 'fold')}) SELECT key, (rn % 5)::INT AS fold FROM r")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.cv_folds(line(spark, sf_dir).select("key", "l_returnflag"), "key", SEED, 5, stratum="l_returnflag").select("key", "fold")


@job(f"""
    WITH {LINE_SQL}, o AS (SELECT key, row_number() OVER (ORDER BY l_shipdate, key) AS rn, count(*) OVER () AS n FROM line)
    SELECT key, greatest(floor((rn - 1 - (n - 5 * (n // 6))) / (n // 6)), -1)::INT AS fold FROM o""")
def cv_folds_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds in the order of time."""
    return split.cv_folds(line(spark, sf_dir).select("key", "l_shipdate"), "key", SEED, 5, time="l_shipdate").select("key", "fold")


@job(f"""
    WITH g AS (SELECT DISTINCT l_partkey AS g FROM lineitem), r AS (SELECT g, row_number() OVER (ORDER BY {_uniform("g", SEED, "fold")}, g) AS rn FROM g)
    SELECT l_partkey, (rn % 5)::INT AS fold, count(*) AS n_rows FROM lineitem JOIN r ON g = l_partkey GROUP BY 1, 2""")
def cv_folds_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = split.cv_folds(read(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey", SEED, 5, group="l_partkey")
    return folded.groupBy("l_partkey", "fold").agg(F.count("*").alias("n_rows"))


_FOLDED = f"{LINE_SQL}, r AS (SELECT *, {_rank_sql('l_returnflag', 'fold')}), f AS (SELECT *, (rn % 5)::INT AS fold FROM r)"


def _group_mean_cv(df: DataFrame, group: str) -> DataFrame:
    """Score of a group-mean model in every fold. A group's training mean follows from its totals less its fold's."""
    cells = df.groupBy(group, "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    w = Window.partitionBy(group)
    fitted = cells.withColumn("fit", (F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n")))
    error = F.sum(F.col("ss") - 2 * F.col("fit") * F.col("s") + F.col("n") * F.col("fit") * F.col("fit"))
    return fitted.groupBy("fold").agg(F.sum("n").alias("n"), (1 - error / (F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n"))).alias("r2"))


@job(f"""
    WITH {_FOLDED}, c AS (SELECT o_orderpriority AS g, fold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM f GROUP BY 1, 2),
    m AS (SELECT *, (sum(s) OVER (PARTITION BY g) - s) / (sum(n) OVER (PARTITION BY g) - n) AS fit FROM c)
    SELECT fold, sum(n)::BIGINT AS n, round(1 - sum(ss - 2 * fit * s + n * fit * fit) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS r2 FROM m GROUP BY 1""")
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split.cv_folds(line(spark, sf_dir).select("key", "l_returnflag", "o_orderpriority", "y"), "key", SEED, 5, stratum="l_returnflag")
    return _group_mean_cv(df, "o_orderpriority").withColumn("r2", rounded("r2"))


_NESTED_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS candidate, {c} AS g, fold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM f GROUP BY ALL" for c in ("l_returnflag", "o_orderpriority", "p_type"))


@job(f"""
    WITH {_FOLDED}, c AS ({_NESTED_CELLS}), o AS (SELECT unnest(range(5))::INT AS outer_fold),
    i AS (SELECT candidate, g, outer_fold, fold, n, s, ss, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS fit FROM c JOIN o ON fold <> outer_fold WINDOW w AS (PARTITION BY candidate, g, outer_fold)),
    q AS (SELECT candidate, outer_fold, fold, 1 - sum(ss - 2 * fit * s + n * fit * fit) / (sum(ss) - sum(s) * sum(s) / sum(n)) AS r2 FROM i GROUP BY ALL),
    b AS (SELECT candidate, outer_fold, avg(r2) AS r2 FROM q GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY round(r2, 9) DESC, candidate) AS nth FROM b)
    SELECT outer_fold, candidate, round(r2, 6) AS inner_r2, count(*) OVER (PARTITION BY candidate) AS n_chosen FROM p WHERE nth = 1""")
def nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that the inner folds choose for each outer fold; all from one table of cells."""
    df = split.cv_folds(line(spark, sf_dir).select("key", "l_returnflag", "o_orderpriority", "p_type", "y"), "key", SEED, 5, stratum="l_returnflag")
    long = unpivot(df, ["fold", "y"], ["l_returnflag", "o_orderpriority", "p_type"], "candidate", "g")
    y = F.col("y")
    cells = long.groupBy("candidate", "g", "fold").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    inner = cells.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> outer_fold")
    w = Window.partitionBy("candidate", "g", "outer_fold")
    rest = F.sum("n").over(w) - F.col("n")
    fitted = inner.withColumn("fit", F.when(rest > 0, (F.sum("s").over(w) - F.col("s")) / rest))
    error = F.sum(F.col("ss") - 2 * F.col("fit") * F.col("s") + F.col("n") * F.col("fit") * F.col("fit"))
    scores = fitted.groupBy("candidate", "outer_fold", "fold").agg((1 - error / (F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n"))).alias("r2"))
    mean = scores.groupBy("candidate", "outer_fold").agg(F.avg("r2").alias("r2"))
    nth = F.row_number().over(Window.partitionBy("outer_fold").orderBy(F.desc(F.round("r2", 9)), "candidate"))
    chosen = mean.withColumn("nth", nth).where("nth = 1")  # a row for each outer fold
    return chosen.select("outer_fold", "candidate", rounded("r2").alias("inner_r2"), F.count("*").over(Window.partitionBy("candidate")).alias("n_chosen"))


@job(f"WITH {LINE_SQL} SELECT key, round(signal, 6) AS signal FROM line")
def latent_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line(spark, sf_dir).select("key", rounded(MODEL.signal()).alias("signal"))


@job(f"WITH {LINE_SQL} SELECT key, round(pred, 6) AS y_pred, round(1 / (1 + exp(-(pred - 36) / 5)), 6) AS y_pred_proba FROM line")
def score_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line(spark, sf_dir).select("key", rounded(SCORER.signal()).alias("y_pred"), rounded(1 / (1 + F.exp(-(SCORER.signal() - 36) / 5))).alias("y_pred_proba"))


@job(f"""
    WITH {LINE_SQL}, g AS (SELECT p_size AS v, count(*) AS c FROM line GROUP BY 1), r AS (SELECT v, (sum(c) OVER (ORDER BY v) - c + (c + 1) / 2) / sum(c) OVER () AS pct FROM g WHERE v IS NOT NULL)
    SELECT key, round(coalesce(pct, 0.5), 6) AS pct_rank FROM line LEFT JOIN r ON p_size = v""")
def average_pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-tie rank over n, from the distinct values."""
    df = line(spark, sf_dir)
    return df.join(average_ranks(df, "p_size"), "p_size", "left").select("key", rounded(F.coalesce("pct", F.lit(0.5))).alias("pct_rank"))


_CUT_SQL = "c AS (SELECT quantile_cont(signal, 0.5102040816326531) AS c1, quantile_cont(signal, 0.8163265306122449) AS c2 FROM line)"
#: Cumulative weights of three classes whose weights fall by 0.6 each.
_CUM = (1 / 1.96, 1.6 / 1.96)


def _cut_points(df: DataFrame) -> list[float]:
    return exact_quantiles(df, ["signal"], _CUM)["signal"]


@job(f"WITH {LINE_SQL}, {_CUT_SQL} SELECT key, ((signal >= c1)::INT + (signal >= c2)::INT) AS label FROM line, c")
def class_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line(spark, sf_dir)
    return df.select("key", digitize(F.col("signal"), _cut_points(df)).alias("label"))


@job(f"""
    WITH {LINE_SQL}, {_CUT_SQL}, d AS (SELECT key, ((signal >= c1)::INT + (signal >= c2)::INT) AS label, round(abs(signal - c1), 9) AS d1, round(abs(signal - c2), 9) AS d2 FROM line, c),
    r AS (SELECT *, row_number() OVER (ORDER BY least(d1, d2), key) AS rn, count(*) OVER () AS n FROM d)
    SELECT key, CASE WHEN rn > round(0.02 * n) THEN label WHEN d1 <= d2 THEN CASE WHEN label = 0 THEN 1 ELSE 0 END ELSE CASE WHEN label = 2 THEN 1 ELSE 2 END END AS label FROM r""")
def boundary_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows nearest to a cut get the class on the other side of it."""
    df = line(spark, sf_dir)
    cuts = _cut_points(df)
    d1, d2 = F.round(F.abs(F.col("signal") - cuts[0]), 9), F.round(F.abs(F.col("signal") - cuts[1]), 9)
    rows = df.select("key", digitize(F.col("signal"), cuts).alias("label"), d1.alias("d1"), d2.alias("d2")).withColumn("near", F.least("d1", "d2"))
    numbered, n = global_row_number(rows, "near", ["key"]), df.count()
    label = F.col("label")
    other = F.when(F.col("d1") <= F.col("d2"), F.when(label == 0, 1).otherwise(0)).otherwise(F.when(label == 2, 1).otherwise(2))
    return numbered.select("key", F.when(F.col("rn") <= round(0.02 * n), other).otherwise(label).alias("label"))


_CONFOUNDER = f"(sqrt(-2 * ln(greatest({_uniform('key', SEED, 'confounder.u')}, 1e-12))) * cos(2 * pi() * {_uniform('key', SEED, 'confounder.v')}))"


@job(f"""
    WITH {LINE_SQL}, v AS (SELECT var_pop(signal) AS v, stddev_pop(2.5 * {_CONFOUNDER}) AS raw FROM line), b AS (SELECT v, raw, v * (1 - 0.74) / 0.74 AS budget FROM v), s AS (SELECT *, sqrt(budget * (1 - 0.4)) AS sigma FROM b)
    SELECT round(v, 6) AS signal_variance, round(sigma, 6) AS sigma, round(sigma * sqrt(0.4 / 0.6) / raw, 6) AS confounder_scale, round(budget * 0.4, 6) AS confounder_variance, round(v / (v + budget), 6) AS ceiling FROM s""")
def calibrate_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise that brings a declared r2 about: a budget of variance, part of it for a confounder of any raw spread."""
    found = noise.regression_budget(line(spark, sf_dir), F.col("signal"), 2.5 * hash_normal("key", SEED, "confounder"), 0.74, 0.4)
    return found.select(*[rounded(c).alias(c) for c in ("signal_variance", "sigma", "confounder_scale", "confounder_variance", "ceiling")])


@job()
def calibrate_noise_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise at which a declared share of rows keeps its class, found by bisection."""
    return noise.classification_sigma(line(spark, sf_dir), F.col("signal"), hash_normal("key", SEED, "target"), list(_CUM), 0.84)


_BM = f"(sqrt(-2 * ln(greatest({_uniform('key', SEED, 'target.u')}, 1e-12))) * cos(2 * pi() * {_uniform('key', SEED, 'target.v')}))"


_ATTACHED_SQL = f"""
    g AS (SELECT p_size AS v, count(*) AS c FROM line GROUP BY 1), r AS (SELECT v, (sum(c) OVER (ORDER BY v) - c + (c + 1) / 2) / sum(c) OVER () AS pct FROM g WHERE v IS NOT NULL),
    m AS (SELECT line.*, pow(1.5, 2 * coalesce(pct, 0.5) - 1) AS m FROM line LEFT JOIN r ON p_size = v), s AS (SELECT sqrt(avg(m * m)) AS s FROM m),
    n AS (SELECT m.*, 1.5 * {_CONFOUNDER} AS confounder, signal + 1.5 * {_CONFOUNDER} + {SIGMA} * m / s * {_BM} AS score FROM m, s)"""


def _hidden() -> Column:
    return 1.5 * hash_normal("key", SEED, "confounder")


def _attached(df: DataFrame) -> DataFrame:
    """df with score: signal, a confounder, and noise that grows with a driver's rank, its mean square kept at one."""
    df = stored(df)
    spread = df.join(average_ranks(df, "p_size"), "p_size", "left").withColumn("m", F.pow(F.lit(1.5), 2 * F.coalesce("pct", F.lit(0.5)) - 1))
    scale = spread.agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("s"))  # one row
    noisy = F.col("signal") + _hidden() + SIGMA * F.col("m") / F.col("s") * hash_normal("key", SEED, "target")
    return spread.join(F.broadcast(scale)).withColumn("score", noisy)


@job(f"""
    WITH {LINE_SQL}, {_ATTACHED_SQL}, c AS (SELECT quantile_cont(score, {_CUM[0]}) AS c1, quantile_cont(score, {_CUM[1]}) AS c2 FROM n)
    SELECT key, round(least(greatest(score, 0), 100), 5) AS target, ((score >= c1)::INT + (score >= c2)::INT) AS label FROM n, c""")
def attach_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal, a confounder, and noise that grows with a driver's rank, its mean square kept at one; cut into classes too."""
    scored = stored(_attached(line(spark, sf_dir).select("key", "p_size", "signal")).select("key", "score"))
    cuts = exact_quantiles(scored, ["score"], _CUM)["score"]
    return scored.select("key", F.round(F.least(F.greatest("score", F.lit(0.0)), F.lit(100.0)), 5).alias("target"), digitize(F.col("score"), cuts).alias("label"))


@job(f"WITH {LINE_SQL}, {HOLES_SQL} SELECT key, round(l_tax, 6) AS l_tax FROM holed")
def inject_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holes(line(spark, sf_dir)).select("key", rounded("l_tax").alias("l_tax"))


_REPORTED = replace(LINE, target=Feature("target", "numeric"))
_FIGURES = ("signal_variance", "confounder_variance", "noise_variance", "noise_to_signal", "confounder_share", "ceiling", "oracle_r2", "headroom", "heteroscedasticity")
_MISSING_SQL = ", ".join(f"CASE WHEN count({f.name}) < count(*) THEN '{f.name}=' || printf('%.6f', round(1 - count({f.name}) / count(*), 6)) END" for f in LINE.features)


@job(f"""
    WITH {LINE_SQL}, {_ATTACHED_SQL}, holed AS (
        SELECT * REPLACE (CASE WHEN {_uniform("key", SEED, "hole.l_tax")} >= CASE WHEN l_linestatus = 'O' THEN 0.08 ELSE 0.03 END THEN l_tax END AS l_tax,
            {SIGNAL_SQL} AS signal), least(greatest(score, 0), 100) AS target, signal AS clamped FROM n),
    q AS (SELECT max(v) FILTER (pct <= 0.25) AS lo, min(v) FILTER (pct >= 0.75) AS hi FROM r),
    e AS (SELECT *, target - signal AS e, target - signal - confounder AS rest FROM holed),
    v AS (SELECT count(*) AS n, concat_ws(',', {_MISSING_SQL}) AS missing, var_pop(signal) AS sv, var_pop(confounder) AS cv, var_pop(rest) AS nv,
        1 - sum((target - clamped) * (target - clamped)) / (count(*) * var_pop(target)) AS oracle, 1 - sum((target - pred) * (target - pred)) / (count(*) * var_pop(target)) AS got,
        stddev_samp(e) FILTER (p_size >= hi) / stddev_samp(e) FILTER (p_size <= lo) AS spread FROM e, q)
    SELECT n, missing, round(sv, 6) AS signal_variance, round(cv, 6) AS confounder_variance, round(nv, 6) AS noise_variance, round(sqrt((cv + nv) / sv), 6) AS noise_to_signal,
        round(cv / (sv + cv + nv), 6) AS confounder_share, round(sv / (sv + cv + nv), 6) AS ceiling, round(oracle, 6) AS oracle_r2, round(got / oracle, 6) AS headroom, round(spread, 6) AS heteroscedasticity,
        'l_quantity,l_discount,p_size,l_returnflag,o_orderpriority,l_linestatus' AS driven, 'l_tax' AS undriven, '' AS turning, 2::BIGINT AS n_interactions, 'route' AS confounders FROM v""")
def realism_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drives the target that attach_target made, how wide the rest is and where, and how much a hidden cause has of it."""
    df = line(spark, sf_dir).select("key", *[f.name for f in LINE.features], "signal", "pred")
    df = holes(_attached(df)).withColumn("target", F.least(F.greatest("score", F.lit(0.0)), F.lit(100.0)))
    found = realism.realism_report(df, _REPORTED, MODEL, {"route": _hidden()}, "p_size", F.col("pred"))
    return found.select("n", "missing", *[rounded(c).alias(c) for c in _FIGURES], "driven", "undriven", "turning", "n_interactions", "confounders")


@job("""
    WITH c AS (SELECT quality AS level, count(*) AS c FROM labels WHERE quality IS NOT NULL GROUP BY 1), b AS (SELECT string_agg(level || '=' || c, ',' ORDER BY level) AS class_balance, round(max(c) / sum(c), 6) AS majority_share FROM c)
    SELECT n, missing, class_balance, majority_share FROM (SELECT count(*) AS n, concat_ws(',', CASE WHEN count(toxic) < count(*) THEN 'toxic=' || printf('%.6f', round(1 - count(toxic) / count(*), 6)) END) AS missing FROM labels), b""")
def realism_report_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a labelled table without a model: what is missing and how classes are balanced, and nothing guessed."""
    problem = Problem((Feature("toxic", "numeric", nullable=True),), Feature("quality", "categorical", ("0", "1")))
    return realism.realism_report(read(spark, sf_dir, "labels"), problem, None).withColumn("majority_share", rounded("majority_share"))


@job("""
    WITH l AS (SELECT count(*) AS n_lines, count(l_quantity) FILTER (l_linestatus = 'F') AS n_labelled, round(avg((l_returnflag = 'R')::INT), 6) AS returned_share FROM lineitem), o AS (SELECT count(*) AS n_orders FROM orders), p AS (SELECT count(*) AS n_parts FROM part)
    SELECT n_lines, n_orders, n_parts, n_labelled, returned_share FROM l, o, p""")
def generation_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_linestatus") == "F").alias("n_labelled"), rounded(F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("returned_share"))
    orders, parts = (read(spark, sf_dir, t).agg(F.count("*").alias(n)) for t, n in (("orders", "n_orders"), ("part", "n_parts")))
    return lines.crossJoin(orders).crossJoin(parts).select("n_lines", "n_orders", "n_parts", "n_labelled", "returned_share")


_NOVEL_SQL = f"synth AS (SELECT CASE WHEN {_uniform('key', SEED, 'novel')} < 0.3 THEN l_quantity + 100 ELSE l_quantity END AS l_quantity, round(l_discount, 2) AS l_discount, l_returnflag, p_size FROM line)"


@job(f"""
    WITH {LINE_SQL}, {_NOVEL_SQL}, d AS (SELECT DISTINCT l_quantity, round(l_discount, 2) AS l_discount, l_returnflag, p_size FROM line)
    SELECT count(*) AS n, round(avg((NOT EXISTS (SELECT 1 FROM d WHERE d.l_quantity = s.l_quantity AND d.l_discount = s.l_discount AND d.l_returnflag = s.l_returnflag AND d.p_size IS NOT DISTINCT FROM s.p_size))::INT), 6) AS novelty FROM synth s""")
def novel_row_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, columns = line(spark, sf_dir).withColumn("l_discount", F.round("l_discount", 2)), ["l_quantity", "l_discount", "l_returnflag", "p_size"]
    synthetic = real.withColumn("l_quantity", F.when(hash_uniform("key", SEED, "novel") < 0.3, F.col("l_quantity") + 100).otherwise(F.col("l_quantity"))).select(*columns)
    return synth.novelty(real.select(*columns), synthetic, columns)


_NUMBERS, _LEVELS = ("l_quantity", "l_discount", "p_size"), ("l_returnflag", "o_orderpriority")
_BOTH_SQL = f"""b AS (SELECT 'real' AS side, {", ".join(_NUMBERS + _LEVELS)} FROM line UNION ALL
    SELECT 'synthetic', CASE WHEN {_uniform("key", SEED, "q")} < 0.2 THEN 50 ELSE l_quantity END, CASE WHEN {_uniform("key", SEED, "d")} < 0.1 THEN 0.12 ELSE l_discount END,
        p_size, CASE WHEN {_uniform("key", SEED, "f")} < 0.1 THEN 'A' ELSE l_returnflag END, o_orderpriority FROM line),
    z AS (SELECT count(*) FILTER (side = 'real') AS nr, count(*) FILTER (side = 'synthetic') AS ns, {", ".join(f"min({c}) FILTER (side = 'real') AS lo_{c}, max({c}) FILTER (side = 'real') AS hi_{c}" for c in _NUMBERS)} FROM b)"""


def _sides_sql(value: str, where: str = "true") -> str:
    return f"SELECT {value}, count(*) FILTER (side = 'real') AS r, count(*) FILTER (side = 'synthetic') AS s FROM b, z WHERE {where} GROUP BY ALL"


def _cell_sql(c: str) -> str:
    bins = f"CASE WHEN {c} < lo_{c} THEN -1 WHEN {c} > hi_{c} THEN {synth.BINS} WHEN {c} IS NOT NULL THEN least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {synth.BINS}), {synth.BINS - 1})::INT END"
    return c if c in _LEVELS else bins


def _pair_sql(a: str, b: str) -> str:
    if b in _NUMBERS:
        return f"SELECT '{a}' AS a, '{b}' AS b, 'numbers' AS kind, 1 - abs(corr({a}, {b}) FILTER (side = 'real') - corr({a}, {b}) FILTER (side = 'synthetic')) / 2 AS score FROM b"
    cells = _sides_sql(f"{_cell_sql(a)} AS va, {b} AS vb")
    return f"SELECT '{a}', '{b}', '{'levels' if a in _LEVELS else 'mixed'}', 1 - sum(abs(r / nr - s / ns)) / 2 FROM ({cells}), z"


_SHAPES_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, 1 - max(abs(fr - fs)) AS score FROM (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS fr, sum(s) OVER (ORDER BY v) / sum(s) OVER () AS fs FROM ({_sides_sql(f'{c} AS v', f'{c} IS NOT NULL')}))" for c in _NUMBERS]
    + [f"SELECT '{c}', 1 - sum(abs(r / tr - s / ts)) / 2 FROM (SELECT *, sum(r) OVER () AS tr, sum(s) OVER () AS ts FROM ({_sides_sql(f'{c} AS v', f'{c} IS NOT NULL')}))" for c in _LEVELS]
)
_PAIRS_SQL = " UNION ALL ".join(_pair_sql(a, b) for a, b in combinations(_NUMBERS + _LEVELS, 2))
_SAME_ROW = " AND ".join(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in _NUMBERS + _LEVELS)


def _real_and_synthetic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df, columns = line(spark, sf_dir), [*_NUMBERS, *_LEVELS]
    changes = {"l_quantity": ("q", 0.2, 50.0), "l_discount": ("d", 0.1, 0.12), "l_returnflag": ("f", 0.1, "A")}
    changed = {c: F.when(hash_uniform("key", SEED, s) < p, v).otherwise(F.col(c)) for c, (s, p, v) in changes.items()}
    kept = stored(df.select(*columns, *[c.alias(f"_{name}") for name, c in changed.items()]))  # a row is compared in several ways
    return kept.select(*columns), kept.select(*[F.col(f"_{c}").alias(c) if c in changed else F.col(c) for c in columns])


@job(f"WITH {LINE_SQL}, {_BOTH_SQL}, p AS ({_PAIRS_SQL}) SELECT a, b, kind, round(score, 6) AS score FROM p")
def synthetic_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each pair of columns keeps together: correlations, or joint counts."""
    return synth.pair_trends(*_real_and_synthetic(spark, sf_dir)).withColumn("score", rounded("score"))


@job(f"""
    WITH {LINE_SQL}, {_BOTH_SQL}, h AS (SELECT avg(score) AS shape FROM ({_SHAPES_SQL})), p AS (SELECT avg(score) AS pair FROM ({_PAIRS_SQL})),
    w AS (SELECT round(avg((NOT EXISTS (SELECT 1 FROM b r WHERE r.side = 'real' AND {_SAME_ROW}))::INT), 6) AS novelty FROM b s WHERE side = 'synthetic'), q AS (SELECT *, (shape + pair) / 2 AS quality FROM h, p, w)
    SELECT round(shape, 6) AS shape_score, round(pair, 6) AS pair_score, round(quality, 6) AS quality, novelty, CASE WHEN novelty < 0.9 AND quality > 0.85 THEN 'copying' WHEN novelty >= 0.9 AND quality < 0.6 THEN 'inventing' END AS note FROM q""")
def synthetic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of all columns, trends of all pairs, and how many rows are new."""
    return synth.quality_report(*_real_and_synthetic(spark, sf_dir))


@job(f"""
    WITH {LINE_SQL}, w AS (SELECT key, pred AS base, least(greatest(pred - 5.0 * ln(1 + l_discount / 0.05) + 5.0 * ln(1 + 0.1 / 0.05), 0), 100) AS changed FROM line)
    SELECT key, round(base, 6) AS base, round(changed, 6) AS changed, round(changed - base, 6) AS delta, abs(changed - base) <= 10 AS intervals_overlap FROM w""")
def whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score as it is and with overridden inputs, and whether intervals of half-width 5 overlap."""
    df = line(spark, sf_dir).withColumn("base", SCORER.signal()).withColumn("l_discount", F.lit(0.1)).withColumn("changed", SCORER.signal())
    delta = F.col("changed") - F.col("base")
    return df.select("key", rounded("base").alias("base"), rounded("changed").alias("changed"), rounded(delta).alias("delta"), (F.abs(delta) <= 10).alias("intervals_overlap"))


@job(f"""
    WITH {LINE_SQL}, m AS (SELECT s.seed, count(*) AS n, 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS r2
        FROM line, (VALUES ({SEED}), ({SEED + 1})) s(seed) WHERE ('0x' || substr(md5(key || ':' || seed || ':split'), 1, 8))::BIGINT / 4294967296.0 < 0.2 GROUP BY 1)
    SELECT a.n AS n_test, round(a.r2, 6) AS registered_r2, round(b.r2, 6) AS other_seed_r2, abs(a.r2 - a.r2) < 1e-9 AS reproduced, abs(a.r2 - b.r2) >= 1e-9 AS other_seed_refused FROM m a, m b WHERE a.seed = {SEED} AND b.seed = {SEED + 1}""")
def rescore_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame and its metric are frozen; read back, the held-out rows of the seed must give the metric, those of another not."""
    frozen = io.freeze(line(spark, sf_dir).select("key", "y", "pred"), fresh_path(spark, "frozen-frame"))
    registered = io.freeze(split.score_holdout(frozen, "key", "y", "pred", SEED).coalesce(1), fresh_path(spark, "registered"))
    again, other = (split.score_holdout(frozen, "key", "y", "pred", s).select(F.col("r2").alias(n)) for s, n in ((SEED, "again"), (SEED + 1, "other")))
    one = registered.crossJoin(again).crossJoin(other)  # one row each
    return one.select("n_test", rounded("r2").alias("registered_r2"), rounded("other").alias("other_seed_r2"), (F.abs(F.col("r2") - F.col("again")) < 1e-9).alias("reproduced"), (F.abs(F.col("r2") - F.col("other")) >= 1e-9).alias("other_seed_refused"))


def _series_sql(freq: str, unit: str, table: str, name: str, time: str) -> str:
    return f"""SELECT '{freq}' AS freq, s.unique_id, s.ds, coalesce(p.y, 0.0) AS y FROM
        (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 {unit})) AS ds FROM (SELECT {name} AS unique_id, date_trunc('{unit}', {time})::TIMESTAMP AS ds FROM {table}) GROUP BY 1) s
        LEFT JOIN (SELECT {name} AS unique_id, date_trunc('{unit}', {time})::TIMESTAMP AS ds, count(*)::DOUBLE AS y FROM {table} GROUP BY 1, 2) p USING (unique_id, ds)"""


@job(" UNION ALL ".join([_series_sql("h", "hour", "events", "event_type", "ts"), *(_series_sql(f, u, "orders", "o_orderpriority", "o_orderdate") for f, u in (("D", "day"), ("W", "week"), ("MS", "month")))]))
def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour, and orders a day, a week from Monday and a month, periods without any as 0."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("unique_id"), F.col("ts"), F.lit(1.0).alias("y"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("unique_id"), F.col("o_orderdate").alias("ts"), F.lit(1.0).alias("y"))
    made = forecast.event_series(events, "ts", "h")
    for freq in ("D", "W", "MS"):
        made = made.unionByName(forecast.event_series(orders, "ts", freq))
    return made


def _lags_sql(freq: str, season: int, horizon: int, frame: str) -> str:
    parts = {"hour": "hour(ds)::INT", "dayofweek": "(isodow(ds) - 1)::INT", "week": "week(ds)::INT", "month": "month(ds)::INT", "quarter": "quarter(ds)::INT"}
    wanted = forecast.DATE_PARTS[freq]
    lags = ", ".join(f"CASE WHEN {k} <= longest THEN lag(y, {k}) OVER o END AS {name}" for k, name in ((1, "lag1"), (2, "lag2"), (3, "lag3"), (season, "lag_season"), (season + 1, "lag_season1"), (2 * season, "lag_season2")))
    dates = ", ".join(f"{e if n in wanted else 'NULL::INT'} AS {n}" for n, e in parts.items())
    return f"""SELECT '{freq}' AS freq, unique_id, ds, {lags}, round(avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN w PRECEDING AND 1 PRECEDING), 6) AS rolling_mean, {dates}
        FROM (SELECT *, greatest(1, floor((n - {2 * horizon}) / 3)) AS longest, greatest(2, least({season}, greatest(2, n // 6)))::BIGINT AS w FROM (SELECT *, count(*) OVER (PARTITION BY unique_id) AS n FROM ({frame}))) WINDOW o AS (PARTITION BY unique_id ORDER BY ds)"""


_FREQUENCIES = {"h": (24, 24), "D": (7, 7), "W": (52, 8), "MS": (12, 6)}


@job(" UNION ALL ".join(_lags_sql(f, *_FREQUENCIES[f], _series_sql(f, u, t, n, c)) for f, u, t, n, c in (("h", "hour", "events", "event_type", "ts"), ("D", "day", "orders", "o_orderpriority", "o_orderdate"), ("W", "week", "orders", "o_orderpriority", "o_orderdate"), ("MS", "month", "orders", "o_orderpriority", "o_orderdate"))))
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, rolling means and parts of the date that suit each frequency."""
    every, made = event_series(spark, sf_dir), None
    for freq, (season, horizon) in _FREQUENCIES.items():
        one = forecast.lag_features(every.where(F.col("freq") == freq).drop("freq"), season, horizon, freq)
        one = one.withColumnsRenamed({f"lag{2 * season}": "lag_season2", f"lag{season + 1}": "lag_season1", f"lag{season}": "lag_season"}).select(F.lit(freq).alias("freq"), "*").drop("y", "n")
        made = one if made is None else made.unionByName(one, allowMissingColumns=True)
    return made.withColumn("rolling_mean", rounded("rolling_mean"))


_ORIGIN = f"""{SERIES_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM series),
    w AS (SELECT *, n - (3 - k) * 14 AS cutoff FROM i, (SELECT unnest(range(3)) AS k) WHERE n >= 44)"""


@job(f"""
    WITH {_ORIGIN} SELECT unique_id, k::INT AS "window", CASE WHEN i < cutoff THEN 'train' ELSE 'score' END AS part, count(*) AS n, min(ds) AS first, max(ds) AS last FROM w WHERE i < cutoff + 14 GROUP BY 1, 2, 3""")
def rolling_origin_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forecast.rolling_origin(series(spark, sf_dir), 14, 3)
    return found.groupBy("unique_id", "window", "part").agg(F.count("*").alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last"))


@job(f"""
    WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM series)
    SELECT unique_id, s.step::INT AS step, y AS forecast FROM r JOIN (SELECT unnest(range(1, 15)) AS step) s ON (step - 1) % 7 = 7 - back WHERE back <= 7""")
def seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.seasonal_naive(series(spark, sf_dir), 7, 14)


_BACK = f"""{_ORIGIN}, b AS (SELECT w.unique_id, w.k, w.ds, w.y, i.y AS forecast FROM w JOIN i ON i.unique_id = w.unique_id AND i.i = w.i - ceil((w.i - w.cutoff + 1) / 7) * 7 WHERE w.i >= w.cutoff AND w.i < w.cutoff + 14),
    e AS (SELECT unique_id, k, avg(CASE WHEN abs(forecast) + abs(y) < 1e-9 THEN 0 ELSE 200 * abs(forecast - y) / (abs(forecast) + abs(y)) END) AS smape,
        CASE WHEN NOT bool_or(abs(y) < 1e-9) THEN avg(CASE WHEN abs(y) >= 1e-9 THEN 100 * abs((forecast - y) / y) END) END AS mape, avg(abs(forecast - y)) AS mae FROM b GROUP BY 1, 2)"""


@job(f'WITH {_BACK} SELECT unique_id, k::INT AS "window", round(smape, 6) AS smape, round(mape, 6) AS mape, round(mae, 6) AS mae FROM e')
def forecast_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = forecast.backtest_seasonal_naive(series(spark, sf_dir), 7, 14, 3)
    return scored.groupBy("unique_id", "window").agg(*[rounded(c).alias(n) for n, c in forecast.error_metrics().items()])


@job(f"""
    WITH {_ORIGIN}, c AS (SELECT unnest([1, 7, 14, 28]) AS season), b AS (SELECT 'naive-' || season AS model, w.y, i.y AS forecast FROM w, c JOIN i ON i.unique_id = w.unique_id AND i.i = w.i - ceil((w.i - w.cutoff + 1) / season) * season WHERE w.i >= w.cutoff AND w.i < w.cutoff + 14),
    e AS (SELECT model, avg(CASE WHEN abs(forecast) + abs(y) < 1e-9 THEN 0 ELSE 200 * abs(forecast - y) / (abs(forecast) + abs(y)) END) AS smape, avg(abs(forecast - y)) AS mae FROM b GROUP BY 1)
    SELECT model, round(smape, 6) AS smape, round(mae, 6) AS mae, row_number() OVER (ORDER BY smape, mae, model) AS place, round((SELECT min(smape) FROM e o WHERE o.model <> e.model) - smape, 6) AS margin FROM e""")
def rank_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, found = series(spark, sf_dir), None
    for season in (1, 7, 14, 28):
        one = forecast.backtest_seasonal_naive(df, season, 14, 3).withColumn("model", F.lit(f"naive-{season}"))
        found = one if found is None else found.unionByName(one)
    errors = forecast.error_metrics()
    scored = found.groupBy("model").agg(errors["smape"].alias("smape"), errors["mae"].alias("mae"))
    return forecast.rank_forecasts(scored).select("model", rounded("smape").alias("smape"), rounded("mae").alias("mae"), "place", rounded("margin").alias("margin"))


@job(f"""
    WITH {_BACK}, a AS (SELECT unique_id, abs(y - forecast) AS s, row_number() OVER (PARTITION BY unique_id ORDER BY abs(y - forecast)) AS r, count(*) OVER (PARTITION BY unique_id) AS n FROM b WHERE k < 2),
    h AS (SELECT unique_id, min(s) AS width FROM a WHERE r = ceil(round(least(1.0, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1), 9)) + 1 GROUP BY 1)
    SELECT unique_id, width, 0.9::DOUBLE AS requested, round(avg((abs(y - forecast) <= width)::INT), 6) AS measured, round(avg(abs(y - forecast)), 6) AS mae FROM b JOIN h USING (unique_id) WHERE k = 2 GROUP BY 1, 2""")
def forecast_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conformal band from the earlier windows' errors, its coverage measured on the last one."""
    scored = forecast.backtest_seasonal_naive(series(spark, sf_dir), 7, 14, 3).withColumn("s", F.abs(F.col("y") - F.col("forecast")))
    earlier, w = scored.where(F.col("window") < 2), Window.partitionBy("unique_id")
    n = F.col("n")
    level = F.least(F.lit(1.0), F.ceil(F.round((n + 1) * 0.9, 9)) / n)
    ranked = earlier.withColumn("r", F.row_number().over(w.orderBy("s"))).withColumn("n", F.count("*").over(w))
    widths = ranked.where(F.col("r") == F.ceil(F.round(level * (n - 1), 9)) + 1).select("unique_id", F.col("s").alias("width"))
    last = scored.where(F.col("window") == 2).join(widths, "unique_id")
    return last.groupBy("unique_id", "width").agg(F.lit(0.9).alias("requested"), rounded(F.avg((F.col("s") <= F.col("width")).cast("double"))).alias("measured"), rounded(F.avg("s")).alias("mae"))
