"""Jobs on metrics, calibration, coverage, slices and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform, rounded, unpivot
from ..functions.ranks import exact_quantiles, global_row_number
from ..functions.storage import stored
from ..operators import measure
from .frames import CLASS_SQL, CLASSES, LINE_SQL, SEED, _uniform, classes, line, read
from .registry import job

_CLS = f"{LINE_SQL}, {CLASS_SQL}"
_PART = "CASE WHEN {u} < 0.2 THEN 'test' WHEN {u} < 0.4 THEN 'calibration' ELSE 'train' END".format(u=_uniform("key", SEED, "split"))


def cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(line(spark, sf_dir))


def with_part(df: DataFrame) -> DataFrame:
    u = hash_uniform("key", SEED, "split")
    return df.withColumn("part", F.when(u < 0.2, "test").when(u < 0.4, "calibration").otherwise("train"))


@job(f"""
    WITH {LINE_SQL} SELECT round(1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae,
        round(median(abs(y - pred)), 6) AS median_ae, round(avg(abs(y - pred) / abs(y)) FILTER (y <> 0), 6) AS mape, count(*) FILTER (y = 0) AS mape_n_excluded, count(*) AS n FROM line""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure.regression_metrics(line(spark, sf_dir), "y", "pred")
    return found.select(*[rounded(c).alias(c) for c in ("r2", "rmse", "mae", "median_ae", "mape")], "mape_n_excluded", "n")


_PER_CLASS = """
    per AS (SELECT c, sum(t) AS tr, sum(p) AS pr, sum(tp) AS tp FROM (
        SELECT truth AS c, 1 AS t, 0 AS p, (truth = predicted)::INT AS tp FROM cls UNION ALL SELECT predicted, 0, 1, 0 FROM cls) GROUP BY c)"""


@job(f"""
    WITH {_CLS}, {_PER_CLASS}
    SELECT round(sum(tp) / sum(tr), 6) AS accuracy, round(avg(CASE WHEN tr > 0 THEN tp / tr END), 6) AS balanced_accuracy, round(avg(2 * tp / (tr + pr)), 6) AS f1_macro,
        round(avg(CASE WHEN pr > 0 THEN tp / pr ELSE 0 END), 6) AS precision, round(avg(CASE WHEN tr > 0 THEN tp / tr ELSE 0 END), 6) AS recall, count(*) AS n_classes FROM per""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure.classification_metrics(cls(spark, sf_dir), "truth", "predicted")
    return found.select(*[rounded(c).alias(c) for c in found.columns[:-1]], "n_classes")


@job(f"""
    WITH {_CLS}, l AS (SELECT avg(-ln(greatest(CASE truth WHEN 'high' THEN p_high WHEN 'low' THEN p_low ELSE p_mid END, 2.220446049250313e-16))) AS log_loss FROM cls),
    v AS (SELECT 'high' AS c, round(p_high, 9) AS s, (truth = 'high')::INT AS pos FROM cls UNION ALL SELECT 'low', round(p_low, 9), (truth = 'low')::INT FROM cls UNION ALL SELECT 'mid', round(p_mid, 9), (truth = 'mid')::INT FROM cls),
    g AS (SELECT c, s, sum(pos) AS pos, count(*) - sum(pos) AS neg FROM v GROUP BY 1, 2),
    w AS (SELECT c, pos, neg, pos * (sum(neg) OVER (PARTITION BY c ORDER BY s) - neg + neg / 2) AS wins FROM g),
    a AS (SELECT c, sum(wins) / (sum(pos) * sum(neg)) AS auc FROM w GROUP BY 1)
    SELECT round(log_loss, 6) AS log_loss, round((SELECT avg(auc) FROM a), 6) AS roc_auc FROM l""")
def probability_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(cls(spark, sf_dir).select("truth", *[f"p_{c}" for c in CLASSES]))
    own = F.when(F.col("truth") == "high", F.col("p_high")).when(F.col("truth") == "low", F.col("p_low")).otherwise(F.col("p_mid"))
    loss = df.agg(F.avg(-F.log(F.greatest(own, F.lit(2.220446049250313e-16)))).alias("log_loss"))
    areas = measure.areas(df, {c: (F.col("truth") == c, F.col(f"p_{c}")) for c in CLASSES})
    return loss.crossJoin(areas.agg(F.avg("roc_auc").alias("roc_auc"))).select(rounded("log_loss").alias("log_loss"), rounded("roc_auc").alias("roc_auc"))


@job(f"""
    WITH {_CLS}, {_PER_CLASS}, m AS (SELECT 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS r2, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae,
        median(abs(y - pred)) AS median_ae, avg(abs(y - pred) / abs(y)) FILTER (y <> 0) AS mape FROM line),
    c AS (SELECT sum(tp) / sum(tr) AS accuracy, avg(CASE WHEN tr > 0 THEN tp / tr END) AS balanced, avg(2 * tp / (tr + pr)) AS f1, avg(CASE WHEN pr > 0 THEN tp / pr ELSE 0 END) AS pre, avg(CASE WHEN tr > 0 THEN tp / tr ELSE 0 END) AS rec FROM per),
    u AS (SELECT 'regression' AS task, unnest(['r2', 'rmse', 'mae', 'median_ae', 'mape']) AS metric, unnest([r2, rmse, mae, median_ae, mape]) AS value FROM m
        UNION ALL SELECT 'classification', unnest(['accuracy', 'balanced_accuracy', 'f1_macro', 'precision', 'recall']), unnest([accuracy, balanced, f1, pre, rec]) FROM c)
    SELECT task, metric, round(value, 6) AS value, metric NOT IN ('rmse', 'mae', 'median_ae', 'mape') AS higher_is_better, metric IN ('r2', 'f1_macro') AS is_primary FROM u""")
def score_and_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of both tasks in long form with their direction; the declared primary one is marked."""
    df = cls(spark, sf_dir)
    regression = measure.score(df, "regression", "y", "pred").withColumn("task", F.lit("regression"))
    classification = measure.score(df, "classification", "truth", "predicted", "f1_macro").withColumn("task", F.lit("classification"))
    return regression.unionByName(classification).withColumn("value", rounded("value"))


@job(f"""
    WITH {_CLS} SELECT round(avg((p_high - (truth = 'high')::INT) ** 2 + (p_low - (truth = 'low')::INT) ** 2 + (p_mid - (truth = 'mid')::INT) ** 2), 6) AS brier FROM cls""")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    probabilities, names = F.array(*[f"p_{c}" for c in CLASSES]), F.array(*map(F.lit, CLASSES))
    terms = F.zip_with(probabilities, names, lambda p, c: F.pow(p - (c == F.col("truth")).cast("double"), 2))
    return cls(spark, sf_dir).agg(rounded(F.avg(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))).alias("brier"))


_BINS = f"""
    {_CLS}, b AS (SELECT greatest(p_high, p_low, p_mid) AS conf, (truth = predicted)::INT AS hit FROM cls),
    bins AS (SELECT least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg(conf) AS confidence, avg(hit) AS accuracy FROM b GROUP BY 1)"""


def _reliability(df: DataFrame, edges: list[float] | None = None) -> DataFrame:
    confidence = F.greatest("p_high", "p_low", "p_mid")
    return measure.reliability(df, confidence, F.col("truth") == F.col("predicted"), edges or [i / 10 for i in range(11)])


@job(f"""
    WITH {_CLS}, b AS (SELECT greatest(p_high, p_low, p_mid) AS conf, (truth = predicted)::INT AS hit FROM cls), e AS (SELECT quantile_cont(conf, {[i / 10 for i in range(1, 10)]}) AS e FROM b),
    bins AS (SELECT len(list_filter(list_distinct(e), lambda x: x <= conf))::INT AS bin, count(*) AS n, avg(conf) AS confidence, avg(hit) AS accuracy FROM b, e GROUP BY 1)
    SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins""")
def reliability_curve_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same between quantiles of the confidence, so that bins hold about as many rows each."""
    df = cls(spark, sf_dir)
    edges = exact_quantiles(df, {"c": F.greatest("p_high", "p_low", "p_mid")}, [i / 10 for i in range(11)])["c"]
    return _reliability(df, edges).select("bin", "n", rounded("confidence").alias("confidence"), rounded("accuracy").alias("accuracy"))


@job(f"WITH {_BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reliability(cls(spark, sf_dir)).select("bin", "n", rounded("confidence").alias("confidence"), rounded("accuracy").alias("accuracy"))


@job(f"""
    WITH {_BINS} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece, round(max(abs(confidence - accuracy)), 6) AS mce, round(sum(n * confidence) / sum(n), 6) AS mean_confidence,
        round(sum(n * accuracy) / sum(n), 6) AS accuracy, sum(n * confidence) > sum(n * accuracy) AS overconfident, count(*) FILTER (n < 10) AS n_thin_bins FROM bins""")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, gap = F.col("n"), F.abs(F.col("confidence") - F.col("accuracy"))
    confidence, accuracy = F.sum(n * F.col("confidence")) / F.sum(n), F.sum(n * F.col("accuracy")) / F.sum(n)
    return _reliability(cls(spark, sf_dir)).agg(
        rounded(F.sum(n * gap) / F.sum(n)).alias("ece"), rounded(F.max(gap)).alias("mce"), rounded(confidence).alias("mean_confidence"), rounded(accuracy).alias("accuracy"), (confidence > accuracy).alias("overconfident"), F.count_if(n < 10).alias("n_thin_bins")
    )


_WIDTH = f"""
    {LINE_SQL}, parts AS (SELECT *, {_PART} AS part FROM line),
    cal AS (SELECT abs(y - pred) AS s, row_number() OVER (ORDER BY abs(y - pred)) AS r, count(*) OVER () AS n FROM parts WHERE part = 'calibration'),
    w AS (SELECT min(s) AS width FROM cal WHERE r = ceil(round(least(1.0, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1), 9)) + 1)"""


def _intervals(df: DataFrame) -> DataFrame:
    parts = with_part(df)
    width = measure.conformal_width(parts.where("part = 'calibration'"), "y", "pred", 0.9)
    return parts.where("part = 'test'").withColumn("low", F.col("pred") - width).withColumn("high", F.col("pred") + width)


@job(f"WITH {_WIDTH} SELECT key, round(pred - width, 6) AS low, round(pred + width, 6) AS high FROM parts, w WHERE part = 'test'")
def conformal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(line(spark, sf_dir)).select("key", rounded("low").alias("low"), rounded("high").alias("high"))


@job(f"""
    WITH {_CLS}, parts AS (SELECT *, {_PART} AS part, CASE truth WHEN 'high' THEN p_high WHEN 'low' THEN p_low ELSE p_mid END AS own FROM cls),
    cal AS (SELECT 1 - own AS s, row_number() OVER (ORDER BY 1 - own) AS r, count(*) OVER () AS n FROM parts WHERE part = 'calibration'),
    w AS (SELECT min(s) + 1e-12 AS t FROM cal WHERE r = ceil(round(least(1.0, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1), 9)) + 1)
    SELECT key, concat_ws(',', CASE WHEN 1 - p_high <= t THEN 'high' END, CASE WHEN 1 - p_low <= t THEN 'low' END, CASE WHEN 1 - p_mid <= t THEN 'mid' END) AS classes, 1 - own <= t AS covered FROM parts, w WHERE part = 'test'""")
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = with_part(cls(spark, sf_dir))
    own = F.when(F.col("truth") == "high", F.col("p_high")).when(F.col("truth") == "low", F.col("p_low")).otherwise(F.col("p_mid"))
    calibration = parts.where("part = 'calibration'")
    t = measure.quantile_higher(calibration, 1 - own, lambda n: measure.conformal_level(n, 0.9)) + 1e-12
    inside = F.filter(F.array(*[F.when(1 - F.col(f"p_{c}") <= t, c) for c in CLASSES]), lambda c: c.isNotNull())
    return parts.where("part = 'test'").select("key", F.array_join(inside, ",").alias("classes"), (1 - own <= t).alias("covered"))


_REPORT = """count(*) AS n_rows, 0.9::DOUBLE AS requested, CASE WHEN count(*) >= 20 THEN round(avg((y BETWEEN pred - width AND pred + width)::INT), 6) END AS measured,
    CASE WHEN count(*) >= 20 THEN round(avg(2 * width), 6) END AS mean_width, CASE WHEN count(*) >= 20 THEN round(avg((y BETWEEN pred - width AND pred + width)::INT), 9) >= 0.85 END AS meets_request, count(*) < 20 AS skipped"""


def _coverage(df: DataFrame, by: list[str]) -> DataFrame:
    found = measure.coverage_report(df, F.col("y").between(F.col("low"), F.col("high")), F.col("high") - F.col("low"), by)
    return found.withColumn("measured", rounded("measured")).withColumn("mean_width", rounded("mean_width"))


@job(f"WITH {_WIDTH} SELECT {_REPORT} FROM parts, w WHERE part = 'test'")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(_intervals(line(spark, sf_dir)), [])


@job(f"""
    WITH {_WIDTH}, u AS (SELECT y, pred, width, unnest(['l_returnflag', 'o_orderpriority', 'p_type']) AS feature, unnest([l_returnflag, o_orderpriority, p_type]) AS level FROM parts, w WHERE part = 'test')
    SELECT feature, level, {_REPORT} FROM u GROUP BY 1, 2""")
def coverage_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = unpivot(_intervals(line(spark, sf_dir)), ["y", "low", "high"], ["l_returnflag", "o_orderpriority", "p_type"], "feature", "level")
    return _coverage(long, ["feature", "level"])


def _band_sql(c: str, edges: str) -> str:
    bands = " ".join(f"WHEN {c} <= {edges}[{i + 1}] THEN 'q{i} (' || printf('%g', {edges}[{i}]) || ', ' || printf('%g', {edges}[{i + 1}]) || ']'" for i in range(1, 5))
    return f"CASE {bands} END"


_FEATURES = {"l_returnflag": ("A", "N", "R", "Z"), "o_orderpriority": ("1-URGENT", "6-NONE")}


def _slices_sql(metric: str, value: str, sign: int) -> str:
    names = "['l_returnflag', 'o_orderpriority', 'l_quantity', 'p_size', '(overall)']"
    return f"""
    WITH {_CLS}, e AS (SELECT quantile_cont(l_quantity, [0, 0.25, 0.5, 0.75, 1]) AS eq, quantile_cont(p_size, [0, 0.25, 0.5, 0.75, 1]) AS es FROM cls),
    u AS (SELECT y, pred, truth, predicted, unnest({names}) AS feature, unnest([l_returnflag, o_orderpriority, {_band_sql('l_quantity', 'eq')}, {_band_sql('p_size', 'es')}, 'all']) AS level FROM cls, e),
    d AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{x}')" for f, names in _FEATURES.items() for x in names)}) v(feature, level)),
    g AS (SELECT feature, level, count(*) AS n_rows, {value} AS value FROM u WHERE level IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT feature, level, coalesce(n_rows, 0) AS n_rows, value, max(value) FILTER (feature = '(overall)') OVER () AS overall,
        CASE WHEN n_rows IS NULL THEN 'absent' WHEN n_rows < 30 THEN 'too few rows' WHEN value IS NULL THEN 'undefined' END AS skipped FROM g FULL JOIN d USING (feature, level)),
    m AS (SELECT feature, level, n_rows, overall, skipped, CASE WHEN skipped IS NULL THEN value END AS value, CASE WHEN skipped IS NULL THEN {sign} * (overall - value) END AS gap FROM s WHERE feature <> '(overall)')
    SELECT feature, level, n_rows, skipped, round(value, 6) AS value, round(overall, 6) AS overall, round(gap, 6) AS gap, coalesce(gap = max(gap) OVER (), false) AS is_worst FROM m"""


def _slices(df: DataFrame, y: str, p: str, metric: str) -> DataFrame:
    found = measure.slice_report(df, _FEATURES, ["l_quantity", "p_size"], y, p, metric)
    return found.select("feature", "level", "n_rows", "skipped", rounded("value").alias("value"), rounded("overall").alias("overall"), rounded("gap").alias("gap"), "is_worst")


@job(_slices_sql("r2", "CASE WHEN count(*) * var_pop(y) > 1e-12 THEN 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) END", 1))
def slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which segment does the scorer serve worst?"""
    return _slices(line(spark, sf_dir), "y", "pred", "r2")


@job(_slices_sql("accuracy", "avg((truth = predicted)::INT)", 1))
def slice_report_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(cls(spark, sf_dir), "truth", "predicted", "accuracy")


@job(_slices_sql("mae", "avg(abs(y - pred))", -1))
def slice_report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a metric of which less is better."""
    return _slices(line(spark, sf_dir), "y", "pred", "mae")


@job(f"""
    WITH {LINE_SQL} SELECT least(greatest(floor((pred - 20) / 40 * 8), 0), 7)::INT AS band, count(*) AS n, round(avg(y), 6) AS mean_y FROM line GROUP BY 1""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to numeric bands [lo, hi), the last one closed, by a range join with a small table of bands."""
    edges = [20 + 5.0 * i for i in range(9)]
    bands = [(i, edges[i] if i else float("-inf"), edges[i + 1] if i < 7 else float("inf")) for i in range(8)]
    table = spark.createDataFrame(bands, "band int, lo double, hi double")  # 8 rows
    joined = line(spark, sf_dir).join(F.broadcast(table), (F.col("pred") >= F.col("lo")) & (F.col("pred") < F.col("hi")))
    return joined.groupBy("band").agg(F.count("*").alias("n"), rounded(F.avg("y")).alias("mean_y"))


@job(f"WITH {_CLS} SELECT truth, count(*) FILTER (predicted = 'high') AS high, count(*) FILTER (predicted = 'low') AS low, count(*) FILTER (predicted = 'mid') AS mid FROM cls GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cls(spark, sf_dir).groupBy("truth").pivot("predicted", list(CLASSES)).count().na.fill(0)


@job(f"WITH {_CLS} SELECT truth, least(floor(greatest(p_high, p_low, p_mid) * 20), 19)::INT AS bin, count(*) AS n FROM cls GROUP BY 1, 2")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.greatest("p_high", "p_low", "p_mid")
    return cls(spark, sf_dir).groupBy("truth", measure.equal_width(conf, 0.0, 1.0, 20).alias("bin")).agg(F.count("*").alias("n"))


_SIDE = "CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'reference' ELSE 'current' END"


@job(f"""
    WITH {LINE_SQL}, s AS (SELECT {_SIDE} AS side, y, l_returnflag FROM line), m AS (SELECT min(y) AS lo, max(y) AS hi FROM s),
    b AS (SELECT side, least(floor((y - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n FROM s, m GROUP BY 1, 2), l AS (SELECT side, l_returnflag AS level, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT 'y' AS feature, side, bin, NULL::VARCHAR AS level, n, round(n / sum(n) OVER (PARTITION BY side) / ((SELECT (hi - lo) / 30 FROM m)), 6) AS density FROM b
    UNION ALL SELECT 'l_returnflag', side, NULL, level, n, round(n / sum(n) OVER (PARTITION BY side), 6) FROM l""")
def feature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of equal width of a numeric feature, with their density, and counts of a categorical one's levels, by side."""
    df = line(spark, sf_dir).select(F.when(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp"), "reference").otherwise("current").alias("side"), "y", "l_returnflag")
    df = stored(df)  # the ends of y come before its bins
    low, high = df.agg(F.min("y"), F.max("y")).first()
    share = F.col("n") / F.sum("n").over(Window.partitionBy("side"))
    bins = df.groupBy("side", measure.equal_width(F.col("y"), low, high, 30).alias("bin")).agg(F.count("*").alias("n")).withColumn("density", rounded(share / ((high - low) / 30)))
    levels = df.groupBy("side", F.col("l_returnflag").alias("level")).agg(F.count("*").alias("n")).withColumn("density", rounded(share))
    return bins.withColumn("feature", F.lit("y")).unionByName(levels.withColumn("feature", F.lit("l_returnflag")), allowMissingColumns=True)


@job(f"""
    WITH {LINE_SQL}, f AS (SELECT (('0x' || substr(md5(key || ':7:cv'), 1, 8))::BIGINT % 5)::INT AS fold, y, pred FROM line),
    m AS (SELECT fold, 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS r2, avg(abs(y - pred)) AS mae FROM f GROUP BY 1),
    u AS (SELECT unnest(['r2', 'mae']) AS metric, unnest([r2, mae]) AS value FROM m)
    SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most, count(value) AS n_folds FROM u GROUP BY 1 HAVING count(value) = 5""")
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = (hash_uniform("key", SEED, "cv") * 4294967296).cast("long") % 5
    per = line(spark, sf_dir).withColumn("fold", fold).groupBy("fold").agg(measure.r2("y", "pred").alias("r2"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))
    long = unpivot(per, [], ["r2", "mae"], "metric", "value", "double")
    made = long.groupBy("metric").agg(*[rounded(f("value")).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "least"), (F.max, "most"))], F.count("value").alias("n_folds"))
    return made.where("n_folds = 5")


@job(f"""
    WITH {LINE_SQL}, o AS (SELECT key, pred, y - pred AS e, row_number() OVER (ORDER BY pred, key) AS rn, count(*) OVER () AS n FROM line)
    SELECT count(*) AS n, round(stddev_pop(e) FILTER (rn <= n // 10), 6) AS lowest_decile, round(stddev_pop(e) FILTER (rn > n - n // 10), 6) AS highest_decile,
        round(stddev_pop(e) FILTER (rn > n - n // 10) / stddev_pop(e) FILTER (rn <= n // 10), 6) AS ratio FROM o""")
def residual_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line(spark, sf_dir).select("key", "pred", (F.col("y") - F.col("pred")).alias("e"))
    numbered = global_row_number(df, "pred", ["key"])
    n = df.count()
    low, high = F.stddev_pop(F.when(F.col("rn") <= n // 10, F.col("e"))), F.stddev_pop(F.when(F.col("rn") > n - n // 10, F.col("e")))
    return numbered.agg(F.count("*").alias("n"), rounded(low).alias("lowest_decile"), rounded(high).alias("highest_decile"), rounded(high / low).alias("ratio"))


@job(f"""
    WITH {LINE_SQL}, o AS (SELECT key, round(pred, 9) AS pred, y - pred AS e, greatest(15, count(*) OVER () // 20)::BIGINT AS w FROM line),
    r AS (SELECT key, w, avg(e) OVER c AS m, stddev_samp(e) OVER c AS s, count(*) OVER c AS n FROM o WINDOW c AS (ORDER BY pred, key ROWS BETWEEN w // 2 PRECEDING AND (w - 1) // 2 FOLLOWING))
    SELECT key, CASE WHEN n >= greatest(5, w // 3) THEN round(m, 5) END AS rolling_mean, CASE WHEN n >= greatest(5, w // 3) THEN round(s, 5) END AS rolling_std FROM r""")
def residual_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred rolling mean and deviation of the residual in the order of the prediction."""
    df = line(spark, sf_dir).withColumn("e", F.col("y") - F.col("pred")).withColumn("pred", F.round("pred", 9))
    found = measure.rolling_residuals(df, "pred", "e", "key")
    return found.select("key", rounded("rolling_mean", 5).alias("rolling_mean"), rounded("rolling_std", 5).alias("rolling_std"))
