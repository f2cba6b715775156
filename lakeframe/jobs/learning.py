"""Jobs that fit models, generate data or stream; checked by rows and invariants, or against batch SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform, rounded
from ..functions.storage import fresh_path, stored
from ..operators import contract, explain, learn, measure, ml_forecast, model_store, split, synth
from ..sources import io
from ..spec import SETTINGS, Feature
from ..streaming import jobs as stream
from .frames import LINE, LINE_SQL, LOG_SQL, SEED, SERIES_SQL, _uniform, classes, line, prediction_log, read, series
from .registry import job


_CHECKED = replace(LINE, features=(*LINE.features, Feature("settled", "numeric"), Feature("batch", "numeric", nullable=True)))
_PRESENT = [f.name for f in _CHECKED.features if f.name != "l_tax"]


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame with a declared column missing, one that restates the target, one that is mostly null and constant."""
    df = line(spark, sf_dir).withColumnRenamed("l_tax", "tax").withColumn("settled", F.col("y") * 1.5 - 2)
    df = df.withColumn("batch", F.when(F.col("l_returnflag") == "R", 1.0))
    return stored(df.select("key", "tax", *_PRESENT, "y"))  # several probes read it


def _signals(df: DataFrame) -> DataFrame:
    return contract.leakage_signals(df, _CHECKED, hash_uniform("key", SEED, "leakage") >= 0.25)


@job()
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict row: columns, contract, leakage and learnability of the frame, the most telling failure first."""
    df = _checked(spark, sf_dir)
    return contract.contract_verdict(df, _CHECKED, "key", _signals(df), learn.learnability(df, _LEVELS, _NUMBERS, "y", "key"))


_SIGNALS_SQL = f"""
    {LINE_SQL}, checked AS (SELECT * EXCLUDE (l_tax), l_tax AS tax, y * 1.5 - 2 AS settled, CASE WHEN l_returnflag = 'R' THEN 1.0 END::DOUBLE AS batch FROM line),
    edges AS (SELECT {", ".join(f"quantile_cont({c}, [{', '.join(str(i / 64) for i in range(1, 64))}]) AS e_{c}" for c in _PRESENT[3:])} FROM checked),
    bins AS (
        SELECT y AS t, {_uniform("key", SEED, "leakage")} >= 0.25 AS train, unnest({_PRESENT}) AS feature,
            unnest([{", ".join(_PRESENT[:3])}, {", ".join(f"len(list_filter(list_distinct(e_{c}), lambda v: v <= {c}))::VARCHAR" for c in _PRESENT[3:])}]) AS raw
        FROM checked, edges),
    cells AS (
        SELECT feature, coalesce(raw, '(missing)') AS bin, avg(t) FILTER (train) AS fit, count(*) FILTER (NOT train) AS n, sum(t) FILTER (NOT train) AS s, sum(t * t) FILTER (NOT train) AS ss
        FROM bins GROUP BY 1, 2),
    means AS (SELECT feature, avg(t) AS mean FROM bins WHERE train GROUP BY 1),
    singles AS (
        SELECT feature, 1 - sum(ss - 2 * coalesce(fit, mean) * s + n * coalesce(fit, mean) * coalesce(fit, mean)) / (sum(ss) - sum(s) * sum(s) / sum(n)) AS score
        FROM cells JOIN means USING (feature) WHERE n > 0 GROUP BY 1),
    signals AS (
        SELECT feature, 'single_feature' AS kind, score FROM singles
        {" ".join(f"UNION ALL SELECT '{c}', 'duplicate', avg(coalesce(lower(trim({c}::VARCHAR)) = y::VARCHAR, false)::INT) FROM checked" for c in _PRESENT)}
        {" ".join(f"UNION ALL SELECT '{c}', 'correlation', CASE WHEN count(DISTINCT {c}) > 1 THEN abs(corr({c}, y)) END FROM checked" for c in _PRESENT[3:])})"""
_RANGES = {f.name: f for f in _CHECKED.features}
_BROKEN_SQL = " + ".join(
    [f"count(*) FILTER ({c} IS NULL)" for c in [*_PRESENT, "y"] if c != "batch"]
    + [f"count(*) FILTER ({c} NOT IN {_RANGES[c].levels})" for c in _PRESENT[:3]]
    + [f"count(*) FILTER ({c} < {_RANGES[c].minimum}) + count(*) FILTER ({c} > {_RANGES[c].maximum})" for c in _PRESENT[3:6]]
)
_AUDIT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, concat_ws('; ', CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant' END, CASE WHEN round(1 - count({c}) / count(*), 6) >= 0.5 THEN 'mostly null' END,
        {f"CASE WHEN count(DISTINCT {c}) / count(*) >= 0.5 THEN 'id-like' END, CASE WHEN count(DISTINCT {c}) > {len(_RANGES[c].levels)} THEN 'more values than levels' END," if c in _PRESENT[:3] else ""}
        {"NULL" if c == "batch" else f"CASE WHEN count(*) > count({c}) THEN 'null in non-nullable' END"}) AS issues FROM checked"""
    for c in [*_PRESENT, "y"]
)


@job(f"WITH {_SIGNALS_SQL} SELECT feature, kind, round(score, 6) AS score, coalesce(score >= 0.98, false) AS leaks FROM signals")
def leakage_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every probe's score of every declared feature, and which of them tell the target."""
    return _signals(_checked(spark, sf_dir)).select("feature", "kind", rounded("score").alias("score"), "leaks")


@job(f"""
    WITH {_SIGNALS_SQL},
    l AS (SELECT count(*) AS n_leaks, string_agg(feature || ': ' || kind, ', ' ORDER BY feature || ': ' || kind) AS leaking, max_by(feature || ': ' || kind, (round(score, 6), feature || ': ' || kind)) AS strongest FROM signals WHERE score >= 0.98),
    b AS (SELECT {_BROKEN_SQL} AS n_violations FROM checked),
    a AS (SELECT string_agg(name || ': ' || issues, ' | ' ORDER BY name || ': ' || issues) AS audit FROM ({_AUDIT_SQL}) WHERE issues <> '')
    SELECT 'l_tax' AS missing, 'key,tax' AS undeclared, false AS schema_ok, n_violations, n_leaks, leaking, strongest,
        concat_ws(' | ', 'missing columns: l_tax', CASE WHEN n_violations > 0 THEN 'contract: ' || n_violations || ' violations' END, 'leakage: ' || n_leaks || ' signals, strongest is ' || strongest, 'learnability was not measured') AS issues,
        concat_ws(' | ', 'l_tax: absent', audit) AS warnings, false AS ok, 'missing columns' AS first_failure
    FROM l, b, a""")
def contract_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict without a fitted model: what is missing, broken, leaking or of no use, by name."""
    df = _checked(spark, sf_dir)
    return contract.contract_verdict(df, _CHECKED, "key", _signals(df), None).drop("n_rows", "r2", "learnable", "too_easy")


_LEVELS, _NUMBERS = ["l_returnflag", "o_orderpriority"], ["l_quantity", "l_discount", "p_size"]


@job()
def learnability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.learnability(line(spark, sf_dir), _LEVELS, _NUMBERS, "y", "key")


@job()
def learnability_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for classes: accuracy against the floor, or the share of the commonest class if that is higher."""
    return learn.learnability_classes(classes(line(spark, sf_dir)), _LEVELS, _NUMBERS, "truth", "key")


@job()
def cross_validate_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a given estimator in every fold."""
    df = line(spark, sf_dir).select("key", "l_returnflag", "y", *_NUMBERS).na.fill(0.0, _NUMBERS)
    folded = split.cv_folds(df, "key", SEED, 3, stratum="l_returnflag")
    return learn.cross_validate(folded, lambda: LinearRegression(labelCol="y", regParam=0.1), ["l_returnflag"], _NUMBERS, "y")


_SIMPLE = ("l_discount", "l_quantity", "l_tax")
_FITS_SQL = " UNION ALL ".join(
    f"""SELECT {i} AS nth, '{c}' AS candidate, o, i, (SELECT 1 - sum(pow(y - (k + s * {c}), 2)) / (count(*) * var_pop(y)) FROM f WHERE fold = i) AS r2
    FROM (SELECT o, i, regr_slope(y, {c}) AS s, regr_intercept(y, {c}) AS k FROM pairs JOIN f ON fold <> o AND fold <> i GROUP BY ALL)"""
    for i, c in enumerate(_SIMPLE)
)


@job(f"""
    WITH {LINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_uniform("key", SEED, "fold")}, key) AS rn FROM line),
    f AS (SELECT (rn % 3)::INT AS fold, y, coalesce(l_discount, 0) AS l_discount, coalesce(l_quantity, 0) AS l_quantity, coalesce(l_tax, 0) AS l_tax FROM r),
    folds AS (SELECT unnest(range(3))::INT AS k), pairs AS (SELECT a.k AS o, b.k AS i FROM folds a, folds b), fits AS ({_FITS_SQL}),
    m AS (SELECT o, nth, candidate, avg(r2) FILTER (o <> i) AS inner_r2, any_value(r2) FILTER (o = i) AS outer_r2 FROM fits GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY round(inner_r2, 9) DESC, nth) AS place FROM m)
    SELECT o AS outer_fold, candidate, round(inner_r2, 5) AS inner_r2, round(outer_r2, 5) AS outer_r2, (SELECT count(*) FROM f WHERE fold = o) AS n, count(*) OVER (PARTITION BY candidate) AS n_chosen FROM p WHERE place = 1""")
def nested_cv_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three linear models, of one column each: the inner folds choose, the outer fold judges."""
    df = stored(line(spark, sf_dir).select("key", "l_returnflag", "y", *_SIMPLE).na.fill(0.0, list(_SIMPLE)))
    folded = split.cv_folds(df, "key", SEED, 3, stratum="l_returnflag").select("fold", "y", *_SIMPLE)

    def of(c: str) -> Pipeline:
        return Pipeline(stages=[VectorAssembler(inputCols=[c], outputCol="features"), LinearRegression(labelCol="y", solver="normal")])

    found = learn.nested_cv(folded, {c: partial(of, c) for c in _SIMPLE}, "y")
    return found.withColumns({c: F.round(c, 5) for c in ("inner_r2", "outer_r2")})


_PLANE = ["l_quantity", "l_discount"]


@job(f"""
    WITH {LINE_SQL}, s AS (SELECT avg(y) AS my, avg(l_quantity) AS ma, avg(l_discount) AS mb, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb,
        covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, y) AS ay, covar_pop(l_discount, y) AS bd FROM line WHERE {_uniform("key", SEED, "split")} >= 0.4),
    c AS (SELECT *, (ay * bb - bd * ab) / (aa * bb - ab * ab) AS ca, (bd * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s)
    SELECT key, round(my + ca * (l_quantity - ma) + cb * (l_discount - mb), 3) AS y_pred FROM line, c""")
def score_frame_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model, fitted on the training part, stored, loaded and checked on the test part, scores all rows."""
    df = stored(line(spark, sf_dir).select("key", *_PLANE, "y").withColumn("part", split.threshold_split("key", SEED)))  # fitted, verified and scored
    train, test = df.where("part = 'train'"), df.where("part = 'test'")
    stages = [VectorAssembler(inputCols=_PLANE, outputCol="features"), LinearRegression(labelCol="y", solver="normal")]
    model = Pipeline(stages=stages).fit(train)
    r2 = model.transform(test).agg(measure.r2("y", "prediction")).first()[0]
    path = fresh_path(spark, "model")
    model_store.save(spark, path, model_store.describe(train, "plane", _PLANE, "y", metric="r2", metric_value=r2), model)
    loaded = model_store.load(spark, path)
    model_store.verify(loaded, test, measure.r2)
    return model_store.score_frame(df, loaded).select("key", F.round("y_pred", 3).alias("y_pred"))


@job()
def score_frame_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored classifier's classes, and its probabilities of the last one."""
    df = line(spark, sf_dir).select("key", "l_returnflag", *_PLANE, F.when(F.col("y") < 38, "good").otherwise("poor").alias("truth"))
    df = stored(df.withColumn("part", split.threshold_split("key", SEED)))  # fitted and scored
    train = df.where("part = 'train'")
    labels = StringIndexer(inputCol="truth", outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    encoder = StringIndexer(inputCol="l_returnflag", outputCol="_flag", stringOrderType="alphabetAsc", handleInvalid="keep")
    stages = [encoder, VectorAssembler(inputCols=[*_PLANE, "_flag"], outputCol="features"), LogisticRegression(labelCol="_label", maxIter=20)]
    model = Pipeline(stages=stages).fit(labels.transform(train))
    path = fresh_path(spark, "model")
    manifest = model_store.describe(train, "poor-lines", ["l_returnflag", *_PLANE], "truth", tuple(labels.labels), closed=("l_returnflag",))
    model_store.save(spark, path, manifest, model)
    scored = model_store.score_frame(df, model_store.load(spark, path), strict_levels=True)
    return scored.select("key", "y_pred", F.round("y_pred_proba", 6).alias("y_pred_proba"))


@job()
def vectorize_high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line(spark, sf_dir).select("key", "l_returnflag", F.col("l_partkey").cast("string").alias("l_partkey"), "l_quantity")
    df = stored(df)  # three stages are fitted on it
    fitted = learn.feature_pipeline(df, ["l_returnflag", "l_partkey"], ["l_quantity"]).fit(df)
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array("features")
    return fitted.transform(df).select("key", F.size(values).alias("width"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _additive(q: str, d: str, p: str) -> tuple[str, str, str]:
    return f"8.0 * tanh(({q} - 25) / 10)", f"5.0 * ln(1 + {d} / 0.05)", f"3.0 * sqrt(greatest(({p} - 1) / 10, 0))"


_Q, _D, _P = _additive("l_quantity", "l_discount", "p_size")


@job(f"""
    WITH {LINE_SQL}, x AS (SELECT key, l_quantity, l_discount, p_size, {_Q} AS tq, {_D} AS td, {_P} AS tp FROM line WHERE p_size IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL),
    b AS (SELECT * FROM x ORDER BY {_uniform("key", SEED, "background")}, key LIMIT 64),
    m AS (SELECT avg(tq) AS tq, avg(td) AS td, avg(tp) AS tp, avg(l_quantity) AS q, avg(p_size) AS p, avg(l_quantity * p_size) AS qp FROM b)
    SELECT key, round(x.tq - m.tq + 0.002 * (l_quantity * p_size + l_quantity * m.p - m.q * p_size - m.qp), 6) AS l_quantity, round(x.td - m.td, 6) AS l_discount,
        round(x.tp - m.tp + 0.002 * (l_quantity * p_size - l_quantity * m.p + m.q * p_size - m.qp), 6) AS p_size FROM x, m""")
def permutation_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions to a score with an interaction, against 64 rows."""
    features = ["l_quantity", "l_discount", "p_size"]
    df = line(spark, sf_dir).select("key", *features).na.drop(subset=features)
    background = df.orderBy(hash_uniform("key", SEED, "background"), "key").limit(64)

    def score() -> Column:
        q, d, p = map(F.col, features)
        return 8.0 * F.tanh((q - 25) / 10) + 5.0 * F.log1p(d / 0.05) + 3.0 * F.sqrt(F.greatest((p - 1) / 10, F.lit(0.0))) + 0.004 * q * p

    found = explain.attributions(df, "key", features, background, score)
    return found.select("key", *[F.round(c, 6).alias(c) for c in features])


@job()
def copula_synthesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as there are lines: numbers, levels, times and nulls."""
    df = line(spark, sf_dir).select("l_quantity", "l_discount", "p_size", "y", "l_returnflag", "o_orderpriority", "l_shipdate")
    fitted = synth.fit_copula(df, df.columns)
    return fitted.sample(fitted.n_rows, SEED)


@job()
def global_ml_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's forecasts of the next days, each one model over all series."""
    return ml_forecast.global_forecasts(series(spark, sf_dir), 7, 14)


_WINDOWS, _LEVEL = 3, 0.9


@job()
def forecast_backtest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates, with and without a model, from the same cutoffs."""
    made = ml_forecast.backtest_forecasts(series(spark, sf_dir), 7, 14, _WINDOWS)
    return ml_forecast.backtest(made, _WINDOWS, _LEVEL)


@job(f"""
    WITH {SERIES_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM series),
    w AS (SELECT unique_id, y, i, k, n - ({_WINDOWS} - k) * 14 AS cutoff FROM i, range({_WINDOWS}) t(k)),
    s AS (SELECT * FROM w WHERE i >= cutoff AND i < cutoff + 14),
    m AS (SELECT unique_id, k, avg(y) AS mean FROM w WHERE i < cutoff AND i >= cutoff - 7 GROUP BY 1, 2),
    f AS (
        SELECT 'naive' AS model, s.unique_id, s.k, s.y, i.y AS p FROM s JOIN i ON i.unique_id = s.unique_id AND i.i = s.cutoff - 1
        UNION ALL SELECT 'seasonal_naive', s.unique_id, s.k, s.y, i.y FROM s JOIN i ON i.unique_id = s.unique_id AND i.i = s.cutoff - 7 + (s.i - s.cutoff) % 7
        UNION ALL SELECT 'window_mean', s.unique_id, s.k, s.y, mean FROM s JOIN m USING (unique_id, k)),
    b AS (SELECT model, unique_id, t.k, abs(y - p) AS s, row_number() OVER x AS r, count(*) OVER (PARTITION BY model, unique_id, t.k) AS n
        FROM f JOIN range({_WINDOWS}) t(k) ON f.k < t.k WINDOW x AS (PARTITION BY model, unique_id, t.k ORDER BY abs(y - p))),
    h AS (SELECT model, unique_id, k, s AS width FROM b WHERE r = ceil(round(least(1.0, ceil(round((n + 1) * {_LEVEL}, 9)) / n) * (n - 1), 9)) + 1),
    e AS (SELECT model, avg(CASE WHEN abs(p) + abs(y) < 1e-9 THEN 0 ELSE 200 * abs(p - y) / (abs(p) + abs(y)) END) AS smape,
            CASE WHEN NOT bool_or(abs(y) < 1e-9) THEN avg(CASE WHEN abs(y) >= 1e-9 THEN 100 * abs((p - y) / y) END) END AS mape, avg(abs(p - y)) AS mae,
            avg((abs(y - p) <= width)::INT) FILTER (width IS NOT NULL) AS measured, avg(width) AS width
        FROM f LEFT JOIN h USING (model, unique_id, k) GROUP BY 1)
    SELECT model, round(smape, 6) AS smape, round(mape, 6) AS mape, round(mae, 6) AS mae, {_LEVEL}::DOUBLE AS requested, round(measured, 6) AS measured, round(width, 6) AS width,
        row_number() OVER (ORDER BY smape, mae, model) AS place, round((SELECT min(smape) FROM e o WHERE o.model <> e.model) - smape, 6) AS margin FROM e""")
def forecast_backtest_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates without a model."""
    made = ml_forecast.backtest_forecasts(series(spark, sf_dir), 7, 14, _WINDOWS, models=False)
    found = ml_forecast.backtest(made, _WINDOWS, _LEVEL)
    return found.select("model", *[F.round(c, 6).alias(c) for c in ("smape", "mape", "mae")], "requested", *[F.round(c, 6).alias(c) for c in ("measured", "width")], "place", F.round("margin", 6).alias("margin"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_log(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "run_id", "tenant_id", "feature_digest", "prediction")


@job(f"WITH {LOG_SQL} SELECT event_id, run_id, feature_digest, round(prediction, 6) AS prediction FROM plog")
def stream_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.source(spark, stream.log_files(spark, _log(spark, sf_dir)))
    out = stream.run_to_end(stream.prediction_log_stream(rows), fresh_path(spark, "stream-log"))
    return spark.read.parquet(out).select("event_id", "run_id", "feature_digest", F.round("prediction", 6).alias("prediction"))


@job(f"""
    WITH {LOG_SQL}, w AS (SELECT date_trunc('hour', ts) AS start, run_id, count(*) AS n FROM plog GROUP BY 1, 2)
    SELECT start::TIMESTAMP AS start, run_id, n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM plog) - INTERVAL 3 HOUR""")
def stream_traffic_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by stream; compared for windows that the watermark has surely closed."""
    log = _log(spark, sf_dir)
    rows = stream.source(spark, stream.log_files(spark, log))
    out = stream.run_to_end(stream.traffic_volume(rows), fresh_path(spark, "stream-volume"))
    last = log.agg((F.max("ts") - F.expr("INTERVAL 3 HOURS")).alias("last"))
    found = spark.read.parquet(out).join(F.broadcast(last), F.col("start") + F.expr("INTERVAL 1 HOUR") <= F.col("last"))
    return found.select("start", "run_id", "n")


@job(f"""
    WITH {LOG_SQL}, w AS (SELECT date_trunc('hour', ts) - to_hours(h) AS start, run_id, count(*) AS n FROM plog, range(24) t(h) GROUP BY 1, 2)
    SELECT start::TIMESTAMP AS start, run_id, n FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM plog) - INTERVAL 3 HOUR""")
def stream_traffic_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a day that slides by the hour, for windows that the watermark has surely closed."""
    log = _log(spark, sf_dir)
    rows = stream.source(spark, stream.log_files(spark, log))
    out = stream.run_to_end(stream.traffic_volume(rows, "1 day", "1 hour"), fresh_path(spark, "stream-sliding"))
    last = log.agg((F.max("ts") - F.expr("INTERVAL 3 HOURS")).alias("last"))
    found = spark.read.parquet(out).join(F.broadcast(last), F.col("start") + F.expr("INTERVAL 1 DAY") <= F.col("last"))
    return found.select("start", "run_id", "n")


@job()
def stream_dedupe_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.source(spark, stream.log_files(spark, _log(spark, sf_dir)))
    out = stream.run_to_end(stream.dedupe_inputs(rows), fresh_path(spark, "stream-dedupe"))
    return spark.read.parquet(out).select("event_id", "run_id", "feature_digest")


@job()
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    middle = log.agg(F.percentile_approx(F.col("ts").cast("double"), 0.5)).first()[0]
    folder = fresh_path(spark, "stream-drift")
    reference = log.where(F.col("ts").cast("double") < middle)
    rows = stream.source(spark, stream.log_files(spark, log.where(F.col("ts").cast("double") >= middle)))
    stream.run_to_end(rows, folder, each=stream.drift_per_batch(reference, f"{folder}/out", ["prediction"]))
    return spark.read.parquet(f"{folder}/out").select("batch", "feature", "test", "statistic", "p", "drifted", "share", "verdict", "alerts")


_EDGES = {"prediction": [5.0, 10.0, 20.0, 40.0, 80.0]}
_WARN, _BLOCK = SETTINGS.drift_warn, SETTINGS.drift_block
_CELLS = "SELECT ts, 'prediction' AS feature, ((prediction >= 5)::INT + (prediction >= 10)::INT + (prediction >= 20)::INT + (prediction >= 40)::INT + (prediction >= 80)::INT)::VARCHAR AS cell FROM plog WHERE prediction IS NOT NULL"


@job(f"""
    WITH {LOG_SQL}, m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle, max(ts) AS last FROM plog),
    c AS ({_CELLS} UNION ALL SELECT ts, 'run_id', run_id FROM plog WHERE run_id IS NOT NULL),
    r AS (SELECT feature, cell, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM c, m WHERE ts < middle GROUP BY 1, 2),
    w AS (SELECT date_trunc('day', ts) AS start, feature, cell, count(*) AS k FROM c, m WHERE ts >= middle GROUP BY 1, 2, 3),
    s AS (SELECT *, sum(k) OVER (PARTITION BY start, feature) AS n FROM w),
    j AS (SELECT s.start, s.feature, max(n)::BIGINT AS n, (sum(abs(k / n - coalesce(p, 0))) + 1 - sum(coalesce(p, 0))) / 2 AS tv
        FROM s LEFT JOIN r USING (feature, cell) WHERE n >= {SETTINGS.drift_min_rows} GROUP BY 1, 2),
    d AS (SELECT *, tv > 0.1 AS drifted, avg((tv > 0.1)::INT) OVER (PARTITION BY start) AS share FROM j)
    SELECT start::TIMESTAMP AS start, feature, n, round(tv, 6) AS tv, drifted, round(share, 6) AS share, CASE WHEN share >= {_BLOCK} THEN 'block' WHEN share >= {_WARN} THEN 'warn' ELSE 'pass' END AS verdict
    FROM d, m WHERE start + INTERVAL 1 DAY <= last - INTERVAL 3 HOUR""")
def stream_drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of event time against the log's first half, each judged once when the watermark has passed its end."""
    log = _log(spark, sf_dir)
    ends = log.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("middle"), (F.max("ts") - F.expr("INTERVAL 3 HOURS")).alias("last"))  # one row
    halves = log.crossJoin(F.broadcast(ends))
    folder = fresh_path(spark, "stream-windows")
    reference = io.freeze(stream.reference_cells(halves.where("ts < middle"), _EDGES, ["run_id"]), f"{folder}/reference")
    rows = stream.source(spark, stream.log_files(spark, halves.where("ts >= middle").select(*log.columns)), 1000)  # files of one writer bear no order of time
    stream.run_to_end(stream.windowed_cells(rows, _EDGES, ["run_id"]), folder, each=stream.drift_by_window(reference, f"{folder}/out"))
    found = stream.drifted_windows(spark, f"{folder}/out").crossJoin(F.broadcast(ends.select("last"))).where(F.col("start") + F.expr("INTERVAL 1 DAY") <= F.col("last"))
    return found.select("start", "feature", "n", F.round("tv", 6).alias("tv"), "drifted", F.round("share", 6).alias("share"), "verdict")
