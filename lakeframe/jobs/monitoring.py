"""Jobs on prediction logs, drift, label-free performance and run registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import PLAIN_NUMBER_SQL, rounded, unpivot
from ..functions.storage import fresh_path
from ..functions.ranks import global_row_number
from ..operators import drift, estimate, registry_ops, run_store
from ..spec import Feature, Problem
from .frames import CLASS_SQL, HOLES_SQL, LINE_SQL, LOG_SQL, RUNS_SQL, classes, line, prediction_log, read, runs
from .registry import job

_CUT = "TIMESTAMP '1998-07-01'"


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines before the cut as the reference; after it as current, with quantities moved and one level inflated."""
    df = line(spark, sf_dir)
    current = F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp")
    return df.withColumn("side", F.when(current, "current").otherwise("reference")).withColumn("l_quantity", F.when(current, F.col("l_quantity") * 1.5 + 3).otherwise(F.col("l_quantity"))).withColumn("l_returnflag", F.when(current & (F.col("l_linestatus") == "O"), "A").otherwise(F.col("l_returnflag")))


_SIDED = f"""{LINE_SQL}, sided AS (
    SELECT * REPLACE (CASE WHEN l_shipdate >= {_CUT} THEN l_quantity * 1.5 + 3 ELSE l_quantity END AS l_quantity, CASE WHEN l_shipdate >= {_CUT} AND l_linestatus = 'O' THEN 'A' ELSE l_returnflag END AS l_returnflag),
        CASE WHEN l_shipdate >= {_CUT} THEN 'current' ELSE 'reference' END AS side FROM line)"""
_LEVELS = f"""{_SIDED}, u AS (SELECT side, unnest(['l_returnflag', 'l_linestatus', 'o_orderpriority', 'p_type']) AS feature, unnest([l_returnflag, l_linestatus, o_orderpriority, p_type]) AS level FROM sided),
    counts AS (SELECT feature, level, count(*) FILTER (side = 'reference') AS n_ref, count(*) FILTER (side = 'current') AS n_cur FROM u WHERE level IS NOT NULL GROUP BY 1, 2),
    shares AS (SELECT *, n_ref / sum(n_ref) OVER w AS share_ref, n_cur / sum(n_cur) OVER w AS share_cur, sum(n_cur) OVER w AS total_cur FROM counts WINDOW w AS (PARTITION BY feature))"""
_CATS, _NUMS = ["l_returnflag", "l_linestatus", "o_orderpriority", "p_type"], ["l_quantity", "l_discount", "p_size", "y"]


@job(f"WITH {_LEVELS} SELECT feature, level, n_ref, n_cur, round(share_ref, 6) AS share_ref, round(share_cur, 6) AS share_cur FROM shares")
def level_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.level_shares(drift.level_counts(sided(spark, sf_dir), "side", _CATS))
    return found.withColumn("share_ref", rounded("share_ref")).withColumn("share_cur", rounded("share_cur"))


_KS = f"""{_SIDED}, n AS (SELECT side, unnest(['l_quantity', 'l_discount', 'p_size', 'y']) AS feature, unnest([l_quantity, l_discount, p_size, y]) AS value FROM sided),
    g AS (SELECT feature, value, count(*) FILTER (side = 'reference') AS r, count(*) FILTER (side = 'current') AS c FROM n WHERE value IS NOT NULL GROUP BY 1, 2),
    cum AS (SELECT feature, sum(r) OVER o / sum(r) OVER a AS fr, sum(c) OVER o / sum(c) OVER a AS fc, sum(r) OVER a AS n_ref, sum(c) OVER a AS n_cur FROM g WINDOW o AS (PARTITION BY feature ORDER BY value), a AS (PARTITION BY feature)),
    ks AS (SELECT feature, max(abs(fr - fc)) AS d, max(n_ref) AS n_ref, max(n_cur) AS n_cur FROM cum GROUP BY 1)"""


@job(f"WITH {_KS} SELECT feature, round(d, 6) AS d, n_ref::BIGINT AS n_ref, n_cur::BIGINT AS n_cur FROM ks")
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.ks_statistic(sided(spark, sf_dir), "side", _NUMS).withColumn("d", rounded("d"))


_CHI = "chi AS (SELECT feature, sum(CASE WHEN n_ref > 0 THEN (n_cur - share_ref * total_cur) ** 2 / (share_ref * total_cur) END) AS statistic, count(*) FILTER (n_ref > 0) - 1 AS df, sum(CASE WHEN n_ref = 0 THEN n_cur ELSE 0 END)::BIGINT AS n_unseen FROM shares GROUP BY 1)"


@job(f"WITH {_LEVELS}, {_CHI} SELECT feature, round(statistic, 4) AS statistic, df, n_unseen FROM chi")
def chi_square_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.chi_square(drift.level_counts(sided(spark, sf_dir), "side", _CATS))
    return found.withColumn("statistic", rounded("statistic", 4))


_TV = "tv AS (SELECT feature, sum(abs(share_ref - share_cur)) / 2 AS tv FROM shares GROUP BY 1)"


@job(f"WITH {_LEVELS}, {_TV} SELECT feature, round(tv, 6) AS tv FROM tv")
def total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.total_variation(drift.level_counts(sided(spark, sf_dir), "side", _CATS)).withColumn("tv", rounded("tv"))


_DRIFTING = Problem((*(Feature(c, "numeric") for c in ("l_quantity", "l_discount", "p_size")), *(Feature(c, "categorical", ("-",)) for c in ("l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment")), Feature("l_shipdate", "datetime"), Feature("absent", "numeric")), Feature("y", "numeric"))
#: Where the upper tail of chi-square is 0.05, by degrees of freedom.
_CRITICAL = "CASE df WHEN 1 THEN 3.841458820694124 WHEN 2 THEN 5.991464547107979 WHEN 3 THEN 7.814727903251179 WHEN 4 THEN 9.487729036781154 END"


@job(f"""
    WITH {_SIDED}, num AS (SELECT side, unnest(['l_quantity', 'l_discount', 'p_size', 'y', 'prediction']) AS feature, unnest([l_quantity, l_discount, p_size, y, pred]) AS value FROM sided),
    g AS (SELECT feature, value, count(*) FILTER (side = 'reference') AS r, count(*) FILTER (side = 'current') AS c FROM num WHERE value IS NOT NULL GROUP BY 1, 2),
    cum AS (SELECT feature, sum(r) OVER o / sum(r) OVER a AS fr, sum(c) OVER o / sum(c) OVER a AS fc, sum(r) OVER a AS n, sum(c) OVER a AS m FROM g WINDOW o AS (PARTITION BY feature ORDER BY value), a AS (PARTITION BY feature)),
    ks AS (SELECT feature, max(abs(fr - fc)) * sqrt(max(n) * max(m) / (max(n) + max(m))) AS lam FROM cum GROUP BY 1),
    ksp AS (SELECT feature, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END < 0.05 AS drifted FROM ks),
    lev AS (SELECT side, unnest(['l_returnflag', 'l_linestatus', 'o_orderpriority', 'c_mktsegment']) AS feature, unnest([l_returnflag, l_linestatus, o_orderpriority, c_mktsegment]) AS level FROM sided),
    counts AS (SELECT feature, level, count(*) FILTER (side = 'reference') AS n_ref, count(*) FILTER (side = 'current') AS n_cur FROM lev WHERE level IS NOT NULL GROUP BY 1, 2),
    shares AS (SELECT *, n_ref / sum(n_ref) OVER w AS share_ref, sum(n_cur) OVER w AS total_cur FROM counts WINDOW w AS (PARTITION BY feature)), {_CHI},
    f AS (SELECT feature, drifted FROM ksp UNION ALL SELECT feature, statistic > {_CRITICAL} FROM chi), v AS (SELECT avg(drifted::INT) AS share, count(*) AS n_features, string_agg(feature, ',' ORDER BY feature) FILTER (drifted) AS drifted FROM f WHERE feature NOT IN ('y', 'prediction'))
    SELECT n_features, round(share, 6) AS share, CASE WHEN share >= 0.4 THEN 'block' WHEN share >= 0.2 THEN 'warn' ELSE 'pass' END AS verdict, coalesce(drifted, '') AS drifted,
        (SELECT drifted FROM f WHERE feature = 'y') AS target_drifted, (SELECT drifted FROM f WHERE feature = 'prediction') AS prediction_drifted FROM v""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: share of drifted features, verdict and names, and whether target and prediction drifted."""
    df = sided(spark, sf_dir).withColumnRenamed("pred", "prediction").drop("signal")
    found = drift.drift_report(df.where("side = 'reference'"), df.where("side = 'current'"), _DRIFTING)
    return drift.drift_verdict(found).select("n_features", rounded("share").alias("share"), "verdict", "drifted", (F.col("target_p") < 0.05).alias("target_drifted"), (F.col("prediction_p") < 0.05).alias("prediction_drifted"))


@job(f"""
    WITH {_KS}, {_LEVELS.replace(_SIDED + ", ", "")}, {_TV}, m AS (SELECT feature, d AS magnitude FROM ks UNION ALL SELECT feature, tv FROM tv)
    SELECT feature, round(magnitude, 6) AS magnitude FROM m ORDER BY magnitude DESC, feature LIMIT 9""")
def top_drift_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sided(spark, sf_dir)
    ks = drift.ks_statistic(df, "side", _NUMS).select("feature", F.col("d").alias("magnitude"))
    tv = drift.total_variation(drift.level_counts(df, "side", _CATS)).select("feature", F.col("tv").alias("magnitude"))
    return ks.unionByName(tv).withColumn("magnitude", rounded("magnitude")).orderBy(F.desc("magnitude"), "feature").limit(9)


@job(f"""
    WITH {RUNS_SQL}, r AS (SELECT run_id, n_rows, (n_rows % 10) / 10.0 AS share, (n_rows % 8) / 100.0 AS target_p, (n_rows % 9) / 100.0 AS prediction_p, r2 FROM runs),
    a AS (SELECT run_id, 'info' AS severity, 'drift.sample.small' AS code, n_rows::DOUBLE AS value, 200.0 AS threshold FROM r WHERE n_rows < 200
        UNION ALL SELECT run_id, CASE WHEN n_rows < 200 THEN 'info' ELSE 'block' END, 'drift.share.block', share, 0.4 FROM r WHERE share >= 0.4
        UNION ALL SELECT run_id, CASE WHEN n_rows < 200 THEN 'info' ELSE 'warn' END, 'drift.share.warn', share, 0.2 FROM r WHERE share >= 0.2 AND share < 0.4
        UNION ALL SELECT run_id, 'warn', 'drift.target', target_p, 0.01 FROM r WHERE target_p < 0.01 UNION ALL SELECT run_id, 'warn', 'drift.prediction', prediction_p, 0.01 FROM r WHERE prediction_p < 0.01
        UNION ALL SELECT run_id, 'warn', 'perf.estimated.below_floor', r2, 0.6 FROM r WHERE r2 < 0.6)
    SELECT run_id, severity, code, value::DOUBLE AS value, threshold::DOUBLE AS threshold, CASE severity WHEN 'block' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS rank FROM a""")
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_rows")
    reports = runs(spark, sf_dir).select("run_id", "n_rows", ((n % 10) / 10).alias("share"), ((n % 8) / 100).alias("target_p"), ((n % 9) / 100).alias("prediction_p"), F.col("r2").alias("estimated_metric"))
    return drift.drift_alerts(reports, metric_floor=0.6)


@job(f"""
    WITH {LOG_SQL} SELECT event_id, feature_digest, round(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN prediction ELSE (prediction > 25)::INT END, 6) AS prediction,
        CASE WHEN event_id % 3 = 0 THEN 'class ' || k WHEN event_id % 3 = 2 THEN CASE WHEN prediction > 25 THEN 'True' ELSE 'False' END END AS prediction_label FROM plog""")
def prediction_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that come as text, numbers or booleans, split into a number and a label."""
    log = prediction_log(spark, sf_dir)
    m = F.col("event_id") % 3
    text = F.when(m == 0, F.concat(F.lit("class "), F.col("features")["k"])).when(m == 2, F.when(F.col("prediction") > 25, "True").otherwise("False"))
    number = F.when(m == 1, F.col("prediction")).when(m == 2, (F.col("prediction") > 25).cast("double"))
    return log.select("event_id", "feature_digest", rounded(number).alias("prediction"), text.alias("prediction_label"))


@job(f"WITH {LOG_SQL} SELECT event_id, ts, run_id, round(prediction, 6) AS prediction, k AS feature_k, NULL::VARCHAR AS prediction_label FROM plog WHERE ts >= (SELECT min(ts) + INTERVAL 2 DAY FROM plog)")
def read_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted parquet and the JSON tail as one log, since a time, with the nested features as columns."""
    log = prediction_log(spark, sf_dir)
    since = log.agg(F.min("ts").alias("since")).select((F.col("since") + F.expr("INTERVAL 2 DAYS")).alias("since"))
    head, tail = fresh_path(spark, "log"), fresh_path(spark, "tail")
    log.where("event_id % 2 = 0").write.parquet(head)
    log.where("event_id % 2 = 1").drop("feature_digest").withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.json(tail)
    schema = "event_id long, ts timestamp_ntz, run_id string, tenant_id long, prediction double, prediction_label string, features map<string,string>"
    found = spark.read.schema(schema).option("mode", "FAILFAST").json(tail).withColumn("ts", F.col("ts").cast(dict(log.dtypes)["ts"])).unionByName(spark.read.parquet(head), allowMissingColumns=True)
    return found.join(F.broadcast(since), F.col("ts") >= F.col("since")).select("event_id", "ts", "run_id", rounded("prediction").alias("prediction"), F.col("features")["k"].alias("feature_k"), "prediction_label")


@job(f"WITH {LOG_SQL} SELECT run_id, date_trunc('day', ts)::DATE AS date, count(*) AS n, round(sum(prediction), 4) AS total FROM plog GROUP BY 1, 2")
def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON log folded into parquet by run and date; a run and day with too much for one task goes to several."""
    raw, out = fresh_path(spark, "raw"), fresh_path(spark, "compact")
    prediction_log(spark, sf_dir).select("event_id", "run_id", F.to_date("ts").alias("date"), "prediction").write.json(raw)
    log = spark.read.schema("event_id long, run_id string, date date, prediction double").json(raw)
    log.hint("rebalance", "run_id", "date").write.partitionBy("run_id", "date").parquet(out)
    return spark.read.parquet(out).groupBy("run_id", "date").agg(F.count("*").alias("n"), rounded(F.sum("prediction"), 4).alias("total"))


@job(f"""
    WITH {LINE_SQL}, {HOLES_SQL} SELECT l_returnflag, count(l_tax) AS n, round(CASE WHEN count(l_tax) > 0 THEN 1 - sum((y - pred) * (y - pred)) FILTER (l_tax IS NOT NULL) / (count(l_tax) * var_pop(y) FILTER (l_tax IS NOT NULL)) END, 6) AS realised_r2 FROM holed GROUP BY 1""")
def realised_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late labels joined to predictions; measured only where both exist."""
    from ..operators.measure import r2
    from .frames import holes

    df = holes(line(spark, sf_dir))
    predictions, labels = df.select("key", "l_returnflag", "pred"), df.where("l_tax is not null").select("key", "y")
    joined = predictions.join(labels, "key", "left")
    both = F.col("y").isNotNull()
    return joined.withColumn("p", F.when(both, F.col("pred"))).groupBy("l_returnflag").agg(F.count("y").alias("n"), rounded(r2("y", "p")).alias("realised_r2"))


_CHUNKS = f"""{LINE_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, key) AS rn, count(*) OVER () AS n FROM line), ch AS (SELECT *, ((rn - 1) // greatest(50, n // 10))::BIGINT AS chunk FROM o)"""


def _chunked(spark: SparkSession, df: DataFrame) -> DataFrame:
    n = df.count()
    return global_row_number(df, "l_shipdate", ["key"]).withColumn("chunk", F.floor((F.col("rn") - 1) / max(50, n // 10)))


@job(f"WITH {_CHUNKS} SELECT chunk, count(*) AS n, min(rn) AS first, max(rn) AS last FROM ch GROUP BY 1")
def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, line(spark, sf_dir).select("key", "l_shipdate")).groupBy("chunk").agg(F.count("*").alias("n"), F.min("rn").alias("first"), F.max("rn").alias("last"))


@job(f"""
    WITH {_CHUNKS}, {CLASS_SQL.replace("FROM line)", "FROM ch)")},
    h AS (SELECT chunk, round(p_high, 9) AS s, sum(p_high) AS pos, sum(1 - p_high) AS neg FROM cls GROUP BY 1, 2),
    a AS (SELECT chunk, sum(wins) / (sum(pos) * sum(neg)) AS auc FROM (SELECT chunk, pos, neg, pos * (sum(neg) OVER (PARTITION BY chunk ORDER BY s) - neg / 2) AS wins FROM h) GROUP BY 1),
    e AS (SELECT chunk, count(*) AS n, avg(greatest(p_high, p_low, p_mid)) AS acc, 2 * sum(CASE WHEN p_high >= 0.5 THEN p_high ELSE 0 END) / (sum((p_high >= 0.5)::INT) + sum(p_high)) AS f1, avg((truth = predicted)::INT) AS realised FROM cls GROUP BY 1)
    SELECT chunk, n, round(acc, 6) AS estimated_accuracy, round(f1, 6) AS estimated_f1, round(auc, 6) AS estimated_roc_auc, round(realised, 6) AS realised_accuracy, chunk = max(chunk) OVER () AS headline FROM e JOIN a USING (chunk)""")
def estimate_performance_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, and f1 and AUC of one class, by chunk from probabilities alone, beside what turned out; the last chunk leads."""
    df = _chunked(spark, classes(line(spark, sf_dir)).select("key", "l_shipdate", "truth", "predicted", "p_high", "p_low", "p_mid")).withColumn("hit", F.col("truth") == F.col("predicted"))
    found = estimate.expected_scores(df, "chunk", F.greatest("p_high", "p_low", "p_mid"), F.col("p_high"), F.col("hit"))
    return found.select("chunk", "n", *[rounded(c).alias(c) for c in ("estimated_accuracy", "estimated_f1", "estimated_roc_auc", "realised_accuracy")], "headline")


@job()
def estimate_performance_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from probabilities calibrated on a labelled reference by isotonic regression."""
    df = classes(line(spark, sf_dir)).withColumn("hit", F.col("truth") == F.col("predicted")).withColumn("conf", F.greatest("p_high", "p_low", "p_mid"))
    cut = F.lit("1998-07-01").cast("timestamp")
    calibrated = estimate.isotonic(df.where(F.col("l_shipdate") < cut), df.where(F.col("l_shipdate") >= cut), "conf", "hit")
    return _chunked(spark, calibrated).groupBy("chunk").agg(F.count("*").alias("n"), F.avg("calibrated").alias("estimated_accuracy"), F.avg(F.col("hit").cast("double")).alias("realised_accuracy"))


@job()
def estimate_performance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected losses by chunk from boosted trees that learned the reference's losses from features and prediction."""
    df = line(spark, sf_dir).na.fill(0.0, ["p_size"])
    cut = F.lit("1998-07-01").cast("timestamp")
    scored = estimate.expected_losses(df.where(F.col("l_shipdate") < cut), df.where(F.col("l_shipdate") >= cut), ["l_quantity", "l_discount", "p_size"], "y", "pred")
    return _chunked(spark, scored).groupBy("chunk").agg(F.count("*").alias("n"), F.avg("expected_loss").alias("estimated_mae"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("realised_mae"))


@job(f"""
    WITH {_CHUNKS}, b AS (SELECT *, least(greatest(floor(pred / 2), 0), 49)::INT AS bin FROM ch), loss AS (SELECT bin, avg(abs(y - pred)) AS mae, avg((y - pred) * (y - pred)) AS mse FROM b WHERE l_shipdate < {_CUT} GROUP BY 1),
    f AS (SELECT avg(abs(y - pred)) AS mae, avg((y - pred) * (y - pred)) AS mse FROM b WHERE l_shipdate < {_CUT})
    SELECT chunk, count(*) AS n, round(avg(coalesce(loss.mae, f.mae)), 6) AS estimated_mae, round(sqrt(avg(coalesce(loss.mse, f.mse))), 6) AS estimated_rmse, round(avg(abs(y - pred)), 6) AS realised_mae
    FROM b LEFT JOIN loss USING (bin), f WHERE l_shipdate >= {_CUT} GROUP BY 1""")
def estimate_performance_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected losses by chunk, from the reference's mean losses in bins of the prediction."""
    df = _chunked(spark, line(spark, sf_dir).select("key", "l_shipdate", "y", "pred")).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(49), F.floor(F.col("pred") / 2))).cast("int"))
    cut = F.lit("1998-07-01").cast("timestamp")
    error = F.abs(F.col("y") - F.col("pred"))
    reference = df.where(F.col("l_shipdate") < cut)
    losses = reference.groupBy("bin").agg(F.avg(error).alias("mae"), F.avg(error * error).alias("mse"))  # 50 rows
    everywhere = reference.agg(F.avg(error).alias("mae_all"), F.avg(error * error).alias("mse_all"))
    joined = df.where(F.col("l_shipdate") >= cut).join(F.broadcast(losses), "bin", "left").join(F.broadcast(everywhere))
    return joined.groupBy("chunk").agg(
        F.count("*").alias("n"), rounded(F.avg(F.coalesce("mae", "mae_all"))).alias("estimated_mae"), rounded(F.sqrt(F.avg(F.coalesce("mse", "mse_all")))).alias("estimated_rmse"), rounded(F.avg(error)).alias("realised_mae")
    )


@job()
def rebuild_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table from JSON files of runs, without those that cannot be read, newest first."""
    path = fresh_path(spark, "runs")
    runs(spark, sf_dir).select(F.to_json(F.struct("run_id", "domain_id", "created_at", "stage", "r2")).alias("value")).unionByName(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    found = spark.read.schema("run_id string, domain_id string, created_at timestamp, stage string, r2 double, _corrupt_record string").json(path)
    return found.where("_corrupt_record is null and run_id is not null").drop("_corrupt_record").orderBy(F.desc("created_at"), F.desc("run_id"))


@job(f"""
    WITH {RUNS_SQL} SELECT run_id, domain_id, CASE WHEN n_rows % 2 = 0 THEN 'archived' ELSE stage END AS stage, n_rows, round(CASE WHEN n_rows % 2 = 0 THEN r2 + 2 ELSE r2 END, 6) AS r2
    FROM runs WHERE n_rows % 3 <> 0 OR n_rows % 2 = 0""")
def upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored run table after new runs were added and others replaced, some of them twice in one upsert."""
    path, found = fresh_path(spark, "run-table"), runs(spark, sf_dir).select("run_id", "domain_id", "stage", "n_rows", "r2", "created_at")
    first = run_store.upsert(spark, path, found.where("n_rows % 3 <> 0"), "run_id", ["created_at"])
    changed = found.where("n_rows % 2 = 0").withColumn("stage", F.lit("archived"))
    later = changed.withColumn("r2", F.col("r2") + 2).withColumn("created_at", F.col("created_at") + F.expr("interval 2 days"))
    run_store.upsert(spark, path, changed.withColumn("r2", F.col("r2") + 1).unionByName(later), "run_id", ["created_at"], first.number)
    return run_store.read(spark, path).select("run_id", "domain_id", "stage", "n_rows", rounded("r2").alias("r2"))


@job(f"""
    WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, run_id DESC) AS nth FROM runs WHERE stage = 'production')
    SELECT domain_id, run_id, created_at, r2 FROM r WHERE nth = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_ops.latest_per_key(runs(spark, sf_dir).where("stage = 'production'"), "domain_id", "created_at", "run_id").select("domain_id", "run_id", "created_at", "r2")


_PAIRS = f"""{RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, run_id DESC) AS nth FROM runs WHERE stage = 'production' AND domain_id <> '5-LOW'),
    pairs AS (SELECT s.*, r.run_id AS champion_run_id, r.metric_name AS champion_metric_name, r.metric_value AS champion_metric_value, r.coverage AS champion_coverage, r.worst_slice AS champion_worst_slice FROM runs s LEFT JOIN (SELECT * FROM r WHERE nth = 1) r USING (domain_id) WHERE s.stage = 'staging')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_ops.champion_challenger(runs(spark, sf_dir).where("not (stage = 'production' and domain_id = '5-LOW')"))


@job(f"WITH {_PAIRS} SELECT run_id, metric_name, metric_value, champion_run_id, champion_metric_value FROM pairs")
def champion_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("run_id", "metric_name", "metric_value", "champion_run_id", "champion_metric_value")


def _gate_sql(coverage: str, contracts: str, word: str, skipped: bool) -> str:
    reasons = [f"CASE WHEN {n} THEN 'PASS' ELSE 'FAIL' END || ' {n}'" for n in registry_ops.CRITERIA]
    reasons[1] = f"CASE WHEN coverage IS NULL THEN '{word}' WHEN coverage_meets_request THEN 'PASS' ELSE 'FAIL' END || ' coverage_meets_request'"
    if skipped:
        reasons[2] = "'SKIPPED contracts_pass'"
    return f"""
    WITH {_PAIRS}, d AS (SELECT *, CASE metric_name WHEN 'r2' THEN 1 WHEN 'rmse' THEN -1 END AS sign, coalesce(metric_name = champion_metric_name, false) AS same FROM pairs),
    g AS (SELECT *, CASE WHEN same THEN round(sign * (metric_value - champion_metric_value), 9) END AS gain, CASE WHEN same THEN round(sign * (worst_slice - champion_worst_slice), 9) END AS delta FROM d),
    c AS (SELECT *, champion_run_id IS NULL OR coalesce(gain >= 0.005, false) AS beats_champion, CASE WHEN coverage IS NULL THEN {coverage} ELSE round(coverage, 9) >= 0.85 END AS coverage_meets_request, {contracts} AS contracts_pass,
        CASE WHEN worst_slice IS NULL THEN false WHEN delta IS NULL THEN true ELSE delta >= 0 END AS worst_slice_not_worse, coalesce(n_leaks = 0, false) AS no_target_leakage FROM g)
    SELECT run_id, {" AND ".join(registry_ops.CRITERIA)} AS promoted, concat_ws('; ', {", ".join(reasons)}) AS reasons, round(gain, 6) AS gain, round(coverage - 0.9, 6) AS coverage_gap, round(delta, 6) AS worst_slice_delta FROM c"""


def _decisions(found: DataFrame) -> DataFrame:
    metrics = [rounded(F.col("metrics")[n]).alias(n) for n in ("gain", "coverage_gap", "worst_slice_delta")]
    return found.select("run_id", "promoted", F.array_join("reasons", "; ").alias("reasons"), *metrics)


@job(_gate_sql("false", "contract_ok", "FAIL", False))
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five criteria for every challenger, in its metric's own direction, with the numbers behind them."""
    return _decisions(registry_ops.promotion_gate(_pairs(spark, sf_dir)))


@job(_gate_sql("true", "false", "WAIVED", True))
def promotion_gate_waived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with unmeasured coverage waived and contracts not asked for, which the reasons record."""
    return _decisions(registry_ops.promotion_gate(_pairs(spark, sf_dir), registry_ops.GateConfig(require_coverage=False, require_contracts=False)))


@job(f"""
    WITH {RUNS_SQL}, c AS (SELECT domain_id, run_id AS name, CASE WHEN domain_id = '2-HIGH' THEN -1 ELSE 1 END * CASE WHEN n_rows % 8 <> 0 THEN r2 END AS s, (n_rows % 3)::BIGINT AS tier, (n_rows % 10) / 10.0 AS fit_seconds, n_rows % 2 = 0 AS portable FROM runs),
    r AS (SELECT *, CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY domain_id ORDER BY s DESC NULLS LAST, tier, fit_seconds, name) END AS place FROM c)
    SELECT domain_id, name, place, s IS NULL AS skipped, coalesce(place = min(place) FILTER (portable AND s IS NOT NULL) OVER (PARTITION BY domain_id), false) AS selected,
        round(max(s) OVER (PARTITION BY domain_id) - max(s) FILTER (portable) OVER (PARTITION BY domain_id), 6) AS gap FROM r""")
def rank_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_rows")
    metric = F.when(F.col("domain_id") == "2-HIGH", "rmse").otherwise("r2")
    rows = runs(spark, sf_dir).select("domain_id", F.col("run_id").alias("name"), metric.alias("metric_name"), F.when(n % 8 != 0, F.col("r2")).alias("metric_value"), (n % 3).alias("tier"), ((n % 10) / 10).alias("fit_seconds"), (n % 2 == 0).alias("portable"))
    return registry_ops.rank_leaderboard(rows, "domain_id").select("domain_id", "name", "place", "skipped", "selected", rounded("gap").alias("gap"))


@job(f"WITH {RUNS_SQL} SELECT run_id, stage, r2 FROM runs WHERE domain_id = '1-URGENT' AND stage <> 'archived' AND created_at >= TIMESTAMP '1996-01-01' ORDER BY created_at DESC, run_id DESC LIMIT 20")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(spark, sf_dir).where("domain_id = '1-URGENT' and stage <> 'archived' and created_at >= timestamp'1996-01-01'")
    return found.orderBy(F.desc("created_at"), F.desc("run_id")).limit(20).select("run_id", "stage", "r2")


@job("""
    WITH a AS (SELECT l_orderkey, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity - 25, (l_discount - 0.05) * 200, (l_tax - 0.04) * 100]) AS contribution FROM lineitem)
    SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs, round(avg(contribution), 6) AS mean_signed, round(sum(abs(contribution)) / (SELECT sum(abs(contribution)) FROM a), 6) AS share FROM a GROUP BY 1""")
def attribution_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).cast("double").alias("quantity"), ((F.col("l_discount") - 0.05) * 200).alias("discount"), ((F.col("l_tax") - 0.04) * 100).alias("tax"))
    long = unpivot(lines, [], ["quantity", "discount", "tax"], "feature", "contribution", "double")
    c = F.col("contribution")
    per = long.groupBy("feature").agg(F.avg(F.abs(c)).alias("mean_abs"), F.avg(c).alias("mean_signed"), F.sum(F.abs(c)).alias("total"))
    return per.select("feature", rounded("mean_abs").alias("mean_abs"), rounded("mean_signed").alias("mean_signed"), rounded(F.col("total") / F.sum("total").over(Window.partitionBy())).alias("share"))


_TERMS = {"quantity": ("l_quantity", "l_quantity - 25", "items"), "discount": ("l_discount", "(l_discount - 0.05) * 200", ""), "tax": ("l_tax", "(l_tax - 0.04) * 100", ""), "price": ("l_extendedprice", "(l_extendedprice - 5000) / 1000", "USD")}
_ROW = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def _reasons_sql(sentence: str) -> str:
    unit = " ".join(f"WHEN '{n}' THEN '{' ' + u if u else ''}'" for n, (_, _, u) in _TERMS.items())
    return f"""
    WITH a AS (SELECT {_ROW}, unnest({list(_TERMS)}) AS f, unnest([{", ".join(v for v, _, _ in _TERMS.values())}]) AS v, unnest([{", ".join(c for _, c, _ in _TERMS.values())}]) AS c FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY {_ROW} ORDER BY abs(c) DESC, f) AS nth FROM a),
    s AS (SELECT *, f || ' = ' || {PLAIN_NUMBER_SQL.format(c="v")} || CASE f {unit} END AS what FROM r WHERE nth <= 3)
    SELECT {_ROW.replace("l_extendedprice", "round(l_extendedprice, 2) AS l_extendedprice")}, string_agg({sentence}, '; ' ORDER BY nth) AS reasons FROM s GROUP BY ALL"""


def _reasons(spark: SparkSession, sf_dir: str, target_class: str | None, unit: str = "") -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    terms = [(n, F.col(v).cast("double"), F.expr(c).cast("double"), u) for n, (v, c, u) in _TERMS.items()]
    text = registry_ops.reason_codes(terms, 3, target_class, unit)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 2).alias("l_extendedprice"), F.array_join(text, "; ").alias("reasons"))


@job(_reasons_sql("what || ' pushed the estimate ' || CASE WHEN c >= 0 THEN 'up' ELSE 'down' END || ' by ' || " + PLAIN_NUMBER_SQL.format(c="abs(c)") + " || ' points'"))
def reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest contributions of each row as text, within the row: no shuffle."""
    return _reasons(spark, sf_dir, None, "points")


@job(_reasons_sql("what || ' pushed the prediction ' || CASE WHEN c >= 0 THEN 'toward' ELSE 'away from' END || ' ''high'' (weight ' || printf('%.2f', floor(abs(c) * 100 + 0.5) / 100) || ')'"))
def reason_codes_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir, "high")
