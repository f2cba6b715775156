"""The library's problems on the given tables, and the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from ..operators.latent import Driver, Interaction, LatentModel, Levels
from ..spec import Feature, Problem

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

LINE = Problem(
    (
        Feature("l_returnflag", "categorical", ("A", "N", "R")),
        Feature("l_linestatus", "categorical", ("F", "O")),
        Feature("o_orderpriority", "categorical", PRIORITIES),
        Feature("l_quantity", "numeric", minimum=1, maximum=50),
        Feature("l_discount", "numeric", minimum=0, maximum=0.1),
        Feature("l_tax", "numeric", minimum=0, maximum=0.08),
        Feature("p_size", "numeric", minimum=1, maximum=50),
    ),
    Feature("y", "numeric"),
)
MODEL = LatentModel(
    30.0,
    (
        Driver("l_quantity", 8.0, "tanh", 25.0, 10.0),
        Driver("l_discount", 5.0, "log1p", 0.0, 0.05),
        Driver("p_size", 3.0, "sqrt", 1.0, 10.0),
        Levels("l_returnflag", {"A": 4.0, "R": -3.0}),
        Levels("o_orderpriority", {"1-URGENT": 5.0, "2-HIGH": 2.0}),
        Interaction("l_quantity", "p_size", 0.004),
        Interaction("l_discount", "l_linestatus", 40.0, "O"),
    ),
    0.0,
    100.0,
)
SCORER = MODEL.only(Driver, Levels)
SIGMA, SEED = 4.0, 7
CLASSES = ("high", "low", "mid")
CUTS = (32.0, 40.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their dimensions, a latent target y and a scorer's prediction pred."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    customers, parts = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    customers = customers.select("c_custkey", "c_mktsegment")
    orders = orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")  # so lines are dealt once less
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    df = df.select(
        key.alias("key"), "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus",
        F.coalesce("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"), F.coalesce("c_mktsegment", F.lit("MACHINERY")).alias("c_mktsegment"),
        F.coalesce("p_type", F.lit("UNKNOWN")).alias("p_type"), F.col("l_quantity").cast("double").alias("l_quantity"), "l_discount", "l_tax", F.col("p_size").cast("double").alias("p_size"), "l_extendedprice", "l_shipdate", "o_orderdate",
    ).withColumn("signal", MODEL.signal())
    noise = sum((hash_uniform("key", SEED, f"noise{i}") for i in range(3)), F.lit(-1.5)) * 2
    return df.withColumn("y", F.col("signal") + SIGMA * noise).withColumn("pred", SCORER.signal())


def _uniform(key: str, seed: int, stream: str) -> str:
    return f"(('0x' || substr(md5({key} || ':{seed}:{stream}'), 1, 8))::BIGINT / 4294967296.0)"


_SCORE = """30.0 + coalesce(8.0 * tanh((l_quantity - 25.0) / 10.0), 0) + coalesce(5.0 * ln(1 + greatest(l_discount / 0.05, -0.999999)), 0)
    + coalesce(3.0 * sqrt(greatest((p_size - 1.0) / 10.0, 0)), 0) + CASE l_returnflag WHEN 'A' THEN 4.0 WHEN 'R' THEN -3.0 ELSE 0 END
    + CASE o_orderpriority WHEN '1-URGENT' THEN 5.0 WHEN '2-HIGH' THEN 2.0 ELSE 0 END"""
SIGNAL_SQL = f"({_SCORE} + coalesce(0.004 * l_quantity * p_size, 0) + CASE WHEN l_linestatus = 'O' THEN coalesce(40.0 * l_discount, 0) ELSE 0 END)"
LINE_SQL = f"""
line0 AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS key,
        l_orderkey, l_partkey, l_returnflag, l_linestatus, coalesce(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, coalesce(c_mktsegment, 'MACHINERY') AS c_mktsegment,
        coalesce(p_type, 'UNKNOWN') AS p_type, CAST(l_quantity AS DOUBLE) AS l_quantity, l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, l_extendedprice, l_shipdate, o_orderdate
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey),
line1 AS (
    SELECT *, least(greatest({SIGNAL_SQL}, 0.0), 100.0) AS signal,
        least(greatest({_SCORE}, 0.0), 100.0) AS pred
    FROM line0),
line AS (
    SELECT *, signal + {SIGMA} * 2 * (-1.5 + {" + ".join(_uniform("key", SEED, f"noise{i}") for i in range(3))}) AS y FROM line1)"""


def classes(df: DataFrame) -> DataFrame:
    """True class of y, class probabilities from pred (by name of class) and the class of greatest probability."""
    truth = F.when(F.col("y") < CUTS[0], "low").when(F.col("y") < CUTS[1], "mid").otherwise("high")
    near = {c: 1 / (1 + F.abs(F.col("pred") - m)) for c, m in (("high", 46.0), ("low", 26.0), ("mid", 36.0))}
    total = near["high"] + near["low"] + near["mid"]
    df = df.withColumn("truth", truth)
    for c in CLASSES:
        df = df.withColumn(f"p_{c}", near[c] / total)
    most = F.greatest("p_high", "p_low", "p_mid")
    return df.withColumn("predicted", F.when(F.col("p_high") == most, "high").when(F.col("p_low") == most, "low").otherwise("mid"))


CLASS_SQL = """
cls0 AS (
    SELECT *, CASE WHEN y < 32 THEN 'low' WHEN y < 40 THEN 'mid' ELSE 'high' END AS truth,
        1 / (1 + abs(pred - 46)) AS n_high, 1 / (1 + abs(pred - 26)) AS n_low, 1 / (1 + abs(pred - 36)) AS n_mid FROM line),
cls1 AS (
    SELECT *, n_high / (n_high + n_low + n_mid) AS p_high, n_low / (n_high + n_low + n_mid) AS p_low, n_mid / (n_high + n_low + n_mid) AS p_mid FROM cls0),
cls AS (
    SELECT *, CASE WHEN p_high = greatest(p_high, p_low, p_mid) THEN 'high' WHEN p_low = greatest(p_high, p_low, p_mid) THEN 'low' ELSE 'mid' END AS predicted FROM cls1)"""


def holes(df: DataFrame, column: str = "l_tax", rate: float = 0.03, level_column: str = "l_linestatus", level: str = "O", level_rate: float = 0.08, seed: int = SEED) -> DataFrame:
    """Missing at random: more often on one level."""
    p = F.when(F.col(level_column) == level, level_rate).otherwise(rate)
    return df.withColumn(column, F.when(hash_uniform("key", seed, f"hole.{column}") >= p, F.col(column)))


HOLES_SQL = f"""
holed AS (
    SELECT * REPLACE (CASE WHEN {_uniform("key", SEED, "hole.l_tax")} >= CASE WHEN l_linestatus = 'O' THEN 0.08 ELSE 0.03 END THEN l_tax END AS l_tax) FROM line)"""


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return events.select("event_id", "ts", F.col("event_type").alias("run_id"), F.col("user_id").alias("tenant_id"), F.sha2(F.concat(F.lit('{"k":"'), F.coalesce(k, F.lit("null")), F.lit('"}')), 256).alias("feature_digest"), F.col("value").alias("prediction"), F.create_map(F.lit("k"), k).alias("features"))


LOG_SQL = """
plog AS (
    SELECT event_id, ts, event_type AS run_id, user_id AS tenant_id, sha256('{"k":"' || coalesce(props->>'k', 'null') || '"}') AS feature_digest, value AS prediction, props->>'k' AS k FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs as a registry holds them: one for each order priority (domain) and month."""
    orders = read(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    df = orders.groupBy(F.col("o_orderpriority").alias("domain_id"), month.alias("month")).agg(F.max("o_orderdate").alias("created_at"), F.count("*").alias("n_rows"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("n_f"))
    m = F.substring("month", 6, 2).cast("int")
    stage = F.when(m % 3 == 0, "production").when(m % 3 == 1, "staging").otherwise("archived")
    return df.select(
        F.concat_ws("/", "domain_id", "month").alias("run_id"), "domain_id", "created_at", stage.alias("stage"), "n_rows",
        F.when(F.col("n_rows") % 6 == 0, "rmse").otherwise("r2").alias("metric_name"), F.round(0.5 + (F.col("n_rows") % 37) / 100, 4).alias("r2"), F.round(0.5 + (F.col("n_rows") % 37) / 100, 4).alias("metric_value"), F.when(F.col("n_rows") % 5 != 0, F.round(0.8 + (F.col("n_rows") % 19) / 100, 4)).alias("coverage"),
        F.when(F.col("n_rows") % 7 != 0, F.round(0.3 + (F.col("n_f") % 29) / 100, 4)).alias("worst_slice"), (F.col("n_rows") % 11 != 0).alias("contract_ok"), F.when(F.col("n_rows") % 17 != 0, F.col("n_rows") % 4).cast("long").alias("n_leaks"),
    )


RUNS_SQL = """
runs0 AS (
    SELECT o_orderpriority AS domain_id, strftime(o_orderdate, '%Y-%m') AS month, max(o_orderdate) AS created_at, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_f
    FROM orders GROUP BY 1, 2),
runs AS (
    SELECT domain_id || '/' || month AS run_id, domain_id, created_at,
        CASE substr(month, 6, 2)::INT % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'archived' END AS stage, n_rows,
        CASE WHEN n_rows % 6 = 0 THEN 'rmse' ELSE 'r2' END AS metric_name, round(0.5 + (n_rows % 37) / 100.0, 4)::DOUBLE AS r2, round(0.5 + (n_rows % 37) / 100.0, 4)::DOUBLE AS metric_value, CASE WHEN n_rows % 5 <> 0 THEN round(0.8 + (n_rows % 19) / 100.0, 4)::DOUBLE END AS coverage,
        CASE WHEN n_rows % 7 <> 0 THEN round(0.3 + (n_f % 29) / 100.0, 4)::DOUBLE END AS worst_slice, n_rows % 11 <> 0 AS contract_ok, CASE WHEN n_rows % 17 <> 0 THEN n_rows % 4 END AS n_leaks
    FROM runs0)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day and priority, days without orders as 0."""
    from ..operators.forecast import fill_gaps

    orders = read(spark, sf_dir, "orders")
    counted = orders.groupBy(F.col("o_orderpriority").alias("unique_id"), F.date_trunc("day", "o_orderdate").alias("ds")).agg(F.count("*").cast("double").alias("y"))
    return fill_gaps(counted)


SERIES_SQL = """
points AS (
    SELECT o_orderpriority AS unique_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ds, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2),
spans AS (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM points GROUP BY 1),
series AS (SELECT s.unique_id, s.ds, coalesce(p.y, 0.0) AS y FROM spans s LEFT JOIN points p USING (unique_id, ds))"""
