"""Jobs on generated worlds and on frames that are moved, re-weighted or taken apart on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import explain, stress
from ..operators import world as w
from .frames import _SCORE, LINE_SQL, SCORER, SEED, _uniform, line, read
from .registry import job

_WORLD_SEED = 11


def _u(key: str, stream: str) -> str:
    return _uniform(key, _WORLD_SEED, stream)


def _z(key: str, stream: str) -> str:
    return f"(sqrt(-2 * ln(greatest({_u(key, stream + '.u')}, 1e-12))) * cos(2 * pi() * {_u(key, stream + '.v')}))"


def _weighted(key: str, stream: str, levels: dict[str, int]) -> str:
    top, total, cases = 0, sum(levels.values()), []
    for name, weight in levels.items():
        top += weight
        cases.append(f"WHEN {_u(key, stream)} < {top}::DOUBLE / {total} THEN '{name}'")
    return f"CASE {' '.join(cases)} END"


def _case(column: str, table: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"


def _journey(i: int) -> str:
    return _case("route_class", {k: v[i] for k, v in w.JOURNEYS.items()})


_K = "shipment_id"
_PACKAGING = "CASE product_class " + " ".join(f"WHEN '{p}' THEN {_weighted(_K, 'packaging', levels)}" for p, levels in w.PACKAGING.items()) + " END"
_RISK_SQL = "34.0 + " + " + ".join(f"coalesce({_case(t.name, t.effects)}, 0)" for t in w.RISK.terms[:4]) + """ + 8.0 * tanh((transit_hours - 69.0) / 63.0) + 7.0 * ((ambient_temp_c - 18.0) / 22.0) + 4.5 * ((handoff_count - 3.0) / 3.0)
    + 4.0 * ln(1 + sensor_gap_minutes / 110.0) + CASE packaging_type WHEN 'passive_gel' THEN 7.0 * ((transit_hours - 69.0) / 63.0) ELSE 0 END"""
_WORLD_SQL = f"""
carrier AS (SELECT s_suppkey AS carrier_id, {_weighted("s_suppkey", "tier", w.TIERS)} AS carrier_tier FROM supplier WHERE s_suppkey % 10 <> 0),
facility AS (SELECT c_custkey AS facility_id, {_weighted("c_custkey", "region", w.REGIONS)} AS origin_region FROM customer),
first AS (SELECT l_orderkey, min(l_suppkey) AS carrier_id FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS shipment_id, carrier_id, o_custkey AS facility_id, o_orderdate AS booked_at, o_orderstatus = 'F' AS delivered FROM orders LEFT JOIN first ON l_orderkey = o_orderkey),
s1 AS (SELECT b.*, coalesce(carrier_tier, 'standard') AS carrier_tier, coalesce(origin_region, 'emea') AS origin_region, {_weighted(_K, "route", w.ROUTES)} AS route_class, {_weighted(_K, "product", w.PRODUCTS)} AS product_class
    FROM b LEFT JOIN carrier USING (carrier_id) LEFT JOIN facility USING (facility_id)),
s2 AS (SELECT *, {_PACKAGING} AS packaging_type, round({_journey(0)} + ({_journey(1)} - {_journey(0)}) * {_u(_K, "transit")}, 2) AS transit_hours, {_journey(2)} + floor(({_journey(3)} - {_journey(2)} + 1) * {_u(_K, "handoffs")}) AS handoff_count,
    round(CASE WHEN {_u(_K, "ambient")} < 0.5 THEN -4.0 + sqrt({_u(_K, "ambient")} * 44.0 * 22.0) ELSE 40.0 - sqrt((1 - {_u(_K, "ambient")}) * 44.0 * 22.0) END, 2) AS ambient_temp_c,
    round(least(greatest(exp(3.6 + 0.9 * {_z(_K, "payload")}), 5.0), 900.0), 2) AS payload_kg,
    round(least({_case("carrier_tier", w.GAP_SCALES)} * 1.6 * pow(greatest(0.0, 1 - 1 / 14.4 + {_z(_K, "gap")} / (3 * sqrt(1.6))), 3), 540.0), 1) AS sensor_gap_minutes,
    date_trunc('second', booked_at) + to_seconds(floor(3600 * (2 + 46 * {_u(_K, "dispatch")}))::BIGINT) AS dispatched_at FROM s1),
s3 AS (SELECT *, {_RISK_SQL} AS signal FROM s2), v AS (SELECT sqrt(var_pop(signal) FILTER (delivered) * 0.26 / 0.74) AS total FROM s3),
shipment AS (SELECT * REPLACE (CASE WHEN {_u(_K, "hole")} >= CASE carrier_tier WHEN 'economy' THEN 0.08 ELSE 0.03 END THEN sensor_gap_minutes END AS sensor_gap_minutes),
    CASE WHEN delivered THEN round(least(greatest(signal + total * (sqrt(0.4) * {_z(_K, "confounder")} + sqrt(0.6) * {_z(_K, "noise")}), 0), 100), 3) END AS spoilage_risk_pct FROM s3, v)"""


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments for the given orders, carried by the first supplier of their lines, from the customer's facility."""
    lines = read(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("carrier_id"))
    orders = read(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    bookings = orders.select(F.col("o_orderkey").alias("shipment_id"), "carrier_id", F.col("o_custkey").alias("facility_id"), F.col("o_orderdate").alias("booked_at"), (F.col("o_orderstatus") == "F").alias("delivered"))
    carrier = w.carriers(read(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("carrier_id")))
    facility = w.facilities(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("facility_id")))
    return w.shipments(bookings, carrier, facility)


_SHOWN = ("shipment_id", "carrier_tier", "origin_region", "route_class", "product_class", "packaging_type", "transit_hours", "handoff_count", "ambient_temp_c", "payload_kg", "sensor_gap_minutes", "spoilage_risk_pct")


@job(f"""
    WITH {_WORLD_SQL}, logged AS (SELECT l_orderkey AS shipment_id, count(*) AS n_readings, round(sum(temperature_c), 2) AS total_temperature FROM
        (SELECT l_orderkey, round(2.1 + 5.8 * {_u("concat_ws('/', l_orderkey, l_linenumber)", "temperature")}, 2) AS temperature_c FROM lineitem) GROUP BY 1)
    SELECT {", ".join(_SHOWN)}, n_readings, total_temperature FROM shipment JOIN logged USING (shipment_id)""")
def generate_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders become shipments with carriers, facilities, drivers and labels; their lines become readings."""
    shipment = world(spark, sf_dir)
    logged = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shipment_id"), F.col("l_linenumber").alias("nth"))
    read_out = w.readings(shipment, logged).groupBy("shipment_id").agg(F.count("*").alias("n_readings"), F.round(F.sum("temperature_c"), 2).alias("total_temperature"))
    return shipment.select(*_SHOWN).join(read_out, "shipment_id")


@job(f"WITH {_WORLD_SQL} SELECT shipment_id, round(least(greatest(signal, 0), 100), 6) AS risk FROM s3")
def domain_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worked latent model: four level tables, four shaped drivers and a gated interaction, clamped."""
    return world(spark, sf_dir).select("shipment_id", rounded(F.least(F.greatest("signal", F.lit(0.0)), F.lit(100.0))).alias("risk"))


_MOVED = ("l_quantity", "l_discount", "p_size")


def _rarest(frame: str, column: str, n: int) -> str:
    """A frame whose rarest level of a column counts three times, if it has under half of the rows."""
    return f"""
    c{n} AS (SELECT {column} AS level, sum(copies) AS m FROM {frame} GROUP BY 1), r{n} AS (SELECT min_by(level, (m, level)) AS level, min(m) < sum(m) // 2 AND count(*) > 1 AS fires FROM c{n} WHERE level IS NOT NULL),
    x{n} AS (SELECT {frame}.* REPLACE (copies * CASE WHEN fires AND {column} = level THEN 3 ELSE 1 END AS copies) FROM {frame}, r{n})"""


@job(f"""
    WITH {LINE_SQL}, sd AS (SELECT {", ".join(f"stddev_samp({c}) AS sd_{c}" for c in _MOVED)} FROM line),
    m AS (SELECT key, l_returnflag, o_orderpriority, {", ".join(f"{c} * 1.5 + 0.5 * sd_{c} AS {c}" for c in _MOVED)} FROM line, sd),
    g AS (SELECT l_quantity AS v, count(*) AS c FROM m WHERE l_quantity IS NOT NULL GROUP BY 1), p AS (SELECT v, 0.25 + 1.5 * (sum(c) OVER (ORDER BY v) - c + (c + 1) / 2) / sum(c) OVER () AS weight FROM g),
    q AS (SELECT m.*, coalesce(weight, 1.0) AS weight FROM m LEFT JOIN p ON l_quantity = v), k AS (SELECT * EXCLUDE (weight), 1::BIGINT AS copies FROM q WHERE {_uniform("key", SEED, "thin")} < weight / (SELECT max(weight) FROM q)),
    {_rarest("k", "l_returnflag", 1)}, {_rarest("x1", "o_orderpriority", 2)}
    SELECT key, l_returnflag, o_orderpriority, {", ".join(f"round({c}, 6) AS {c}" for c in _MOVED)}, unnest(range(1, copies + 1))::INT AS copy FROM x2""")
def stress_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers moved and stretched, rows thinned by rank, the rarest level of each categorical tripled."""
    df = line(spark, sf_dir).select("key", "l_returnflag", "o_orderpriority", *_MOVED)
    found = stress.stress_shift(df, "key", list(_MOVED), ["l_returnflag", "o_orderpriority"], 0.5, SEED)
    return found.select("key", "l_returnflag", "o_orderpriority", *[rounded(c).alias(c) for c in _MOVED], "copy")


_GRIDS: dict[str, list] = {
    "l_quantity": [1.0 + i * 49 / 19 for i in range(20)], "l_discount": [i * 0.1 / 19 for i in range(20)], "p_size": [1.0 + i * 49 / 19 for i in range(20)],
    "l_returnflag": ["A", "N", "R"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}


def _points_sql(feature: str) -> str:
    grid = _GRIDS[feature]
    if isinstance(grid[0], str):
        return f"(SELECT unnest(range({len(grid)}))::INT AS point, unnest({grid}) AS v)"
    low, step = {"l_discount": ("0.0", "0.1")}.get(feature, ("1.0", "49"))
    return f"(SELECT i::INT AS point, {low} + i * {step} / 19 AS v FROM range(20) t(i))"


def _response_sql(feature: str) -> str:
    return f"least(greatest({_SCORE.replace(feature, 'g.v')}, 0.0), 100.0)"


def _support_sql(feature: str) -> str:
    grid = _GRIDS[feature]
    if isinstance(grid[0], str):
        return f"list_position({grid}, {feature}) - 1"
    return f"CASE WHEN {feature} IS NOT NULL THEN least(greatest(round(({feature} - {grid[0]}) / ({grid[-1]} - {grid[0]}) * 19), 0), 19) END"


@job(f"""
    WITH {LINE_SQL}, p AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, point, avg({_response_sql(f)}) AS response FROM line, {_points_sql(f)} g GROUP BY point" for f in _GRIDS)}),
    s AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, ({_support_sql(f)})::INT AS point, count(*) AS n FROM line GROUP BY 2" for f in _GRIDS)})
    SELECT feature, point, round(response, 5) AS response, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY feature), 6) AS support_share, round(max(response) OVER (PARTITION BY feature) - min(response) OVER (PARTITION BY feature), 5) AS swing
    FROM p LEFT JOIN s USING (feature, point)""")
def partial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean response at each point of every feature's grid, over all rows, with support and swing."""
    found = explain.partial_dependence(line(spark, sf_dir), _GRIDS, SCORER.signal)
    return found.select("feature", "point", rounded("response", 5).alias("response"), rounded("support_share").alias("support_share"), rounded("swing", 5).alias("swing"))


@job(f"""
    WITH {LINE_SQL}, few AS (SELECT * FROM line ORDER BY {_uniform("key", SEED, "ice")}, key LIMIT 50)
    {" UNION ALL ".join(f"SELECT key, '{f}' AS feature, point, round({_response_sql(f)}, 5) AS response FROM few, {_points_sql(f)} g" for f in ("l_quantity", "o_orderpriority"))}""")
def individual_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same curves for single rows: fifty, by hash."""
    found = explain.individual_curves(line(spark, sf_dir), "key", {f: _GRIDS[f] for f in ("l_quantity", "o_orderpriority")}, SCORER.signal, 50, SEED)
    return found.withColumn("response", rounded("response", 5))
