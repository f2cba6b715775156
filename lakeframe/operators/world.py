"""A world of carriers, facilities, shipments and readings on top of given keys and times, whatever the partitioning.

Who ships what and when comes from tables; everything else is drawn by hashes of the shipment's key, so a world grows
with its tables and is drawn again alike.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_normal, hash_uniform
from .latent import Driver, Interaction, LatentModel, Levels

# Levels with their weights, journeys, telemetry intervals and the drivers of the risk.
TIERS = {"economy": 3, "standard": 4, "premium": 2, "validated": 1}
ROUTES = {"direct": 3, "single_transfer": 4, "multi_leg": 2, "last_mile_pool": 2}
REGIONS = {"emea": 4, "amer": 3, "apac": 3, "latam": 2}
PRODUCTS = {"vaccine": 3, "biologic": 3, "small_molecule": 3, "diagnostic_kit": 2}
PACKAGING = {
    "vaccine": {"passive_gel": 2, "passive_pcm": 4, "active_electric": 3, "dry_ice": 2},
    "biologic": {"passive_gel": 2, "passive_pcm": 3, "active_electric": 3, "dry_ice": 3},
    "small_molecule": {"passive_gel": 4, "passive_pcm": 3, "active_electric": 2, "dry_ice": 1},
    "diagnostic_kit": {"passive_gel": 5, "passive_pcm": 3, "active_electric": 1, "dry_ice": 1},
}
JOURNEYS = {"direct": (8.0, 36.0, 0, 1), "single_transfer": (18.0, 64.0, 1, 2), "multi_leg": (48.0, 132.0, 3, 7), "last_mile_pool": (12.0, 54.0, 2, 4)}
GAP_SCALES = {"economy": 70.0, "standard": 50.0, "premium": 35.0, "validated": 25.0}
RISK = LatentModel(
    34.0,
    (
        Levels("carrier_tier", {"economy": 8.0, "standard": 2.0, "premium": -2.5, "validated": -7.0}),
        Levels("route_class", {"direct": -6.0, "single_transfer": -1.0, "multi_leg": 6.5, "last_mile_pool": 3.5}),
        Levels("packaging_type", {"passive_gel": 6.0, "passive_pcm": 1.0, "active_electric": -6.0, "dry_ice": -2.5}),
        Levels("product_class", {"vaccine": 4.5, "biologic": 2.0, "small_molecule": -3.5, "diagnostic_kit": -3.0}),
        Driver("transit_hours", 8.0, "tanh", 69.0, 63.0),
        Driver("ambient_temp_c", 7.0, "identity", 18.0, 22.0),
        Driver("handoff_count", 4.5, "identity", 3.0, 3.0),
        Driver("sensor_gap_minutes", 4.0, "log1p", 0.0, 110.0),
        Interaction("transit_hours", "packaging_type", 7.0, "passive_gel", 69.0, 63.0),
    ),
    0.0,
    100.0,
)
TARGET_R2, CONFOUNDER_SHARE = 0.74, 0.4
#: Shares of holes in sensor_gap_minutes on economy carriers and on others.
HOLES = (0.08, 0.03)


def weighted(u: Column, levels: dict[str, int]) -> Column:
    """A level by its weight, for u in [0, 1)."""
    tops = list(accumulate(levels.values()))
    out = F.lit(list(levels)[-1])
    for name, top in reversed(list(zip(levels, tops, strict=True))[:-1]):
        out = F.when(u < top / tops[-1], name).otherwise(out)
    return out


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    cut = (mode - low) / (high - low)
    return F.when(u < cut, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def gamma(z: Column, shape: float) -> Column:
    """From a standard normal, by the cube-root approximation."""
    x = F.greatest(F.lit(0.0), 1 - 1 / (9 * shape) + z / (3 * shape**0.5))
    return shape * x * x * x


def carriers(keys: DataFrame, seed: int = 11) -> DataFrame:
    """carrier_id with a tier and a rate, for every carrier_id of keys."""
    return keys.select("carrier_id", weighted(hash_uniform("carrier_id", seed, "tier"), TIERS).alias("carrier_tier"), F.round(0.7 + 0.29 * hash_uniform("carrier_id", seed, "on_time"), 4).alias("on_time_rate"))


def facilities(keys: DataFrame, seed: int = 11) -> DataFrame:
    return keys.select("facility_id", weighted(hash_uniform("facility_id", seed, "region"), REGIONS).alias("origin_region"), (hash_uniform("facility_id", seed, "power") < 0.6).alias("has_backup_power"))


def shipments(bookings: DataFrame, carrier: DataFrame, facility: DataFrame, seed: int = 11) -> DataFrame:
    """A shipment for each row (shipment_id, carrier_id, facility_id, booked_at, delivered) of bookings.

    Unknown carriers count as standard, unknown facilities as of emea. Delivered ones get a label: the risk's signal, a
    share that nothing observed explains, and noise, scaled so that TARGET_R2 is what the signal can explain. Holes come
    last, so that they do not move the label.
    """
    u = lambda stream: hash_uniform("shipment_id", seed, stream)
    rows = bookings.join(carrier, "carrier_id", "left").join(facility, "facility_id", "left")
    rows = rows.withColumn("carrier_tier", F.coalesce("carrier_tier", F.lit("standard"))).withColumn("origin_region", F.coalesce("origin_region", F.lit("emea")))
    rows = rows.withColumn("route_class", weighted(u("route"), ROUTES)).withColumn("product_class", weighted(u("product"), PRODUCTS))
    of = lambda column, table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(column)]
    packaging = F.lit(None).cast("string")
    for product, levels in PACKAGING.items():
        packaging = F.when(F.col("product_class") == product, weighted(u("packaging"), levels)).otherwise(packaging)
    low, high, least, most = (of("route_class", {k: float(v[i]) for k, v in JOURNEYS.items()}) for i in range(4))
    # The numbers of ambient temperature, payload, gaps and dispatch.
    rows = rows.select(
        "shipment_id", "carrier_id", "facility_id", "booked_at", "delivered", "carrier_tier", "origin_region", "route_class", "product_class", packaging.alias("packaging_type"),
        F.round(low + (high - low) * u("transit"), 2).alias("transit_hours"), (least + F.floor((most - least + 1) * u("handoffs"))).alias("handoff_count"), F.round(triangular(u("ambient"), -4.0, 18.0, 40.0), 2).alias("ambient_temp_c"),
        F.round(F.least(F.greatest(F.exp(3.6 + 0.9 * hash_normal("shipment_id", seed, "payload")), F.lit(5.0)), F.lit(900.0)), 2).alias("payload_kg"),
        F.round(F.least(of("carrier_tier", GAP_SCALES) * gamma(hash_normal("shipment_id", seed, "gap"), 1.6), F.lit(540.0)), 1).alias("sensor_gap_minutes"),
        F.timestamp_seconds(F.unix_timestamp("booked_at") + F.floor(3600 * (2 + 46 * u("dispatch")))).alias("dispatched_at"),
    ).withColumn("signal", RISK.raw())
    spread = rows.agg(F.var_pop(F.when(F.col("delivered"), F.col("signal"))).alias("_v"))  # one row
    total = F.sqrt(F.coalesce("_v", F.lit(0.0)) * (1 - TARGET_R2) / TARGET_R2)
    unexplained = CONFOUNDER_SHARE**0.5 * hash_normal("shipment_id", seed, "confounder") + (1 - CONFOUNDER_SHARE) ** 0.5 * hash_normal("shipment_id", seed, "noise")
    risk = F.least(F.greatest(F.col("signal") + total * unexplained, F.lit(0.0)), F.lit(100.0))
    hole = F.when(F.col("carrier_tier") == "economy", HOLES[0]).otherwise(HOLES[1])
    rows = rows.crossJoin(F.broadcast(spread)).withColumn("spoilage_risk_pct", F.when(F.col("delivered"), F.round(risk, 3)))
    return rows.withColumn("sensor_gap_minutes", F.when(u("hole") >= hole, F.col("sensor_gap_minutes"))).drop("_v")


def readings(shipment: DataFrame, logged: DataFrame, seed: int = 11) -> DataFrame:
    """A reading of its shipment for each row (shipment_id, nth) of logged, some time on its way."""
    u = lambda stream: hash_uniform(F.concat_ws("/", "shipment_id", "nth"), seed, stream)
    rows = logged.join(shipment.select("shipment_id", "dispatched_at", "transit_hours"), "shipment_id")
    offset = F.floor(3600 * (0.5 + (F.greatest(F.lit(1.0), F.col("transit_hours")) - 0.5) * u("offset")))
    return rows.select("shipment_id", "nth", F.timestamp_seconds(F.unix_timestamp("dispatched_at") + offset).alias("recorded_at"), F.round(2.1 + 5.8 * u("temperature"), 2).alias("temperature_c"), (18 + F.floor(83 * u("battery"))).alias("battery_pct"))
