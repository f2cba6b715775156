"""Run tables: newest per key, rankings, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import by_direction, plain_number
from ..spec import SETTINGS
from .measure import HIGHER_IS_BETTER


def latest_per_key(df: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(id_))
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


#: The five criteria.
CRITERIA = ("beats_champion", "coverage_meets_request", "contracts_pass", "worst_slice_not_worse", "no_target_leakage")
_OF_CHAMPION = ("run_id", "metric_name", "metric_value", "coverage", "worst_slice")


@dataclass(frozen=True)
class GateConfig:
    """slice_tolerance: how much worse the worst slice may be. What is not required is waived, or skipped, on record."""

    min_gain: float = SETTINGS.promote_min_gain
    requested_coverage: float = SETTINGS.requested_coverage
    coverage_tolerance: float = SETTINGS.coverage_tolerance
    slice_tolerance: float = 0.0
    require_coverage: bool = True
    require_contracts: bool = True


def champion_challenger(runs: DataFrame) -> DataFrame:
    """Each staging run beside its domain's newest production run, if there is one."""
    champions = latest_per_key(runs.where("stage = 'production'"), "domain_id", "created_at", "run_id")
    champions = champions.select("domain_id", *[F.col(c).alias(f"champion_{c}") for c in _OF_CHAMPION])
    return runs.where("stage = 'staging'").join(champions, "domain_id", "left")


def promotion_gate(pairs: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """pairs with checks and metrics (maps), reasons (one for each criterion) and promoted.

    All five criteria are judged and required; what was not measured has not passed, unless it is waived. Gains and
    slices count in the metric's own direction; two metrics, or one of unknown direction, are not compared.
    """
    sign, first = by_direction("metric_name", HIGHER_IS_BETTER), F.col("champion_run_id").isNull()
    same = F.coalesce(F.col("metric_name") == F.col("champion_metric_name"), F.lit(False))
    gain = F.when(same, F.round(sign * (F.col("metric_value") - F.col("champion_metric_value")), 9))
    floor = round(config.requested_coverage - config.coverage_tolerance, 9)
    delta = F.when(same, F.round(sign * (F.col("worst_slice") - F.col("champion_worst_slice")), 9))
    no = F.lit(False)
    checks = {
        "beats_champion": F.when(sign.isNull(), no).when(first, True).otherwise(F.coalesce(gain >= config.min_gain, no)),
        "coverage_meets_request": F.when(F.col("coverage").isNull(), not config.require_coverage).otherwise(F.round("coverage", 9) >= floor),
        "contracts_pass": F.coalesce("contract_ok", no) if config.require_contracts else no,
        "worst_slice_not_worse": F.when(F.col("worst_slice").isNull() | sign.isNull(), no).when(delta.isNull(), True).otherwise(delta >= -config.slice_tolerance),
        "no_target_leakage": F.coalesce(F.col("n_leaks") == 0, no),
    }
    # The names of the metrics.
    metrics = {
        "min_gain": F.lit(config.min_gain), "gain": gain, "coverage_floor": F.lit(floor), "empirical_coverage": F.col("coverage"), "coverage_gap": F.round(F.col("coverage") - config.requested_coverage, 9),
        "challenger_worst_slice": F.col("worst_slice"), "champion_worst_slice": F.when(same, F.col("champion_worst_slice")), "worst_slice_delta": delta, "leakage_findings": F.col("n_leaks").cast("double"),
    }
    words = {name: F.when(checks[name], "PASS").otherwise("FAIL") for name in CRITERIA}
    words["coverage_meets_request"] = F.when(F.col("coverage").isNull() & F.lit(not config.require_coverage), "WAIVED").otherwise(words["coverage_meets_request"])
    if not config.require_contracts:
        words["contracts_pass"] = F.lit("SKIPPED")
    judged = pairs.withColumn("checks", F.create_map(*[x for n in CRITERIA for x in (F.lit(n), checks[n])]))
    judged = judged.withColumn("metrics", F.map_filter(F.create_map(*[x for n, c in metrics.items() for x in (F.lit(n), c.cast("double"))]), lambda _, v: v.isNotNull()))
    judged = judged.withColumn("reasons", F.array(*[F.concat(words[n], F.lit(f" {n}")) for n in CRITERIA]))
    return judged.withColumn("promoted", F.forall(F.map_values("checks"), lambda x: x))


def rank_leaderboard(candidates: DataFrame, by: str) -> DataFrame:
    """Best first in the direction of metric_name, ties by tier, time to fit and name; skipped candidates have no place.

    selected is the best portable one, gap what it lacks of the best of all. A candidate without a value was skipped.
    """
    sign = by_direction("metric_name", HIGHER_IS_BETTER)
    strength = F.when(F.col("metric_value").isNotNull(), sign * F.col("metric_value"))
    scored = candidates.withColumn("_s", strength)
    order, within = Window.partitionBy(by).orderBy(F.desc_nulls_last("_s"), "tier", "fit_seconds", "name"), Window.partitionBy(by)
    ranked = scored.withColumn("place", F.when(F.col("_s").isNotNull(), F.row_number().over(order)))
    able = F.col("portable") & F.col("_s").isNotNull()
    ranked = ranked.withColumn("selected", F.coalesce(F.col("place") == F.min(F.when(able, F.col("place"))).over(within), F.lit(False)))
    return ranked.withColumn("gap", F.max("_s").over(within) - F.max(F.when(able, F.col("_s"))).over(within)).withColumn("skipped", F.col("_s").isNull()).drop("_s")


def reason_codes(terms: list[tuple[str, Column, Column, str]], top: int = 3, target_class: str | None = None, unit: str = "") -> Column:
    """Sentences for the strongest of the (name, value, contribution, unit) terms; for a class, toward or away from it."""
    structs = F.array(*[F.struct((-F.abs(c)).alias("o"), F.lit(n).alias("f"), v.alias("v"), c.alias("c"), F.lit(f" {u}" if u else "").alias("u")) for n, v, c, u in terms])

    def sentence(x: Column) -> Column:
        what = F.concat(x.f, F.lit(" = "), plain_number(x.v), x.u)
        if target_class is None:
            return F.concat(what, F.lit(" pushed the estimate "), F.when(x.c >= 0, "up").otherwise("down"), F.lit(" by "), plain_number(F.abs(x.c)), F.lit(f" {unit}" if unit else ""))
        weight = F.format_string("%.2f", F.floor(F.abs(x.c) * 100 + 0.5) / 100)
        return F.concat(what, F.lit(" pushed the prediction "), F.when(x.c >= 0, "toward").otherwise("away from"), F.lit(f" '{target_class}' (weight "), weight, F.lit(")"))

    return F.transform(F.slice(F.array_sort(structs), 1, top), sentence)
