"""Column expressions shared by the jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def hash_uniform(key: Column | str, seed: int, stream: str) -> Column:
    """A number in [0, 1) that depends on key, seed and stream alone, however rows are partitioned."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}:{stream}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_normal(key: Column | str, seed: int, stream: str) -> Column:
    """Standard normal by Box and Muller's method from two hashed uniforms."""
    u = F.greatest(hash_uniform(key, seed, stream + ".u"), F.lit(1e-12))
    v = hash_uniform(key, seed, stream + ".v")
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value", kind: str = "string") -> DataFrame:
    """Long form of some columns, all cast to one type; one pass, no shuffle."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns]
    return df.select(*ids, F.explode(F.array(*pairs)).alias("_p")).select(*ids, f"_p.{name}", f"_p.{value}")


def sorted_json(columns: Sequence[str]) -> Column:
    """Canonical text of some columns: keys in order, compact, missing as null, NaN as "nan"."""
    parts = []
    for c in sorted(columns):
        text = F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')))
        parts.append(F.concat(F.lit(f'"{c}":'), text))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def null_if_nan(df: DataFrame) -> DataFrame:
    """Missing is null, never NaN."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def by_direction(metric: Column | str, directions: dict[str, bool]) -> Column:
    """1 where a larger value of the named metric is better, -1 where a smaller one is, null for an unknown name."""
    metric = F.col(metric) if isinstance(metric, str) else metric
    return F.create_map(*[F.lit(x) for name, higher in directions.items() for x in (name, 1 if higher else -1)])[metric]


def plain_number(c: Column) -> Column:
    """Whole numbers without a point, others to two places or, below 1, to four digits, without trailing zeros."""
    size = F.abs(c)
    cents = F.floor(size * 100 + 0.5)
    large = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    ten = F.pow(F.lit(10.0), 3 - F.floor(F.log10(size)))
    small = F.format_string("%.8f", F.floor(size * ten + 0.5) / ten)
    text = F.when(c == F.floor(c), F.floor(size).cast("string")).otherwise(F.regexp_replace(F.when(size >= 1, large).otherwise(small), r"\.?0+$", ""))
    return F.when(c.isNull(), "unknown").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), text))


PLAIN_NUMBER_SQL = """CASE WHEN {c} IS NULL THEN 'unknown' ELSE CASE WHEN {c} < 0 THEN '-' ELSE '' END || CASE WHEN {c} = floor({c}) THEN CAST(CAST(abs({c}) AS BIGINT) AS VARCHAR)
    WHEN abs({c}) >= 1 THEN regexp_replace((floor(abs({c}) * 100 + 0.5)::BIGINT // 100)::VARCHAR || '.' || lpad((floor(abs({c}) * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0'), '\\.?0+$', '')
    ELSE regexp_replace(printf('%.8f', floor(abs({c}) * pow(10.0, 3 - floor(log10(abs({c})))) + 0.5) / pow(10.0, 3 - floor(log10(abs({c}))))), '\\.?0+$', '') END END"""
