"""Declared problems: features, target and the settings that decide verdicts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"numeric": T.DoubleType(), "categorical": T.StringType(), "boolean": T.BooleanType(), "datetime": T.TimestampType()}


@dataclass(frozen=True)
class Settings:
    """Thresholds that decide verdicts."""

    random_seed: int = 7
    requested_coverage: float = 0.9
    coverage_tolerance: float = 0.05
    promote_min_gain: float = 0.005
    learnable_r2_floor: float = 0.15
    learnable_accuracy_floor: float = 0.55
    leakage_threshold: float = 0.98
    drift_warn: float = 0.2
    drift_block: float = 0.4
    drift_p_value: float = 0.05
    too_easy_r2: float = 0.95
    too_easy_accuracy: float = 0.98
    leakage_min_rows: int = 40
    learnability_min_rows: int = 60
    drift_min_rows: int = 30
    slice_min_rows: int = 30
    coverage_min_rows: int = 20
    estimate_min_reference: int = 500
    estimate_min_chunk: int = 50
    alert_min_rows: int = 200
    top_levels: int = 10
    high_null_share: float = 0.5
    high_cardinality_share: float = 0.5


SETTINGS = Settings()


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    levels: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    nullable: bool = False

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z_]\w*", self.name):
            raise ValueError(f"{self.name!r} is no identifier")
        if self.kind not in _TYPES:
            raise ValueError(f"{self.name}: unknown kind {self.kind!r}")
        if bool(self.levels) != (self.kind == "categorical"):
            raise ValueError(f"{self.name}: levels belong to categoricals, and only to them")


@dataclass(frozen=True)
class Problem:
    features: tuple[Feature, ...]
    target: Feature

    def __post_init__(self) -> None:
        names = [f.name for f in self.features]
        if len(set(names)) < len(names) or self.target.name in names:
            raise ValueError("a feature is declared twice, or is the target")
        if self.target.levels and len(self.target.levels) < 2:
            raise ValueError("a classification target needs two classes")

    @property
    def task(self) -> str:
        return "classification" if self.target.kind == "categorical" else "regression"

    @property
    def primary_metric(self) -> str:
        return "accuracy" if self.task == "classification" else "r2"

    def of_kind(self, *kinds: str) -> list[Feature]:
        return [f for f in self.features if f.kind in kinds]

    def struct(self) -> T.StructType:
        fields = [T.StructField(f.name, _TYPES[f.kind], f.nullable, {"levels": list(f.levels), "min": f.minimum, "max": f.maximum}) for f in self.features]
        return T.StructType([*fields, T.StructField(self.target.name, _TYPES[self.target.kind], False)])


def compare_schema(problem: Problem, columns: list[str], inference: bool = False, strict: bool = False) -> tuple[list[str], list[str]]:
    """Missing and (if strict) undeclared columns; at inference the target may be absent."""
    wanted = [f.name for f in problem.features] + ([] if inference else [problem.target.name])
    return [c for c in wanted if c not in columns], [c for c in columns if strict and c not in [*wanted, problem.target.name]]


def min_calibration_rows(coverage: float) -> int:
    """Least n of calibration rows with ceil((n + 1) c) <= n."""
    if not 0 < coverage < 1:
        raise ValueError("coverage lies strictly between 0 and 1")
    n = 1
    while -(-round((n + 1) * coverage, 9) // 1) > n:
        n += 1
    return n
