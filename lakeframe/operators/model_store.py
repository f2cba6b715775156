"""A store of fitted models: saved with what they were fitted on, loaded, checked against a frame, and applied to it.

A stored model is a folder: the pipeline as Spark writes it (or another model's bytes) and, written last, a manifest of
one row. A folder without a manifest is a write that did not end, and is not loaded.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyspark
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pickled model is sent to every worker: larger ones are refused.
ARTEFACT_BYTES = 256 << 20


class ModelMissing(LookupError):
    """Nothing was stored there, or its writer did not end."""


class FeatureMismatch(ValueError):
    """The frame lacks features of the model, or has them in another type or with unknown levels."""


class VersionDrift(RuntimeError):
    """The libraries are not those the model was fitted with."""


@dataclass(frozen=True)
class Manifest:
    """What a model was fitted on. levels: classes of the target in order (none: a regression); known: levels of features."""

    run_id: str
    kind: str
    features: tuple[tuple[str, str], ...]
    target: str
    levels: tuple[str, ...] = ()
    known: Mapping[str, tuple[str, ...]] | None = None
    metric: str | None = None
    metric_value: float | None = None
    versions: Mapping[str, str] | None = None

    @classmethod
    def parse(cls, text: str) -> Manifest:
        raw = json.loads(text)
        raw["features"] = tuple((n, t) for n, t in raw["features"])
        raw["levels"] = tuple(raw["levels"])
        raw["known"] = {k: tuple(v) for k, v in (raw["known"] or {}).items()}
        return cls(**raw)


@dataclass(frozen=True)
class Stored:
    manifest: Manifest
    pipeline: PipelineModel | None = None
    artefact: bytes | None = None


def _versions() -> dict[str, str]:
    return {"pyspark": pyspark.__version__, "numpy": np.__version__}


def describe(frame: DataFrame, run_id: str, features: list[str], target: str, levels: tuple[str, ...] = (), closed: tuple[str, ...] = (), most: int = 1000, **measured: Any) -> Manifest:
    """A manifest of the frame that a model is fitted on; closed features have no levels but those seen in it, most of them at most."""
    types = dict(frame.dtypes)
    known = {}
    for c in closed:
        found = [r[0] for r in frame.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{c} has over {most} levels: it cannot be a closed feature")
        known[c] = tuple(sorted(found))
    return Manifest(run_id, "", tuple((f, types[f]) for f in features), target, tuple(levels), known, versions=_versions(), **measured)


def save(spark: SparkSession, path: str, manifest: Manifest, model: PipelineModel | Any) -> None:
    """Write model and, when it is whole, its manifest; what is stored is never overwritten.

    A class that workers cannot import is registered with cloudpickle, to be pickled by value.
    """
    if isinstance(model, PipelineModel):
        kind = "pipeline"
        model.write().save(f"{path}/model")
    else:
        kind, artefact = "python", cloudpickle.dumps(model)
        if len(artefact) > ARTEFACT_BYTES:
            raise ValueError(f"a model of {len(artefact)} bytes is too large to be sent to workers")
        spark.createDataFrame([(bytearray(artefact),)], "artefact binary").coalesce(1).write.parquet(f"{path}/model")
    text = json.dumps(asdict(manifest) | {"kind": kind}, sort_keys=True)
    spark.createDataFrame([(text,)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, allow_version_drift: bool = False) -> Stored:
    try:
        text = spark.read.schema("manifest string").parquet(f"{path}/manifest").first()
    except pyspark.errors.AnalysisException as e:
        raise ModelMissing(f"no model is stored at {path}") from e
    if text is None:
        raise ModelMissing(f"no model is stored at {path}")
    manifest = Manifest.parse(text.manifest)
    moved = {k: (v, _versions().get(k)) for k, v in (manifest.versions or {}).items() if _versions().get(k) != v}
    if moved and not allow_version_drift:
        raise VersionDrift(f"{manifest.run_id} was fitted with other libraries: {moved}")
    if manifest.kind == "pipeline":
        return Stored(manifest, PipelineModel.load(f"{path}/model"))
    return Stored(manifest, artefact=bytes(spark.read.parquet(f"{path}/model").first().artefact))


def check_features(manifest: Manifest, frame: DataFrame) -> None:
    """Refuse a frame without the model's features, in their order and types; other columns may lie between."""
    types = dict(frame.dtypes)
    missing = [f for f, _ in manifest.features if f not in types]
    other = [f"{f}: {types[f]}, not {t}" for f, t in manifest.features if f in types and types[f] != t]
    if missing or other:
        raise FeatureMismatch(f"missing: {missing}, of another type: {other}")
    wanted = [f for f, _ in manifest.features]
    if [c for c in frame.columns if c in set(wanted)] != wanted:
        raise FeatureMismatch(f"the features' order is not {wanted}")


def unknown_levels(manifest: Manifest, frame: DataFrame) -> dict[str, int]:
    """Rows by closed feature with a level that the model has not seen, in one pass."""
    closed = {c: levels for c, levels in (manifest.known or {}).items() if c in frame.columns}
    if not closed:
        return {}
    row = frame.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*levels)).alias(c) for c, levels in closed.items()]).first()
    return {c: row[c] for c in closed if row[c]}


def score_frame(frame: DataFrame, stored: Stored, strict_levels: bool = False) -> DataFrame:
    """frame with y_pred and, for two classes, y_pred_proba of the last level; rows and their order of columns stay.

    A pipeline stays in the JVM. Another model runs in batches: its bytes reach a worker with the task, and are unpickled
    once for all batches of it. A prediction column that the frame has is replaced.
    """
    check_features(stored.manifest, frame)
    if strict_levels and (found := unknown_levels(stored.manifest, frame)):
        raise FeatureMismatch(f"rows with levels the model has not seen: {found}")
    plain = frame.drop("y_pred", "y_pred_proba")
    return _score_pipeline(plain, stored) if stored.pipeline is not None else _score_batches(plain, stored)


def _score_pipeline(frame: DataFrame, stored: Stored) -> DataFrame:
    manifest, kept = stored.manifest, [F.col(c) for c in frame.columns]
    outputs = {c for s in stored.pipeline.stages for p in ("outputCol", "predictionCol", "probabilityCol", "rawPredictionCol") if s.hasParam(p) and s.isDefined(p) for c in [s.getOrDefault(p)]}
    if clash := outputs & set(frame.columns):
        raise FeatureMismatch(f"columns of the frame have names that the model writes: {sorted(clash)}")
    scored = stored.pipeline.transform(frame)
    if not manifest.levels:
        return scored.select(*kept, F.col("prediction").alias("y_pred"))
    levels = F.array(*map(F.lit, manifest.levels))
    named = F.element_at(levels, F.col("prediction").cast("int") + 1).alias("y_pred")
    both = [vector_to_array("probability")[1].alias("y_pred_proba")] if len(manifest.levels) == 2 else []
    return scored.select(*kept, named, *both)


def _score_batches(frame: DataFrame, stored: Stored) -> DataFrame:
    manifest, artefact = stored.manifest, stored.artefact
    names = [f for f, _ in manifest.features]
    two = len(manifest.levels) == 2
    kind = T.StringType() if manifest.levels else T.DoubleType()
    fields = [T.StructField("y_pred", kind), *[T.StructField("y_pred_proba", T.DoubleType())] * two]

    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(artefact)
        for columns in batches:
            x = pd.DataFrame(dict(zip(names, columns, strict=True)))
            y = model.predict(x)
            out = pd.DataFrame({"y_pred": [str(v) for v in y] if manifest.levels else np.asarray(y, float)})
            if two:
                out["y_pred_proba"] = np.asarray(model.predict_proba(x), float)[:, list(model.classes_).index(manifest.levels[-1])]
            yield out

    predict.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    scored = frame.withColumn("_scored", F.pandas_udf(predict, T.StructType(fields))(*names))
    return scored.select(*[F.col(c) for c in frame.columns], *[F.col("_scored")[f.name].alias(f.name) for f in fields])


def verify(stored: Stored, holdout: DataFrame, metric: Callable[[str, str], Column], tolerance: float = 1e-9) -> float:
    """The metric of the stored model on the rows it was measured on; refused if it is not the recorded one."""
    found = score_frame(holdout, stored).agg(metric(stored.manifest.target, "y_pred")).first()[0]
    recorded = stored.manifest.metric_value
    if recorded is None or found is None or abs(found - recorded) > tolerance:
        raise ValueError(f"{stored.manifest.run_id}: {stored.manifest.metric} is {found}, not the recorded {recorded}")
    return found
