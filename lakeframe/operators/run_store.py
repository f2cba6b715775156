"""A stored table of runs with one row a key: upserts write new versions, and only one writer can publish each.

Rows lie in buckets of their key's hash. An upsert rewrites the buckets it touches into a new folder and then creates the
manifest of the next version, which says where each bucket lies. A manifest is created once and never changed: of two
writers that start from one version, the later fails, and a writer that does not end leaves nothing that is read.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class LostUpdate(RuntimeError):
    """Another writer published a version after the one that was read."""


@dataclass(frozen=True)
class Version:
    """Where each bucket lies, of the table's number'th version; 0 is the empty table, which has no schema."""

    number: int
    key: str
    buckets: int
    schema: str | None
    folders: dict[int, str]


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions."""
    folder, files = _path(spark, f"{path}/versions")
    if not files.exists(folder):
        return []
    names = [re.fullmatch(r"(\d+)\.json", f.getPath().getName()) for f in files.listStatus(folder)]
    return sorted(int(n[1]) for n in names if n)


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A published version, by default the newest; None if there is none."""
    known = versions(spark, path)
    if number is None and not known:
        return None
    if number is not None and number not in known:
        raise LookupError(f"there is no version {number} of {path}")
    rows = spark.read.text(f"{path}/versions/{known[-1] if number is None else number:012d}.json", wholetext=True)
    raw = json.loads(rows.first()[0])
    return Version(raw["number"], raw["key"], raw["buckets"], raw["schema"], {int(b): f for b, f in raw["folders"].items()})


def _publish(spark: SparkSession, path: str, made: Version) -> None:
    """Write the manifest beside its place and move it there, which fails if another is there (atomic where renames are)."""
    jvm, text = spark._jvm, json.dumps(made.__dict__, sort_keys=True)
    fs = jvm.org.apache.hadoop.fs
    final, files = _path(spark, f"{path}/versions/{made.number:012d}.json")
    draft = fs.Path(f"{path}/versions/.draft-{uuid.uuid4().hex}")
    writer = jvm.java.io.OutputStreamWriter(files.create(draft, False), "UTF-8")
    writer.write(text)
    writer.close()
    rename = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if files.exists(final):
            raise LostUpdate(f"version {made.number} of {path} was published by another writer") from e
        raise


def read(spark: SparkSession, path: str, number: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table's rows, of its newest version or the one asked for; only: of some buckets."""
    found = version(spark, path, number)
    if found is None:
        raise LookupError(f"no table is stored at {path}")
    return _rows(spark, path, found, only).drop(BUCKET)


def _rows(spark: SparkSession, path: str, found: Version, only: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(found.schema))
    folders: dict[str, list[int]] = {}
    for b, folder in found.folders.items():
        if only is None or b in only:
            folders.setdefault(folder, []).append(b)
    paths = [f"{path}/rows/{folder}/{BUCKET}={b}" for folder, buckets in sorted(folders.items()) for b in sorted(buckets)]
    if not paths:
        return spark.createDataFrame([], schema.add(BUCKET, T.IntegerType()))
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.withColumn(BUCKET, _bucket(F.col(f"`{found.key}`"), found.buckets))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, order: list[str], expected: int | None = None, buckets: int = 64) -> Version:
    """Replace the rows of the keys in changes, add those that are new, and publish the next version.

    Of several changes to a key the last in order counts (equal ones: any of them); a null key is refused. expected is the
    version that the changes were made from, by default the newest; LostUpdate if another was published since. A new table
    gets the key, buckets and types of its first upsert; later ones must have its columns, in any order.
    """
    base = version(spark, path)
    number = base.number if base else 0
    if expected is not None and expected != number:
        raise LostUpdate(f"{path} is at version {number}, the changes were made from {expected}")
    if base is None:
        base = Version(0, key, buckets, json.dumps(changes.schema.jsonValue()), {})
    schema = T.StructType.fromJson(json.loads(base.schema))
    types, given = ({f.name: f.dataType.simpleString() for f in s} for s in (schema, changes.schema))
    if key != base.key or types != given:
        raise ValueError(f"the table has key {base.key} and columns {types}, the changes {key} and {given}")
    quoted = [F.col(f"`{c}`") for c in schema.names]
    if BUCKET in schema.names or set(order) - set(schema.names):
        raise ValueError(f"{BUCKET} is a column, or {order} are not")
    place = F.struct(*[F.col(f"`{c}`") for c in (order or [key])])
    newest = changes.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max_by(F.struct(*quoted), place).alias("_row"))  # many changes to a key meet as one for each task
    newest = newest.select("_row.*", _bucket(F.col("_key"), base.buckets).alias(BUCKET)).persist()
    try:
        touched = {r[0]: r[1] for r in newest.groupBy(BUCKET).agg(F.count_if(F.col(f"`{key}`").isNull())).collect()}  # a row for each bucket
        if any(touched.values()):
            raise ValueError(f"{key} is null in the changes")
        old = _rows(spark, path, base, sorted(touched)).select(*quoted, BUCKET)
        kept = old.join(newest.select(f"`{key}`"), key, "left_anti").select(*quoted, BUCKET)
        folder = f"{number + 1:012d}-{uuid.uuid4().hex}"
        if touched:
            merged = kept.unionByName(newest).repartition(min(base.buckets, len(touched)), BUCKET)
            merged.write.partitionBy(BUCKET).parquet(f"{path}/rows/{folder}")
    finally:
        newest.unpersist()
    made = Version(number + 1, base.key, base.buckets, base.schema, base.folders | dict.fromkeys(touched, folder))
    _publish(spark, path, made)
    return made
