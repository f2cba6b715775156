"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The given folder, else the cluster's own, else, on a local master only, one that is deleted at exit."""
    found = folder or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lakeframe-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def fresh_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path that nothing has been written to, in the shared folder."""
    return f"{shared_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder, without their lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder as columns: for what is read in several passes.

    Select the columns that are needed before; a pass reads those it uses.
    """
    path = fresh_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
