"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut, fresh_path

__all__ = ["cut", "fresh_path"]  # and what is defined here

#: Texts of a batch are worked on in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """df, whose texts reach Python in batches of a few MB: their number of rows alone bounds nothing."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def row_key() -> F.Column:
    """A 64-bit key of a document's row: repeated rows, which get equal results, share it; it is never null."""
    return F.xxhash64("doc_id", "text")


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay within limit; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the n + 1 offsets of its rows; null counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's bytes stay within limit; a longer row comes alone."""
    for batch in batches:
        values = batch.column(column).cast(pa.large_binary())
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
        for i, j in slices(offsets, limit):
            yield batch.slice(i, j - i)
    hand_back()


def hand_back() -> None:
    """Return freed memory to the system at the end of a partition: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grouped_batches(batches: Iterator[pa.RecordBatch], key: str, least_rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key, of least_rows rows at least (the last excepted)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(keys != keys[-1])
        last = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if last or rows > batch.num_rows and held[-2].column(key)[-1].as_py() != keys[0]:
            done = [*held[:-1], batch.slice(0, last)]
            yield pa.Table.from_batches(done)
            held, rows = [batch.slice(last)], batch.num_rows - last
    if rows:
        yield pa.Table.from_batches(held)
    hand_back()
