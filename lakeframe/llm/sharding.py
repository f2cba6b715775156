"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: a start and a step, both hashed
from its name. Shards take turns claiming the first slot of their order that is still free until the table is full, so
each gets the same number of slots but for one, and a shard that joins or leaves moves few slots of the others. A
document's slot is a hash of its id; the table, whose size is a parameter and not one of the data, is broadcast, so a
document is placed by one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 10_007
SHARDS = tuple(f"shard-{i:02d}" for i in range(48))


def _hash(name: str, use: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{use}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, and one at least")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime, no less than the number of shards")
    place = [_hash(s, "start") % size for s in shards]
    step = [_hash(s, "step") % (size - 1) + 1 for s in shards]
    owner, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            if not free:
                break
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            owner[place[i]] = i
            free -= 1
    return owner


def slot_of(key: str, size: int = TABLE_SIZE) -> F.Column:
    """First 32 bits of the id's MD5, modulo the table's size; a null id counts as an empty text."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size).cast("int")


def place_documents(documents: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, key: str = "doc_id") -> DataFrame:
    """Per row: the key, slot and shard. Equal keys share a shard, and so do null keys; other columns are not read."""
    table = documents.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot int, owner int")
    names = F.array(*map(F.lit, shards))
    placed = documents.select(key, slot_of(key, size).alias("slot")).join(F.broadcast(table), "slot")
    return placed.select(key, "slot", F.element_at(names, F.col("owner") + 1).alias("shard"))


def write_shards(documents: DataFrame, path: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, key: str = "doc_id", tasks_per_shard: int = 4) -> None:
    """Write whole rows in a folder for each shard; a shard is written by several tasks, whatever its size."""
    table = documents.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, size))), "_slot int, _owner int")
    names = F.array(*map(F.lit, shards))
    placed = documents.withColumn("_slot", slot_of(key, size)).join(F.broadcast(table), "_slot").withColumn("_shard", F.element_at(names, F.col("_owner") + 1))
    salt = F.pmod(F.xxhash64(*[c for c, t in documents.dtypes if not t.startswith("map")]), F.lit(tasks_per_shard))
    placed.repartition(len(shards) * tasks_per_shard, "_shard", salt).drop("_slot", "_owner").write.partitionBy("_shard").parquet(path)


def placement_sql(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> str:
    owners = ", ".join(map(str, lookup_table(shards, size)))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
        WITH hashed AS (
            SELECT doc_id, (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {size})::INTEGER AS slot
            FROM documents)
        SELECT doc_id, slot, ([{names}])[([{owners}])[slot + 1] + 1] AS shard FROM hashed"""
