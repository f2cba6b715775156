from collections import Counter

import duckdb
import pytest

from lakeframe.llm.sharding import SHARDS, TABLE_SIZE, lookup_table, place_documents, placement_sql, write_shards


def test_table_is_even_and_stable():
    table = lookup_table()
    sizes = Counter(table)
    assert len(sizes) == len(SHARDS) and max(sizes.values()) - min(sizes.values()) <= 1
    less = lookup_table(SHARDS[:-1])
    moved = sum(SHARDS[a] != SHARDS[b] for a, b in zip(table, less, strict=True) if a != len(SHARDS) - 1)
    assert moved < 0.1 * TABLE_SIZE
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            lookup_table(bad)
    with pytest.raises(ValueError):
        lookup_table(("a",), 100)


def test_placement(spark, tmp_path):
    rows = [(i, "x", "clash") for i in range(5000)] + [(7, "y", "clash"), (None, None, "clash"), (None, "z", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    found = place_documents(docs).collect()
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841  read by name below
    wanted = duckdb.sql(placement_sql()).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found), key=key) == sorted(((d, s, x) for d, s, x in wanted), key=key)
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) < 2 * 5003 / len(SHARDS)
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r._shard for r in back.select("_shard").distinct().collect()} <= set(SHARDS)
    assert place_documents(docs.limit(0)).collect() == []
