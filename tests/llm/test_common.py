import numpy as np
import pyarrow as pa

from lakeframe.llm.common import byte_column, grouped_batches, parts, slices


def test_slices_and_parts():
    offsets = np.array([0, 3, 3, 10, 11, 30])
    assert list(slices(offsets, 8)) == [(0, 2), (2, 4), (4, 5)]
    assert list(slices(np.array([0]), 8)) == []
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "defghij", "k", "l" * 19])], names=["text"])
    got = [b.column("text").to_pylist() for b in parts(iter([batch.slice(0, 0), batch]), limit=8)]
    assert got == [["abc", None], ["defghij", "k"], ["l" * 19]]
    data, at = byte_column(batch.slice(1, 3).column("text").cast(pa.binary()))
    assert bytes(data) == b"defghijk" and at.tolist() == [0, 0, 7, 8]


def test_groups_stay_whole():
    keys = [1, 1, 2, 2, 2, 2, 3, 4, 4, 5]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size])], names=["g"]) for i in range(0, len(keys), size)]
        for least in (1, 3, 100):
            tables = [t.column("g").to_pylist() for t in grouped_batches(iter(batches), "g", least)]
            assert [x for t in tables for x in t] == keys
            assert all(not set(a) & set(b) for a, b in zip(tables[:-1], tables[1:], strict=True))
