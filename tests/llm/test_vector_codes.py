"""Vector codes: both trees against every distance, and the query against plain Lloyd in whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lakeframe.llm.vector_codes import Tree, entry_tree, nearest, vector_codes


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, sha) of every kept row, by every distance."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    whole = [(r[0], [math.floor(1024 * x) for x in r[1]], r[2]) for r in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(whole[0][1]) // parts
    books = [[r[1][k * width : (k + 1) * width] for r in whole[:entries]] for k in range(parts)]

    def assign(k, v):
        part = v[k * width : (k + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            members = defaultdict(list)
            for _, v, _ in whole:
                members[assign(k, v)[1]].append(v[k * width : (k + 1) * width])
            books[k] = [[sum(x) // len(members[i]) for x in zip(*members[i])] if i in members else e for i, e in enumerate(books[k])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    made, labels = [], defaultdict(int)
    for i, v, label in whole:
        found = [assign(k, v) for k in range(parts)]
        error = sum(d for d, _ in found)
        labels[label] += error
        made.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    return sorted(((i, c, e, labels[label], sha) for i, c, e, label in made), key=str)


@pytest.mark.parametrize("seed", range(8))
def test_dual_tree_equals_every_distance(seed):
    rng = np.random.default_rng(seed)
    spread = [3, 50, 1000, 1 << 21, 1 << 29, 3, 200, 1][seed]
    width = [2, 4, 16, 4, 3, 1, 16, 2][seed]
    points = rng.integers(-spread, spread + 1, (700, width))
    if seed == 6:
        points = rng.integers(-spread, spread, (9, width))[rng.integers(0, 9, 700)] + rng.integers(-2, 3, (700, width))
    points[100:300] = points[7]
    entries = rng.integers(-spread, spread + 1, (60, width))
    entries[40:50] = entries[:10]
    tree = Tree.unpack(Tree.over(points, 8).pack())
    found, total, count = nearest(tree, tree.sums(), *entry_tree(entries))
    off = points[:, None, :].astype(object) - entries[None].astype(object)
    best = (off * off).sum(axis=2).argmin(axis=1)  # the first of equals
    assert (found == best[tree.order]).all()
    for j in range(len(total)):
        assert count[j] == (best == j).sum() and total[j].tolist() == points[best == j].sum(axis=0).tolist()


def rows_of(seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(6)]
    rows = [(i * 3, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([1, 2, 3, None])) for i in range(400)]
    rows += [(5, None, 1), (8, [None] + [0.1] * 7, 1), (11, [float("nan")] + [0.1] * 7, 2), (14, [float("-inf")] + [0.1] * 7, None)]
    rows += [(None, [0.5] * 8, 1), (9, [0.25] * 8, 1), (9, [0.25] * 8, 1)] + [(2000 + i, [-0.125] * 8, 7) for i in range(90)]
    return rows


@pytest.mark.parametrize(("seed", "broadcast_rows"), [(0, 1000), (1, 0)])
def test_codes_equal_plain_lloyd(spark, seed, broadcast_rows):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS code", "1 AS v", "2 AS n").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    found = vector_codes(df, entries=32, broadcast_rows=broadcast_rows).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found), key=str) == plain(exact, entries=32)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes(spark.createDataFrame([(1, [0.5] * 6, "a")], schema)).count() == 0  # six components have no four parts
    rows = [(3, [0.5] * 8, "a"), (4, [-0.5] * 8, "b"), (5, [0.1] * 4, "a")]  # fewer vectors than entries, one of another length
    found = vector_codes(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in found) == [(3, "00000000", 0, 0), (4, "01010101", 0, 0)]
    assert vector_codes(spark.createDataFrame([(1, [900000.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")).first().error == 0
