import random

import numpy as np
import pytest

from lakeframe.llm import jaccard_join
from lakeframe.llm.jaccard_join import connected_components, jaccard_components, shingle_set, signature_tree_links


def brute(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(400)]
    texts = []
    passage = rng.choices(words, k=40)
    for _ in range(n):
        if texts and rng.random() < 0.6:
            base = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.choice([1, 3, 5, 9, 30, 80, 200])) + (passage if rng.random() < 0.4 else [])))
    texts += ["", None, " \t\n", "a b", "A B", "a\x0bb", "a b c d e", "a b c d e f", texts[5].upper(), "é É", "x " * 300]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 2:
        monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    if seed == 3:
        monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, tok string, k int")
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute(rows)


@pytest.mark.parametrize("block", [3, 16])
def test_a_giant_component(spark, block, monkeypatch):
    """One passage in all texts; a large group of near copies in many blocks, and pairs outside it, near or far in size."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    passage = words[:40]
    rows = []
    for i in range(120):  # near copies of one another
        tail = words[100:140]
        tail[rng.randrange(40)] = rng.choice(words)
        rows.append((i, " ".join(passage + tail[: rng.randint(34, 40)])))
    for i in range(40):  # texts of their own around the passage, each with a near copy
        own = rng.sample(words, rng.randint(10, 60))
        rows.append((1000 + i, " ".join(passage + own)))
        rows.append((2000 + i, " ".join(passage + own + rng.sample(words, rng.randint(0, 12)))))
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    met = []
    outside = jaccard_join._outside
    monkeypatch.setattr(jaccard_join, "_outside", lambda *x: met.append(outside(*x)) or met[-1])
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == brute(rows)
    assert met[0] is not None or block > 3


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "short text of its own, not long")]
    assert sorted(tuple(r)[::2] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).collect() == []
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, jaccard_components(docs).collect())) == sorted(["Row(doc_id=None, n_shingles=1, component_id=4)", "Row(doc_id=4, n_shingles=1, component_id=4)", "Row(doc_id=None, n_shingles=0, component_id=None)"])


def test_signature_tree_is_exact():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)) for _ in range(60)]
    sets = []
    for _ in range(400):
        s = base[rng.integers(len(base))]
        sets.append(np.unique(np.concatenate((s[rng.random(len(s)) > rng.random() * 0.2], rng.integers(0, 1 << 62, rng.integers(1, 6)).astype(np.uint64)))))
    _, forest = signature_tree_links(sets)
    links, forest = signature_tree_links(sets)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in links:
        up[root(x)] = root(y)
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                assert root(i) == root(j)
    for x, y in links:
        common = len(np.intersect1d(sets[x], sets[y]))
        assert 100 * common >= 80 * (len(sets[x]) + len(sets[y]) - common)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100)], "a long, b long").repartition(7)
    found = {r.node: r.root for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_shingles_of_short_texts():
    assert len(shingle_set("a b", {b"a": 1, b"b": 2})) == 1
