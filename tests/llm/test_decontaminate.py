import random
from collections import Counter

import pytest

from lakeframe.llm import decontaminate
from lakeframe.llm.decontaminate import B, K1, _shingles, contaminated, drop_contaminated, words_of


def brute(docs, items):
    import math

    split = {i: words_of(t) for i, t in items if i is not None and t is not None}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    weights = {}
    for i, ws in split.items():
        if ws:
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean)) for t, tf in Counter(ws).items()}
            weights[i] = {t: x / sum(w.values()) for t, x in w.items()}
    found = set()
    for d, text in docs:
        words = words_of(text)
        for i, w in weights.items():  # each item by itself
            cut = max(1, len(split[i]) - max(1, round(len(split[i]) * 0.25)))
            question, answer = _shingles(split[i][:cut]), _shingles(split[i][max(0, min(cut, len(split[i]) - 3)) :])
            for a in range(len(words)):
                if tuple(words[a : a + 3]) in question | answer:
                    stretch = words[a : a + math.ceil(1.5 * len(split[i]))]
                    inside = _shingles(stretch)
                    if sum(w.get(t, 0) for t in set(stretch)) >= 0.6 and len(question & inside) >= 0.6 * len(question) and len(answer & inside) >= 0.6 * len(answer):
                        found.add((d, i))
    return found


def data(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(250)]
    prose = lambda n: rng.choices(words, weights=[1 / (i + 1) for i in range(250)], k=n)
    items = [prose(rng.randint(4, 30)) for _ in range(50)]
    docs = []
    for _ in range(120):
        text = prose(rng.choice([0, 5, 60, 300]))
        for _ in range(rng.randint(0, 2)):
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, 6)):
                item[rng.randrange(len(item))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = item
        docs.append(" ".join(text))
    return [(i, t) for i, t in enumerate([*docs, None, ""])], [(i, " ".join(t).title()) for i, t in enumerate(items)] + [(90, None), (91, ""), (None, "x y z"), (92, " ".join(items[3]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    docs, items = data(seed)
    if seed == 2:
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", 900)  # several parts
    documents = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(docs, items)
    assert len(wanted) > 30
    assert {(r.doc_id, r.item_id) for r in contaminated(documents, benchmark).collect()} == wanted
    kept = drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in wanted}


def test_other_items_change_no_verdict(spark):
    """Pieces of a short item that lie scattered over a text are no copy of it, whatever else the benchmark holds."""
    rng = random.Random(5)
    item, other = [f"q{i}" for i in range(14)], [f"z{rng.randrange(900)}" for _ in range(500)]
    docs = []
    for d in range(60):
        text = [f"r{rng.randrange(5000)}" for _ in range(800)]
        for k, start in enumerate(range(0, 12, 3)):
            at = 40 + 190 * k + rng.randrange(20)
            text[at:at] = item[start : start + 5]
        docs.append((d, " ".join(text)))
    docs += [(100, " ".join(["x"] * 333 + item[:7] + ["y"] + item[7:] + ["x"] * 90)), (101, " ".join(other)), (102, " ".join(["long"] * 400_000 + item + ["text"] * 300_000))]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    for items, wanted in ([(1, item)], {(100, 1), (102, 1)}), ([(1, item), (2, other)], {(100, 1), (102, 1), (101, 2)}):
        benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
        assert {(r.doc_id, r.item_id) for r in contaminated(documents, benchmark).collect()} == wanted


@pytest.mark.parametrize("length", [512, 513, 900, 1500, 3000])
def test_long_items(spark, length):
    """An exact copy is found wherever it stands, beside short items and their copies."""
    rng = random.Random(length)
    long, short = [f"w{rng.randrange(5000)}" for _ in range(length)], [f"w{rng.randrange(5000)}" for _ in range(20)]
    docs = [(at, " ".join([f"p{i}" for i in range(at)] + long + ["end"] * (at % 3 * 700))) for at in range(0, 2 * length, length // 12)]
    docs += [(-1, " ".join(["before"] * 77 + short)), (-2, " ".join(long[: length // 3]))]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(documents, benchmark).collect()} == {(d, 1) for d, _ in docs if d >= 0} | {(-1, 2)}
    assert [r.doc_id for r in drop_contaminated(documents, benchmark).collect()] == [-2]


def test_parts_give_equal_rows(spark, monkeypatch):
    docs, items = data(2)
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 900)
    made = list(decontaminate.indexes(benchmark))
    assert len(made) > 1
    assert {index.window for part in made for index in part} == {-(-5 * max(len(words_of(t)) for i, t in items if i is not None) // 2)}
    assert {(r.doc_id, r.item_id) for r in contaminated(documents, benchmark).collect()} == brute(docs, items)


def test_empty(spark):
    documents = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(documents, benchmark).collect() == []
    assert drop_contaminated(documents, benchmark).count() == 1
    assert contaminated(documents.limit(0), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).collect() == []
