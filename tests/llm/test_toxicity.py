import random
import zlib
from collections import Counter

import numpy as np

from lakeframe.llm import toxicity as module
from lakeframe.llm.toxicity import ORDERS, drop_toxic, fit_logistic, gram_buckets, toxicity, train_toxicity


def data():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 7))) for _ in range(900)]
    docs, labels = [], []
    for i in range(1500):
        text = rng.choices(words, k=rng.choice([3, 20, 100, 400]))
        toxic = rng.random() < 0.2
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["zork", "Quux", "vimfit"])
        docs.append((i, " ".join(text), "x"))
        if i % 4:
            labels.append((i, int(toxic)))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "zork", "x"), docs[3]]
    return docs, labels + [(7, None), (None, 1), labels[0]]


def test_held_out_accuracy(spark):
    docs, labels = data()
    documents = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity(documents, known).collect()
    assert len(found) == len(docs)
    true = {d: t for d, t in labels if t is not None and d is not None}
    held = [r for r in found if r.held_out and r.doc_id in true]
    assert len(held) > 150
    assert sum(r.predicted == true[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    documents = documents.selectExpr("*", "1 as `score`", "2 as bytes", "3 as `odd name`", "4 as row")
    kept = drop_toxic(documents, known)
    assert kept.columns == documents.columns
    assert kept.count() == sum(r.predicted == 0 for r in found)


def test_one_class_and_empty(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity(documents, labels).collect())
    assert toxicity(documents.limit(0), labels.limit(0)).collect() == []


def bucket(gram):
    return int(gram_buckets(np.frombuffer(gram, np.uint8), np.array([0, len(gram) + len(gram) - 1]), len(gram))[0])


def test_ratios_and_features_by_brute_force(spark):
    """Document counts of every n-gram, one at a time, give the same features and log-count ratios."""
    docs, labels = data()
    docs = docs[:400]
    known = {d: t for d, t in labels if d is not None and t is not None}
    counts, sizes = (Counter(), Counter()), [0, 0]
    for d, text, _ in docs:
        if d in known:
            b = f" {text.lower()} ".encode()
            sizes[known[d]] += 1
            counts[known[d]].update({bucket(b[i : i + n]) for n in ORDERS for i in range(len(b) - n + 1)})
    surety = {}
    for k in set(counts[0]) | set(counts[1]):
        r0, r1 = (counts[0][k] + 1) / (sizes[0] + 2), (counts[1][k] + 1) / (sizes[1] + 2)
        surety[k] = abs(r1 - r0) / (r0 * (1 - r0) / sizes[0] + r1 * (1 - r1) / sizes[1]) ** 0.5, np.log(r1 / r0)
    model = train_toxicity(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int"), features=200)
    chosen = {k: model.ratios[f] for k, f in enumerate(model.bucket_slot) if f >= 0}
    assert len(chosen) == 200
    least = sorted((s for s, _ in surety.values()), reverse=True)[199]
    for k, ratio in chosen.items():
        assert surety[k][0] >= least - 1e-6 and abs(surety[k][1] - ratio) < 1e-5


def test_fit_against_plain_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + rng.normal(size=80) > 0).astype(np.float32)
    weight = rng.uniform(0.5, 2, 80)
    w, b = fit_logistic(x, y, weight, 0.05)
    v, c, share = np.zeros(5), 0.0, weight / weight.sum()
    for _ in range(20_000):
        error = share * (1 / (1 + np.exp(-(x @ v + c))) - y)
        v, c = v - 0.5 * (x.T @ error + 0.05 * v), c - 0.5 * error.sum()
    assert np.abs(w - v).max() < 1e-3 and abs(b - c) < 1e-3


def test_shuffled_labels_and_ties(spark, monkeypatch):
    """Beyond BROADCAST_ROWS labels are shuffled, with the same scores; repeated rows and equal texts score alike."""
    docs, labels = data()
    documents, known = spark.createDataFrame(docs + docs[:50], "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    wanted = sorted((str(r.doc_id), r.score) for r in toxicity(documents, known).collect())
    assert len(wanted) == len(docs) + 50
    by = {}
    for d, score in wanted:
        assert by.setdefault(d, score) == score
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    found = sorted((str(r.doc_id), r.score) for r in toxicity(documents, known).collect())
    assert all(a == b and abs(x - y) < 1e-6 for (a, x), (b, y) in zip(found, wanted, strict=True))


def test_very_long_text(spark):
    docs, labels = data()
    long = "harmless words " * 200_000
    documents = spark.createDataFrame([*docs, (9000, long, "x"), (9001, long + "zork", "x")], "doc_id long, text string, x string")
    found = {r.doc_id: r.score for r in toxicity(documents, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert 0 <= found[9000] < found[9001] <= 1


def test_many_features(spark):
    """Pairs of row and feature hold for any number of features: 40,000 of them give the presences that brute force gives."""
    from lakeframe.llm.toxicity import BUCKET_BITS, active_features

    rng = np.random.default_rng(4)
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    slot[rng.permutation((1 << BUCKET_BITS) - 1)[:40_000] + 1] = np.arange(40_000)
    texts = [(" " + "".join(rng.choice(list("abcdef gh"), 300)) + " ").encode() for _ in range(20)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, feature = active_features(np.frombuffer(b"".join(texts), np.uint8), offsets, slot)
    wanted = set()
    for i, t in enumerate(texts):
        one = np.frombuffer(t, np.uint8)
        wanted |= {(i, int(f)) for order in ORDERS for f in slot[gram_buckets(one, np.array([0, len(one)]), order)] if f >= 0}
    assert set(zip(row.tolist(), feature.tolist())) == wanted and max(f for _, f in wanted) > 2048
    docs, labels = data()
    model = train_toxicity(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int"), features=5000)
    assert (model.weights != 0).sum() > 2048 and (model.bucket_slot >= 0).sum() == (model.weights != 0).sum()
