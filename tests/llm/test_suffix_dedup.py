import hashlib
import random

import numpy as np
import pytest

from lakeframe.llm import suffix_dedup
from lakeframe.llm.suffix_dedup import blind_trie_order, cut_repeats, suffix_array_dedup


def brute(texts, span):
    seen = {}
    for d, text in enumerate(texts):
        for i in range(len(text) - span + 1):
            seen.setdefault(text[i : i + span], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + span] = True
    out = []
    for text, mask in zip(texts, gone, strict=True):
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        kept = bytes(b for b, m in zip(text, mask, strict=True) if not m)
        out.append((len(text), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    passages = [prose(k) for k in (20, 40, 41, 60, 90)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice([prose(rng.randint(1, 60)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :]]))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "ab " * 200, "x" * 500, "x" * 200, "x" * 199, "", None, "short"]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, texts[7], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    found = {}
    for r in suffix_array_dedup(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    wanted = brute([(t or "").encode() for t in [*texts, texts[7]]], 200)
    for i in range(len(texts)):
        assert found[i] == [wanted[i]] * (2 if i == 7 else 1), i


@pytest.mark.parametrize(("seed", "hot"), [(1, 0), (2, 0), (3, 3)])
def test_hot_anchors(spark, seed, hot, monkeypatch):
    """A line in different contexts does not gather; results equal brute force."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_BATCH", 40)
    rng = random.Random(seed)
    other = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, longer = other(180), other(230)
    texts = corpus(seed, 30) + [other(rng.randint(0, 300)) + line + other(rng.randint(0, 300)) for _ in range(60)] + [other(150) + longer + other(150) for _ in range(20)]
    seen, common = [], []
    real, counted = suffix_dedup.open_contexts, suffix_dedup.common_anchors
    monkeypatch.setattr(suffix_dedup, "common_anchors", lambda *a: common.append(counted(*a)) or common[-1])
    monkeypatch.setattr(suffix_dedup, "open_contexts", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts], 200)
    assert max((r["count"] for r in seen[0].where("left is not null").groupBy("h").count().collect()), default=0) <= hot
    assert seen[0].where("left is null").count() > 1000
    assert len(common) == 1 and len(common[0]) > 0  # what the first pass found has been salted


@pytest.mark.parametrize("n", [40, 240])
def test_common_line_makes_no_more_rows_past_hot(spark, n, monkeypatch):
    """A line with up to HOT contexts and with more: at most two rows a context have to meet; strings across it are found."""
    monkeypatch.setattr(suffix_dedup, "HOT", 30)
    rng = random.Random(n)
    other = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    line, head, tail = other(110), other(125), other(115)
    texts = [other(150) + line + other(150) for _ in range(n)]
    texts[3::20] = [other(150) + line + tail + other(50) for _ in texts[3::20]]
    texts[7::20] = [other(50) + head + line + other(150) for _ in texts[7::20]]
    texts[11::20] = [other(50) + head[-60:] + line + tail[:55] + other(150) for _ in texts[11::20]]
    seen = []
    real = suffix_dedup.open_contexts
    monkeypatch.setattr(suffix_dedup, "open_contexts", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup(docs).collect()}
    assert [found[i] for i in range(n)] == brute([t.encode() for t in texts], 200)
    assert sum(removed > 0 for _, removed, _, _ in found.values()) == 3 * n // 20
    assert seen[0].count() <= 2 * n


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(docs).collect() == []
    docs = spark.createDataFrame([(None, "y" * 300), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_array_dedup(docs).collect()) == [0, 300]


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a" * 300 + "b", 7, "x"), (2, "c", 8, None)], "doc_id long, text string, k long, `odd name` string").selectExpr("*", "5 as row", "6 as ranges", "0 as n_chars")
    found = cut_repeats(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == [(1, "b", 7, "x", 5, 6, 1), (2, "c", 8, None, 5, 6, 1)]


def test_blind_trie():
    rng = random.Random(5)
    values = list({int.from_bytes(bytes(rng.choices(b"ab", k=9)), "big") for _ in range(200)})
    assert [values[i] for i in blind_trie_order(values, 9)] == sorted(values)
