"""Collocations against counts of every phrase, with few nodes a step and few results, so that branches stay unopened."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lakeframe.llm import collocations as module
from lakeframe.llm.collocations import collocations, tokens

FOLD = {i: i + 32 for i in range(65, 91)}


def plain(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[i : i + m])] += 1
    made = []
    for lang, f in counts.items():
        held = defaultdict(int)
        frequent = {p: a for p, a in f.items() if a >= least}
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        rows_ = []
        for p, a in frequent.items():
            if len(p) > 1 and 100 * held[p] < 100 * a:
                score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows_.append((score, a, " ".join(p).encode(), left, right))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2]))
        made += [(lang, i + 1, p.decode(), a, left, right, total[lang], score) for i, (score, a, p, left, right) in enumerate(rows_[:top])]
    return sorted(made)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(22)] + ["École", "A", "a", "x\x1cy", " ", "中"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    fixed = [" ".join(rng.choices(vocabulary, k=rng.randrange(2, 8))) for _ in range(25)]
    rows = []
    for i in range(400):
        said = [rng.choice(fixed) if rng.random() < 0.4 else rng.choices(vocabulary, weights)[0] for _ in range(rng.randrange(40))]
        rows.append((rng.choice([" ", "  ", "\t"]).join(x + rng.choice([""] * 5 + [".", ", ", "!\n", "\r\n"]) for x in said), rng.choice(["en", "en", "de", None])))
    return [*rows, (None, "en"), ("", "fr"), ("only once", "es"), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize(("seed", "least", "top", "nodes"), [(0, 8, 20, 60), (1, 6, 1000, 1 << 16), (2, 12, 5, 40)])
def test_equals_counts_of_every_phrase(spark, seed, least, top, nodes):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS h", "3 AS node").repartition(3)
    found = collocations(df, least, 5, top, nodes).collect()
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == plain(rows, least, 5, top)


def test_branches_below_the_threshold_stay_closed(spark, monkeypatch):
    grown, grow = [], module._Growth.grow
    monkeypatch.setattr(module._Growth, "grow", lambda self, nodes: grown.extend(n[1] for n in nodes) or grow(self, nodes))
    common = ["the", "of", "and", "to"]
    text = " ".join(f"r{i} s{i} {common[i % 4]} {common[i // 4 % 4]}" for i in range(30))
    df = spark.createDataFrame([(text, "en")] * 10, "text string, lang string")
    found = sorted((r.rank, r.phrase, r.a, r.l, r.r) for r in collocations(df, 10, 2, 3, 40).collect())
    assert found == [(i + 1, f"r{k} s{k}", 10, 10, 10) for i, k in enumerate((0, 1, 10))]  # ties, by the phrase
    hashes, opened = module.WordHashes("en"), {w[0] % 2**64 for w in grown if len(w) == 1}
    assert hashes[b"r0"] in opened and not opened & {hashes[w.encode()] for w in common}


def test_long_text_and_odd_tables(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0
    long = "alpha beta gamma. " * 300_000
    found = collocations(spark.createDataFrame([(long,)], "text string")).collect()
    assert [(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found] == [("und", "alpha beta gamma", 300_000, 300_000, 300_000, 900_000, 3000)]


def test_words_and_pieces():
    assert tokens(b"A b.C\tD\x0bE") == [b"a", b"b", b".", b"c", b"d", b".", b"e"]


def test_scores_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 9 * 10**12, 3 * 10**12, 7)], "a long, n long, l long, r long")
    assert df.selectExpr(module._div("a", "n", "l", "r") + " AS s").first().s == 1000 * 10**13 * 9 * 10**12 // (3 * 10**12 * 7)
