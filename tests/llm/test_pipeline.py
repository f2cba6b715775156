"""Each stage of the pipeline against brute force on what the stage before it kept."""

import random

import numpy as np
import test_decontaminate
import test_jaccard_join
from test_suffix_dedup import brute as cut_by_brute_force

import corpus_pipeline
from lakeframe.llm import suffix_dedup
from lakeframe.llm.decontaminate import words_of
from lakeframe.llm.toxicity import toxicity


def removed(texts, span=200):
    """Texts without the bytes of strings of span bytes that also start elsewhere."""
    seen = {}
    for d, text in enumerate(texts):
        for i in range(len(text) - span + 1):
            seen.setdefault(text[i : i + span], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + span] = True
    return [bytes(b for b, m in zip(t, g, strict=True) if not m).decode("utf-8", "ignore") for t, g in zip(texts, gone, strict=True)]


def make(spark, path):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(1500)]
    prose = lambda n: rng.choices(words, k=n)
    items = [prose(rng.randint(12, 40)) for _ in range(20)]
    passage = prose(90)
    docs, labels = [], []
    for i in range(400):
        text = prose(rng.choice([5, 60, 150, 300]))
        if rng.random() < 0.15:
            text[rng.randrange(len(text))] = "zorkish"
            labels.append((i, 1))
        elif rng.random() < 0.6:
            labels.append((i, 0))
        if rng.random() < 0.1:
            text += passage
        if rng.random() < 0.1:
            text += rng.choice(items)
        docs.append([i, " ".join(text), "xx", "src", 0])
    for i in range(400, 440):
        base = docs[rng.randrange(400)][1].split(" ")
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] = rng.choice(words)
        docs.append([i, " ".join(base), "xx", "src", 0])
    docs += [[500, None, None, None, None], [501, "", "xx", "src", 0], docs[3]]
    docs = [(d, t, x, s, len(t) if t is not None else None) for d, t, x, s, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return [(i, " ".join(t)) for i, t in enumerate(items)]


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    items = make(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    results = []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, path)
        if name != "packing":
            assert found.columns == docs.columns and found.dtypes == docs.dtypes
        found.write.parquet(f"{path}/{name}")
        before, docs = docs, spark.read.parquet(f"{path}/{name}")
        rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
        if name == "toxicity":
            labels = spark.read.parquet(f"{path}/labels.parquet")
            kept = {r.doc_id for r in toxicity(before, labels).collect() if not r.predicted}
            assert {r.doc_id for r in docs.collect()} == kept and len(kept) < 430
            assert not any("zorkish" in (r.text or "") for r in docs.collect())
        elif name == "near_duplicates":
            component = {d: c for d, _, c in test_jaccard_join.brute([(r.doc_id, r.text) for r in before.collect()])}
            wanted = sorted({(r.doc_id, r.text) for r in before.collect() if component[r.doc_id] == r.doc_id}, key=str)
            assert rows(docs) == wanted and len(wanted) < before.count()
        elif name == "repeated_passages":
            old = before.collect()
            new = removed([(r.text or "").encode() for r in old])
            wanted = sorted(((r.doc_id, t if r.text is not None else None) for r, t in zip(old, new, strict=True)), key=str)
            assert rows(docs) == wanted
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in docs.collect())
            assert sum(n for _, n, _, _ in cut_by_brute_force([(r.text or "").encode() for r in old], 200)) > 0
        elif name == "decontamination":
            held = {d for d, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in before.collect()], items)}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - held and held
        else:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
        results.append(docs.count())
    assert corpus_pipeline.run(spark, path).count() == results[-1]
    assert words_of("A-b, É!") == ["a", "b", "é"]


def test_common_line_of_passages(spark, monkeypatch):
    """A line with more contexts than are gathered makes at most two rows a context in repeated_passages; what repeats across it goes."""
    monkeypatch.setattr(suffix_dedup, "HOT", 30)
    rng = random.Random(240)
    other = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    line, tail = other(110), other(115)
    texts = [other(150) + line + (tail if i % 20 == 3 else other(115)) + other(50) for i in range(240)]
    seen = []
    real = suffix_dedup.open_contexts
    monkeypatch.setattr(suffix_dedup, "open_contexts", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert [i for i, t in enumerate(texts) if found[i] != t] == list(range(3, 240, 20))
    assert all((line + tail) not in t for t in found.values())
    assert seen[0].count() <= 2 * len(texts)
