import random

import numpy as np
import pytest

from lakeframe.llm.token_counts import PreTokenCounts, TokenTree, edit_aware_counts, edit_trees, redactions, token_trees


@pytest.fixture(scope="module")
def counts():
    return PreTokenCounts()


def test_edits_equal_full_recount(counts):
    rng = random.Random(6)
    bits = ["word", " ", "  ", "\n", "\n\n", "'s", "'", "é", "12", " 7", "!?", ".", "don't", " x", "\t", "日本", "ab"]
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randint(0, 60)))
        tree = TokenTree.of(text, counts)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 20]))
            new = "".join(rng.choices(bits, k=rng.choice([0, 0, 1, 3, 150])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text
            assert tree.pieces() == counts.pattern.findall(text)
            assert len(tree) == len(counts.encoding.encode_ordinary(text))


def test_only_the_region_is_scanned(counts):
    tree = TokenTree.of("some words and more of them. " * 500, counts)
    tree.edit(7000, 7004, "other")
    assert tree.scanned < 100


def apply(text):
    for a, b, new in reversed(redactions(text)):
        text = text[:a] + new + text[b:]
    return text


def test_query(spark, counts):
    texts = ["", None, "a b", "mail me@x.org or 10.0.0.1\nline\nline\n\nline it's\nline", "\n\n", "line\n" * 40, "x" * 5000, "a@b.cc a@b.cc\na@b.cc a@b.cc"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (3, texts[3], 1)]
    found = edit_aware_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert len(found) == len(rows)
    for r, (d, text, _) in zip(found, rows, strict=True):
        text = text or ""
        count = lambda x: len(counts.encoding.encode_ordinary(x))
        assert (r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited) == (d, count(text), len(redactions(text)), count(apply(text)))
    assert apply(texts[3]) == "mail [email] or [ip]\nline\n\nline it's"


def test_long_insertions_stay_in_balance(counts):
    tree, text = TokenTree.of("a few words", counts), "a few words"
    for i in range(5):
        new = f" inserted {i}" * 400
        tree.edit(5, 5, new)
        text = text[:5] + new + text[5:]
    assert tree.text() == text and max(map(len, tree.leaves)) <= 4 * 16
    assert len(tree) == len(counts.encoding.encode_ordinary(text))


def test_given_edits(spark, counts):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "same"), (3, "same too"), (None, "no id")], "doc_id long, text string")
    edits = [(1, 4, 7, "2"), (1, 5, 6, "overlaps"), (1, 13, 99, " four"), (2, 0, 0, "new"), (3, 0, 0, None), (3, 2, None, "x"), (9, 0, 1, "no document"), (None, 0, 1, "x")]
    found = edit_aware_counts(docs, spark.createDataFrame(edits, "doc_id long, start int, end int, new string")).collect()
    count = lambda x: len(counts.encoding.encode_ordinary(x))
    wanted = {(1, count("one two three"), 2, count("one 2 three four")), (2, 0, 1, count("new")), (3, count("same"), 1, count("same")), (3, count("same too"), 1, count("same too")), (None, count("no id"), 0, count("no id"))}
    assert {tuple(r)[:4] for r in found} == wanted
    assert edit_aware_counts(docs.limit(0), spark.createDataFrame(edits, "doc_id long, start int, end int, new string")).collect() == []


def test_trees_are_kept(spark, counts, tmp_path, monkeypatch):
    """A second run over kept trees cuts and encodes the edited spans alone."""
    texts = {i: f"document {i} has some words, and more of them. " * 300 for i in range(6)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(7, None, "x")], "doc_id long, text string, lengths string")
    token_trees(docs).write.parquet(f"{tmp_path}/0")
    schema = "doc_id long, start int, end int, new string"
    rounds = [[(i, 40 * i + 7, 40 * i + 9, f"edit{i}") for i in range(5)], [(1, 0, 5, "again"), (2, 9000, 9001, "q" * 50)]]
    for n, edits in enumerate(rounds):
        edit_trees(spark.read.parquet(f"{tmp_path}/{n}"), spark.createDataFrame(edits, schema)).drop("n_edits").write.parquet(f"{tmp_path}/{n + 1}")
        for i, a, b, new in edits:
            texts[i] = texts[i][:a] + new + texts[i][b:]
        found = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/{n + 1}").collect()}
        fresh = {r.doc_id: r for r in token_trees(spark.createDataFrame([*texts.items(), (7, None)], "doc_id long, text string")).collect()}
        edited = {e[0] for e in edits}
        for i, r in found.items():
            assert (r.text, r.lengths, r.tokens, r.n_tokens) == (fresh[i].text, fresh[i].lengths, fresh[i].tokens, fresh[i].n_tokens)
            assert 0 < r.n_chars_scanned < 200 if i in edited else r.n_chars_scanned == 0


def test_kept_trees_leave_the_cache_bounded(counts):
    """What kept trees know never enters the cache that all rows share, and is not encoded again after it was cleared."""
    from lakeframe.llm.token_counts import KnownCounts, _state

    shared = PreTokenCounts()
    for k in range(5):
        text = " ".join(f"w{k}x{i}" for i in range(2000))
        pieces = counts.pattern.findall(text)
        tokens = np.array([counts[p] for p in pieces])
        tree = TokenTree(pieces, tokens, KnownCounts(pieces, tokens, shared))
        tree.edit(10, 12, "new words")
        text = text[:10] + "new words" + text[12:]
        assert _state(text, tree)[3] == len(counts.encoding.encode_ordinary(text)) == len(tree)
    assert len(shared) < 100
