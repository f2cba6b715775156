import random
import re
from collections import Counter

import zstandard

from lakeframe.llm.quality import quality_bands, within_bands


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def texts():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnoé", k=rng.randint(1, 9))) for _ in range(5000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    out = [None, "", " \n\t", "a b c a b c", "a a a a", "x y z", prose(40), prose(49), prose(50), prose(3000)]
    out += ["\n".join(rng.choices([prose(6), prose(9), " ", "", "# | <a>"], k=20)) for _ in range(20)]
    out += [prose(80) + " " + "".join(rng.choices("0123456789abcdefABCDEFXYZ+/", k=9000)), prose(100) + " spam" * 3000, prose(200)]
    return out


def test_counts_and_verdicts(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(None, "a b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    found = {r.doc_id: r for r in quality_bands(docs).collect()}
    for i, text, _ in rows:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i
        data = (text or "").encode()
        ratio = len(data) / len(zstandard.ZstdCompressor(level=3).compress(data)) if data else 0.0
        assert r.ratio == ratio
        assert r.kept == (not r.base_failed and within_bands(len(data), ratio, r.chunks_out))
    assert found[8].kept and found[9].kept
    assert not found[len(rows) - 3].kept and not found[len(rows) - 4].kept
    assert quality_bands(docs.limit(0)).collect() == []


def test_bands():
    assert within_bands(1500, 2.0, 0.0) and not within_bands(1500, 3.0, 0.0)
    assert not within_bands(1500, 1.0, 0.0) and not within_bands(1500, 2.0, 0.3)
