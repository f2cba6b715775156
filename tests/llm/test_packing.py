import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from lakeframe.llm.packing import WordEncoder, pack_sequences, packing_plan


def check_plan(counts, capacity):
    plan = packing_plan(counts, capacity)
    bins = defaultdict(list)
    seen = Counter()
    for length, first, last, sequence, each, offset in plan.tolist():
        assert first == seen[length]
        seen[length] = last + 1
        for k in range(last - first + 1):
            bins[sequence + k // each].append((offset + k % each * length, length))
    assert seen == Counter({k: v for k, v in counts.items() if v})
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in places) <= 2
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def first_fit_decreasing(counts, capacity):
    free = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        for i, x in enumerate(free):
            if x >= n:
                free[i] -= n
                break
        else:
            free.append(capacity - n)
    return len(free)


def test_plans():
    rng = random.Random(4)
    assert check_plan({}, 100) == 0
    assert check_plan({100: 3}, 100) == 3
    assert check_plan({1: 250}, 100) == 3
    for _ in range(150):
        counts = {rng.randint(1, 100): rng.randint(0, 40) for _ in range(rng.randint(1, 60))}
        used = check_plan(counts, 100)
        assert used <= first_fit_decreasing(counts, 100) * 1.02 + 1


def test_words_are_encoded_as_in_whole_texts():
    encoder = WordEncoder("word_bpe_49k.json", limit=50)
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(0x250)] + ["'s", "'", "'ll", "  ", "\n", "don't", "<|endoftext|>", "Σ", "日", "\u0301", "\u2003"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        assert next(encoder.encode([text])).tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_pack(spark):
    from public_tokenizers import path

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    rng = random.Random(9)
    texts = ["", None, " \n", "don't STOP ½ é é  x y <|endoftext|> ﬁ Σας", "日本語 word", "word " * 9000]
    texts += [" ".join("".join(rng.choices("abcdeXé'1.", k=rng.randint(1, 9))) for _ in range(rng.choice([1, 9, 80, 700, 1500]))) for _ in range(60)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(8, texts[8], "clash"), (None, "null id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    found = pack_sequences(docs, with_ids=True).collect()
    pieces = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.ids_crc32, tuple(r.ids)) for r in found)
    wanted = []
    for d, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for j in range(0, len(ids), 4096):
            some = ids[j : j + 4096]
            wanted.append((d if d is not None else -1, j // 4096, j, zlib.crc32(np.array(some, "<u4").tobytes()), tuple(some)))
    assert pieces == sorted(wanted)
    by = defaultdict(list)
    for r in found:
        assert r.length == len(r.ids)
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack_sequences(docs.limit(0)).collect() == []


def test_one_length_for_all(spark):
    """All pieces share a length; whatever the parts, sequences are full and gapless."""
    docs = spark.createDataFrame([(i, "word word word") for i in range(3000)], "doc_id long, text string").repartition(7)
    found = pack_sequences(docs, capacity=40).collect()
    assert len(found) == 3000 and len({(r.sequence_id, r.offset) for r in found}) == 3000
    assert {r.length for r in found} == {4} and max(r.sequence_id for r in found) == 299
    assert {r.offset for r in found} == set(range(0, 40, 4))
