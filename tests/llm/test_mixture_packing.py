"""Mixture-controlled packing: ids, cuts and places by round trip; turns against a window-by-window simulation."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lakeframe.llm.mixture_packing import ByteEncoder, Schedule, _whole_weights, pack_mixture


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def simulated(tokens, weights, capacity):
    """What each queue sends in each window, one window after the other, by deficit counters; a queue ends a phase."""
    left, deficit, sent = list(tokens), [Fraction(0)] * len(tokens), []
    sizes = [capacity] * (sum(tokens) // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (sum(tokens) % capacity) >> b & 1]
    active = [w if n else 0 for w, n in zip(weights, left)]
    for size in sizes:
        if size < capacity:  # what is beyond the full windows is dealt among queues that still have tokens
            active = [w if n else 0 for w, n in zip(weights, left)]
        trial, room, takes = list(deficit), size, []
        for q, w in enumerate(active):
            take = 0
            if w:
                trial[q] += Fraction(room * w, sum(active[q:]))
                take = int(trial[q])
                trial[q] -= take
            room -= take
            takes.append(take)
        if all(t <= n for t, n in zip(takes, left)):
            deficit = trial
        else:
            takes = None  # the window in which a queue runs out is checked by its bounds alone
        sent.append((size, takes))
        if takes is None:
            break
        left = [n - t for n, t in zip(left, takes)]
    return sent


def pieces_of(schedule, tokens, rng):
    made = []
    for q, n in enumerate(tokens):
        at, start, length = 0, [], []
        while at < n:
            size = min(n - at, rng.randrange(1, 400))
            start.append(at)
            length.append(size)
            at += size
        row, left, size, window, offset = schedule.cuts(q, np.array(start, np.int64), np.array(length, np.int64))
        assert size.sum() == n
        for r, a, z in zip(row, left, size):
            assert start[r] <= a and a + z <= start[r] + length[r]
        made += [(w, o, z, q) for w, o, z in zip(window.tolist(), offset.tolist(), size.tolist())]
    return sorted(made)


@pytest.mark.parametrize("seed", range(12))
def test_turns_equal_a_simulation(seed):
    rng = random.Random(seed)
    tokens = [rng.choice([rng.randrange(0, 5), rng.randrange(0, 3000), rng.randrange(0, 50000)]) for _ in range(rng.randrange(1, 9))]
    weights = _whole_weights([max(t, 0.5) for t in tokens] if seed % 2 else [rng.random() + 0.01 for _ in tokens])
    capacity = rng.choice([64, 1024])
    made, windows = pieces_of(Schedule(tokens, weights, capacity), tokens, rng), {}
    for w, o, z, q in made:
        size, sums = windows.setdefault(w, (0, [0] * len(tokens)))
        assert o == size
        sums[q] += z
        windows[w] = (size + z, sums)
    assert sorted(windows) == list(range(len(windows)))
    assert all(size == capacity or size < capacity and size & (size - 1) == 0 for size, _ in windows.values())
    for w, (size, takes) in enumerate(simulated(tokens, weights, capacity)):
        assert windows[w][0] == size and (takes is None or windows[w][1] == takes)


def test_mixture_holds_in_every_window():
    tokens = [500_000, 250_000, 3_000, 70]
    made = pieces_of(Schedule(tokens, _whole_weights(tokens), 1024), tokens, random.Random(1))
    full = sum(tokens) // 1024
    taken = np.zeros((full + 20, 4))
    for w, _, z, q in made:
        taken[w, q] += z
    assert abs(taken[:full] - 1024 * np.array(tokens) / sum(tokens)).max() < 3


def test_encoder_equals_the_tokenizer():
    tok, encoder, rng = tokenizer(), ByteEncoder("byte_bpe_50k"), random.Random(3)
    texts = ["".join(rng.choice("aB1 é²\t\n\xa0\x85\x1c'.,<|>sĀΩtllre  ǀªx½_-中🙂") for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>b", "x" + " " * 20_000 + "y", "\n\t " * 4000]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, encoder.dtype).tolist() == ids_of(tok, text)


ROWS = [(i, ("Word %d, and so on; " % i) * (i % 37), f"s{min(i % 7, 3)}") for i in range(300)]
ROWS += [(1, None, "s0"), (902, "", None), (None, "no id", "s1"), (5, "twice", "s9"), (5, "twice", "s9"), (900, "long text " * 20_000, "s2")]


@pytest.mark.parametrize(("targets", "broadcast_rows"), [(None, 100_000), (None, 0), ({"s0": 3.0, "s3": 1.0, None: 1.0}, 100_000)])
def test_round_trip(spark, targets, broadcast_rows):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 AS length", "2 AS task", "3 AS queue").repartition(3)
    found = pack_mixture(df, targets, with_ids=True, broadcast_rows=broadcast_rows).toPandas()
    tok = tokenizer()
    whole = sorted((str(d), tuple(ids_of(tok, t))) for d, t, _ in ROWS)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in found.itertuples())
    sequences = found.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, rows in sequences:
        assert (rows.offset == rows.length.cumsum() - rows.length).all()
    sizes = sequences.length.sum()
    assert all(s == 1024 or s & (s - 1) == 0 for s in sizes) and (sizes == 1024).sum() == sum(len(x) for _, x in whole) // 1024
    texts = {}
    for _, rows in found[~found.doc_id.isin([1, 5])].fillna({"doc_id": -1}).groupby("doc_id"):
        rows = rows.sort_values("start")
        assert (rows.start == rows.length.cumsum() - rows.length).all() and rows.length.sum() == rows.doc_tokens.iloc[0]
        texts[rows.doc_id.iloc[0]] = tuple(i for x in rows.ids for i in x)
    assert texts == {-1 if d is None else d: tuple(ids_of(tok, t)) for d, t, _ in ROWS if d not in (1, 5)}
    assert found.length.sum() == sum(len(x) for _, x in whole)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pack_mixture(empty).count() == 0
    bare = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.length) for r in pack_mixture(bare).collect() if r.start == 0)[0] == (1, 1)
