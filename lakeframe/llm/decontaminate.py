"""Benchmark decontamination: a BM25 index of the test items, searched block by block with WAND.

The index holds impacts: an item's BM25 contribution for a term, as a share of the item's score against itself, so one
threshold serves short and long items alike. Every passage of every document is a query: windows of REACH times the
longest item's words, one item's length apart, so each stretch of a text in which an item could stand lies whole in some
window. Items of up to SHORT words share one length of window; longer ones are classed by doubling lengths, and each
class has its own index and windows. Windows only retrieve: an item is judged in stretches of its own length, so the
length of other items decides nothing.

- Running sums of each word's greatest impact bound what any item can reach in a window, for all windows at once.
- Items are sorted by length and grouped in blocks; each term has its greatest impact per block, and blocks whose sum
  over a window's terms is below the threshold are skipped (block-max).
- In the blocks left, a document-at-a-time WAND with pivots retrieves every item at or above the threshold.
- A retrieved item is verified: in a stretch of STRETCH times its own words, which begins with one of its 3-word shingles,
  the score must reach the threshold again, and a large enough share of the shingles of its question (its first part)
  and of its answer (its last words) must stand there.

The index is broadcast while the items' text is within INDEX_BYTES; beyond that, items are split into as many parts as
needed and each part is searched in turn, with term statistics and lengths of windows from all items.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, parts

K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
THRESHOLD = 0.6
QUESTION_OVERLAP = 0.6
ANSWER_OVERLAP = 0.6
ANSWER_SHARE = 0.25
INDEX_BYTES = 8 << 20
#: A stretch of text in which an item is judged, by its own words; windows that stride by one item hold each such stretch whole.
STRETCH = 1.5
REACH = 1 + STRETCH
#: Items of up to so many words are one length class; each doubling beyond is another.
SHORT = 512


_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Words in lower case, without what stands around them."""
    return _WORD.findall((text or "").lower())


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges starts..ends, one range after the other."""
    size = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


@dataclass
class ItemIndex:
    items: list[int]  # ids, by place
    terms: dict[str, int]
    # postings of a term t: entries first[t] to first[t + 1], by place
    first: np.ndarray
    place: np.ndarray
    impact: np.ndarray
    # its blocks and their greatest impacts: entries block_first[t] to block_first[t + 1]
    block_first: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    highest: np.ndarray  # a term's greatest impact on any item; the last entry, of words that are no term, is 0
    question: list[set]
    answer: list[set]
    weights: list[dict[int, float]]  # an item's impacts by term
    stretch: list[int]  # words in which it is judged
    window: int
    stride: int


def length_class(n_words: int) -> int:
    return ((n_words - 1) // SHORT).bit_length()


def build_indexes(rows: list[tuple[int, list[str]]], frequency: Counter, n_items: int, mean_length: float, longest: dict[int, int]) -> list[ItemIndex]:
    """An index for each length class of the items that have words; longest: the words of each class's longest item."""
    classes: dict[int, list[tuple[int, list[str]]]] = {}
    for row in rows:
        if row[1]:
            classes.setdefault(length_class(len(row[1])), []).append(row)
    return [build_index(classes[c], frequency, n_items, mean_length, longest[c]) for c in sorted(classes)]


def build_index(rows: list[tuple[int, list[str]]], frequency: Counter, n_items: int, mean_length: float, stride: int) -> ItemIndex:
    rows = sorted(rows, key=lambda r: (len(r[1]), r[0]))
    terms: dict[str, int] = {}
    found: list[tuple[int, int, float]] = []
    for place, (_, words) in enumerate(rows):
        weight = {}
        for term, tf in Counter(words).items():
            idf = math.log(1 + (n_items - frequency[term] + 0.5) / (frequency[term] + 0.5))
            weight[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
        total = sum(weight.values())
        found += [(terms.setdefault(term, len(terms)), place, w / total) for term, w in weight.items()]
    found.sort()
    term, place, impact = (np.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.int64, np.float64), strict=True))
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    key = term * (len(rows) + 1) + place // BLOCK_ITEMS
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    block_max = np.maximum.reduceat(impact, head) if len(head) else impact
    highest = np.append(np.maximum.reduceat(impact, first[:-1]) if len(terms) else [], 0.0)
    weights: list[dict[int, float]] = [{} for _ in rows]
    for t, p, w in found:
        weights[p][t] = w
    cuts = [max(1, len(w) - max(1, round(len(w) * ANSWER_SHARE))) for _, w in rows]
    return ItemIndex(
        [i for i, _ in rows], terms, first, place, impact, np.searchsorted(term[head], np.arange(len(terms) + 1)), place[head] // BLOCK_ITEMS, block_max, highest,
        [_shingles(w[:c]) for (_, w), c in zip(rows, cuts, strict=True)], [_shingles(w[max(0, min(c, len(w) - 3)) :]) for (_, w), c in zip(rows, cuts, strict=True)],
        weights, [math.ceil(STRETCH * len(w)) for _, w in rows], math.ceil(REACH * stride), stride,
    )


def blocks_above(index: ItemIndex, query: np.ndarray, threshold: float) -> np.ndarray:
    """Blocks whose greatest impacts over the query's terms sum to threshold or more."""
    at = _runs(index.block_first[query], index.block_first[query + 1])
    bound = np.bincount(index.block[at], weights=index.block_max[at], minlength=-(-len(index.items) // BLOCK_ITEMS))
    return np.flatnonzero(bound >= threshold - 1e-6)


def wand(index: ItemIndex, query: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Every item of these blocks whose impacts over the query's distinct terms sum to threshold or more."""
    inside = np.zeros(-(-len(index.items) // BLOCK_ITEMS), bool)
    inside[blocks] = True
    lists = []
    for t in query.tolist():
        places, impacts = index.place[index.first[t] : index.first[t + 1]], index.impact[index.first[t] : index.first[t + 1]]
        here = inside[places // BLOCK_ITEMS]
        if here.any():
            lists.append([places[here].tolist(), impacts[here].tolist(), 0, float(impacts[here].max())])
    done = []
    while lists:
        lists.sort(key=lambda x: x[0][x[2]])
        bound, pivot = 0.0, None
        for x in lists:
            bound += x[3]
            if bound >= threshold - 1e-9:
                pivot = x[0][x[2]]
                break
        if pivot is None:
            break
        if lists[0][0][lists[0][2]] == pivot:
            score = 0.0
            for x in lists:
                if x[0][x[2]] != pivot:
                    break
                score += x[1][x[2]]
                x[2] += 1
            if score >= threshold - 1e-9:
                done.append((pivot, score))
        else:
            for x in lists:
                if x[0][x[2]] >= pivot:
                    break
                while x[2] < len(x[0]) and x[0][x[2]] < pivot:
                    x[2] += 1
        lists = [x for x in lists if x[2] < len(x[0])]
    return done


def matches(text: str | None, indexes: list[ItemIndex], threshold: float = THRESHOLD) -> dict[int, tuple[float, float, float]]:
    """By item id: score, question overlap and answer overlap of the best window that passes all three."""
    words = words_of(text)
    best: dict[int, tuple[float, float, float]] = {}
    for index in indexes if words else ():
        for item, found in _matches(words, index, threshold).items():
            best[item] = max(best.get(item, found), found)
    return best


def _matches(words: list[str], index: ItemIndex, threshold: float) -> dict[int, tuple[float, float, float]]:
    none = len(index.terms)
    ids = np.fromiter(map(index.terms.get, words, repeat(none)), np.int64, len(words))
    starts = np.arange(0, max(1, len(words) - index.stride), index.stride)
    ends = np.minimum(starts + index.window, len(words))
    # first over all blocks at once, then by block where that leaves a chance
    bound = np.concatenate(([0.0], np.cumsum(index.highest[ids])))
    some = np.flatnonzero(bound[ends] - bound[starts] >= threshold - 1e-4)
    best: dict[int, tuple[float, float, float]] = {}
    for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
        query = np.unique(ids[a:b])
        query = query[query < none]
        blocks = blocks_above(index, query, threshold)
        if not len(blocks):
            continue
        shingles: dict[tuple[str, ...], list[int]] = {}
        for place, _ in wand(index, query, blocks, threshold):
            if not shingles:
                for i in range(a, max(a + 1, b - 2)):
                    shingles.setdefault(tuple(words[i : min(i + 3, b)]), []).append(i)
            found = judged(index, place, ids, shingles, b, threshold)
            if found:
                best[index.items[place]] = max(best.get(index.items[place], found), found)
    return best


def judged(index: ItemIndex, place: int, ids: np.ndarray, shingles: dict[tuple[str, ...], list[int]], end: int, threshold: float) -> tuple[float, float, float] | None:
    """Score, question overlap and answer overlap of the best stretch of a window in which the item passes all three.

    shingles: those of the window, by their places in the text; end: the window's end. A stretch goes over the text's end if
    it has to.
    """
    question, answer, length = index.question[place], index.answer[place], index.stretch[place]
    at = sorted((i, s) for s in question | answer for i in shingles.get(s, ()))
    need = QUESTION_OVERLAP * len(question), ANSWER_OVERLAP * len(answer)
    inside: Counter = Counter()
    best, upto, held = None, 0, [0, 0]
    for start, first in at:
        while upto < len(at) and (at[upto][0] <= start + length - 3 or at[upto][0] == start):
            s = at[upto][1]
            inside[s] += 1
            if inside[s] == 1:
                held[0] += s in question
                held[1] += s in answer
            upto += 1
        if held[0] >= need[0] and held[1] >= need[1]:
            weights = index.weights[place]
            score = sum(weights.get(t, 0.0) for t in set(ids[start : min(start + length, end)].tolist()))
            if score >= threshold - 1e-9:
                found = (score, held[0] / len(question), held[1] / len(answer))
                best = max(best or found, found)
        inside[first] -= 1
        if not inside[first]:
            held[0] -= first in question
            held[1] -= first in answer
    return best


def _search(index: list[ItemIndex]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            row, item, score, question, answer = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for found, (s, q, a) in sorted(matches(text, index).items()):
                    row.append(i)
                    item.append(found)
                    score.append(s)
                    question.append(q)
                    answer.append(a)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("k").take(rows), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(question, pa.float64()), pa.array(answer, pa.float64())], names=["doc_id", "k", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([words_of(x) for x in batch.column("text").to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])


def indexes(benchmark: DataFrame) -> Iterator[list[ItemIndex]]:
    """The indexes of all length classes, in parts of about INDEX_BYTES of text, with term statistics over all items."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-size // INDEX_BYTES))
    split = items.mapInArrow(_split_items, "item_id long, words array<string>")
    lengths = split.groupBy(F.size("words").alias("n")).count().collect()  # few: distinct lengths
    total = sum(r["count"] for r in lengths)
    mean = sum(r.n * r["count"] for r in lengths) / max(1, total)
    longest: dict[int, int] = {}
    for r in lengths:
        c = length_class(r.n)
        longest[c] = max(longest.get(c, 0), r.n)
    for part in range(n_parts):
        own = split.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == part)
        rows = [(r.item_id, r.words) for r in own.collect()]
        if n_parts == 1:
            frequency = Counter(w for _, found in rows for w in set(found))
        else:
            words = split.select(F.explode(F.array_distinct("words")).alias("w")).join(own.select(F.explode("words").alias("w")).distinct(), "w", "left_semi")
            frequency = Counter({r.w: r["count"] for r in words.groupBy("w").count().collect()})
        yield build_indexes(rows, frequency, total, mean or 1.0, longest)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each document and item it holds.

    Null and empty texts hold nothing; null items and items without words are left out; repeated rows of a document
    are reported once each; repeated items are reported under each id; empty tables give no rows.
    """
    rows = bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k"), "text")
    schema = "doc_id long, k long, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for index in indexes(benchmark):
        part = rows.mapInArrow(_search(index), schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark item; all columns stay as they are."""

    def keep(index: list[ItemIndex]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                clean = [not matches(text, index) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for index in indexes(benchmark):
        documents = bounded(documents).mapInArrow(keep(index), documents.schema)
    return documents
