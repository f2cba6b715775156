"""Best-fit packing of tokenised documents into sequences, by large-item matching.

Documents are tokenised and cut into pieces of at most CAPACITY tokens. How pieces of given lengths are put together
depends on how many there are of each length alone, a table of at most CAPACITY rows however large the corpus: from it
the driver makes a plan. Pieces of over a third of the capacity pair at most twice per sequence, each length with the
longest that still fits (greedy matching); shorter pieces go, longest first, where they leave the least gap. The plan
gives runs of equal sequences for runs of equal lengths. Each task numbers its own pieces of each length as it cuts
them; the counts of the tasks before it, a row for each task and length in it, make these ranks of all pieces, so no
piece is sorted, however many share a length. Every piece then looks up its sequence and offset in the plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, parts, texts_of

CAPACITY = 4096
END_ID = 1
#: Lower-case letters of Latin scripts, up to U+024F.
_LATIN = "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\u024f"
#: The tokenizer's own pre-tokens in lower-cased text of those letters; what it calls space has no separators of files.
_PRETOKEN = re.compile(rf"[{_LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s0-9{_LATIN}]|[\x1c-\x1f])+")
#: Characters beyond those, once in lower case: other scripts and marks, and numbers that are no digits.
_OTHER = re.compile(r"[^\x00-\u024f]|[\xb2\xb3\xb9\xbc-\xbe]")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on.
_BYTE_NAMES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class WordEncoder:
    """Ids of texts, word by word: merges never cross words, so each distinct one is encoded once."""

    def __init__(self, name: str, limit: int = 300_000) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        merge = self.tokenizer.model.tokenize
        for word in words - self.known.keys():
            named = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(_BYTE_NAMES)
            self.known[word] = np.array([t.id for t in merge(named)], "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text and the end id."""
        end = np.uint32(END_ID).tobytes()
        lower = [t.lower() for t in texts]
        split = [None if "<|" in t or not t.isascii() and _OTHER.search(t) else _PRETOKEN.findall(t) for t in lower]
        self._learn(set().union(*(x for x in split if x)))
        known = self.known.__getitem__
        for text, words in zip(texts, split, strict=True):
            if words is None:
                yield np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], "<u4")
            else:
                yield np.frombuffer(b"".join([*map(known, words), end]), "<u4")


def _pieces(tokenizer: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in parts(batches):
            row, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts_of(batch.column("text")))):
                for j in range(0, len(ids), capacity):
                    some = ids[j : j + capacity]
                    row.append(i)
                    piece.append(j // capacity)
                    start.append(j)
                    length.append(len(some))
                    crc.append(zlib.crc32(some.tobytes()))
                    nth.append(seen[len(some)])
                    seen[len(some)] += 1
                    if with_ids:
                        kept.append(some.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def tokenised_pieces(documents: DataFrame, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """task and nth: the piece is the nth (from 0) of its length that this task has cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    return bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, capacity, with_ids), schema)


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, last rank, first sequence, pieces per sequence, offset), by length and rank.

    Pieces of a length with ranks from first to last take their places in order: so many to a sequence, from offset.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: runs (first sequence, how many)
    sequences = 0

    def take(length: int, many: int, first: int, each: int, offset: int) -> None:
        plan.append((length, rank[length], rank[length] + many - 1, first, each, offset))
        rank[length] += many
        left[length] -= many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in large:  # from the longest on
            if not left[a]:
                break
            if b > min(a, capacity - a) or not left[b]:
                continue
            many = left[a] // 2 if a == b else min(left[a], left[b])
            if many:
                take(a, many, sequences, 1, 0)
                take(b, many, sequences, 1, a)
                gaps[capacity - a - b].append((sequences, many))
                sequences += many
        if left[a]:
            many = left[a]
            take(a, many, sequences, 1, 0)
            gaps[capacity - a].append((sequences, many))
            sequences += many
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        g = s
        while left[s]:
            while g <= capacity and not gaps[g]:
                g += 1
            if g > capacity:
                many = -(-left[s] // (capacity // s))
                gaps[capacity].append((sequences, many))
                sequences += many
                g = capacity
            first, many = gaps[g].pop()
            each, filled = g // s, capacity - g
            whole = min(many, left[s] // each)
            if whole:
                take(s, whole * each, first, each, filled)
                gaps[g - each * s].append((first, whole))
            rest = left[s] if whole < many else 0  # fewer than fill one more
            if rest:
                take(s, rest, first + whole, rest, filled)
                gaps[g - rest * s].append((first + whole, 1))
            unused = many - whole - bool(rest)
            if unused:
                gaps[g].append((first + whole + bool(rest), unused))
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def _place(plan: np.ndarray, columns: list[str]):
    key = plan[:, 0] << 48 | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return run


def pack_sequences(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Null and empty texts are one piece, the end id alone. Repeated rows and null ids are packed row by row; other
    columns are not read. Sequences are numbered from 0 and filled from offset 0 without gaps.
    """
    pieces = cut(tokenised_pieces(documents, tokenizer, capacity, with_ids))
    totals = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = totals.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = packing_plan(counts, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(before, ["length", "task"]).select(*columns, (F.col("nth") + F.col("before")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(_place(plan, columns), schema)
