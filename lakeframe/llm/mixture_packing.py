"""Mixture-controlled packing: every window holds the sources' tokens in the target proportions, by deficit round-robin.

Each source is a queue of its documents' tokens. A window visits the queues in turn. A queue's deficit grows by its
share of the room that is left for it and the queues after it; it sends as many whole tokens as its deficit has, and
keeps the rest of it for its next turn, in the next window. The last queue takes the room that is left, so windows are
always full. Documents are cut where a queue's turn ends.

A deficit is the remainder of a running division: what the first queues have sent by window w is the quotient of that
division, so the state of every queue before any window is a formula and no window has to wait for those before it
(`Schedule.sent`). Tasks therefore cut their own documents, with the deficits that all windows before, and the
partitions that hold them, have left. A queue that runs out ends a phase; the window in which it does takes what it has,
and the others share its place from there on, their deficits carried over.

Documents are tokenised once and written to the shared folder with their place among their task's tokens of the queue;
counts of tokens by task and queue make these places in the whole queue. Nothing is sorted, and no queue meets in a task.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fresh_path, parts, texts_of

CAPACITY = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Weights of the queues sum to this at most, which keeps products of remainders within 64 bits.
WEIGHTS = 1 << 30
#: Rows of (task, queue) that are broadcast at most; beyond that they are joined by task.
BROADCAST_ROWS = 200_000
#: The fast encoder's pattern matching has a bounded stack, which very long runs of white space exceed.
LONG_SPACE = 5000
_SPACES, _PROBED = re.compile(rf"\s{{{LONG_SPACE}}}"), re.compile(r"\s\s")


def _long_space(text: str) -> bool:
    """Two neighbours of every LONG_SPACE / 2-th character lie in such a run; the text is searched only where two are spaces."""
    return bool(_PROBED.search(text[:: LONG_SPACE // 2]) and _SPACES.search(text))


class ByteEncoder:
    """Ids of texts by a byte-level vocabulary: from its ranks, or its tokenizer where a text names special tokens."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text and the end id, as bytes."""
        end = np.array([END_ID], self.dtype).tobytes()
        for text in texts:
            if any(t in text for t in self.special) or len(text) > LONG_SPACE and _long_space(text):
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
            else:
                ids = np.array(self.ranks.encode_ordinary(text), self.dtype)
            yield ids.tobytes() + end


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _tokenised(tokenizer: str):
    """A row for each document: its ids, its queue's name and its place among the task's tokens of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(tokenizer)
        width = np.dtype(encoder.dtype).itemsize
        task, seen = TaskContext.get().partitionId(), {}
        for batch in parts(batches):
            ids = list(encoder.encode(texts_of(batch.column("text"))))
            place = []
            for source, x in zip(batch.column("source").to_pylist(), ids, strict=True):
                at = seen.get(source, 0)
                place.append(at)
                seen[source] = at + len(x) // width
            counts = pa.array([len(x) // width for x in ids], pa.int64())
            columns = [batch.column("doc_id"), batch.column("source"), pa.array(ids, pa.binary()), counts, pa.array([task] * len(ids), pa.int32()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "ids", "doc_tokens", "task", "place"])

    return run


@dataclass
class Phase:
    """Windows from first on, capacity tokens each, many of them; queues that weights name as 0 send nothing.

    sent and carry: what queues have sent before, and the deficits they bring along, in their divisor's fractions.
    """

    first: int
    many: int
    capacity: int
    weights: np.ndarray
    sent: np.ndarray
    carry: np.ndarray

    def __post_init__(self) -> None:
        self.divisors = np.cumsum(self.weights[::-1])[::-1]  # what is left for a queue and those after it

    def shares(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each queue: what it has sent, and what it and those after it have, when so many windows are full."""
        room = windows * self.capacity
        for weight, divisor, carry in zip(self.weights.tolist(), self.divisors.tolist(), self.carry.tolist(), strict=True):
            take = room // divisor * weight + (room % divisor * weight + carry) // divisor if weight else room * 0
            yield take, room
            room = room - take

    def deficits(self, windows: int) -> list[Fraction]:
        """What queues have left of their quanta after so many windows, as shares of a token."""
        left, room = [Fraction(0)] * len(self.weights), windows * self.capacity
        for q, (weight, divisor, carry) in enumerate(zip(self.weights.tolist(), self.divisors.tolist(), self.carry.tolist(), strict=True)):
            if weight:
                take, rest = divmod(room * weight + carry, divisor)
                left[q] = Fraction(rest, divisor)
                room -= take
        return left

    def totals(self, windows: int) -> np.ndarray:
        return self.sent + np.array([int(take[0]) for take, _ in self.shares(np.array([windows], np.int64))], np.int64)


class Schedule:
    """Which tokens of each queue go to which window and where in it."""

    def __init__(self, tokens: list[int], weights: list[int], capacity: int) -> None:
        """tokens: in each queue; weights: targets, positive whole numbers."""
        have, total = np.array(tokens, np.int64), sum(tokens)
        wanted = np.array(weights, np.int64)
        sent, deficit = np.zeros(len(have), np.int64), [Fraction(0)] * len(have)
        self.phases: list[Phase] = []
        window, sizes = 0, [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]  # windows beyond the last full one need no padding
        while sent.sum() < total:
            left = have - sent
            full = int(left.sum()) // capacity
            size = capacity if full else sizes.pop(0)
            active = np.where(left > 0, wanted, 0)
            divisors = np.cumsum(active[::-1])[::-1]
            phase = Phase(window, max(1, full), size, active, sent, np.array([int(x * d) for x, d in zip(deficit, divisors.tolist(), strict=True)], np.int64))
            low, high = 0, max(1, full)
            while low < high:  # as many windows as no queue runs out in
                middle = (low + high + 1) // 2
                low, high = (middle, high) if (phase.totals(middle) <= have).all() else (low, middle - 1)
            if low:
                phase.many = low
                sent, deficit = phase.totals(low), phase.deficits(low)
            else:  # a window in which queues run out: they send what they have, the others take the room
                take = np.minimum(left, phase.totals(1) - sent)
                for q in np.argsort(-active, kind="stable").tolist():
                    take[q] += min(int(left[q] - take[q]), size - int(take.sum()))
                phase = Phase(window, 1, size, take, sent, np.zeros(len(have), np.int64))
                sent = sent + take
                deficit = [x if n else Fraction(0) for x, n in zip(deficit, (have - sent).tolist(), strict=True)]
            self.phases.append(phase)
            window += phase.many
        self.ends = np.array([p.totals(p.many) for p in self.phases], np.int64).reshape(len(self.phases), len(have))

    def cuts(self, queue: int, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of stretches of a queue: row of the stretch, start in the queue, length, window, offset in the window."""
        made: list[tuple[np.ndarray, ...]] = []
        for phase, end in zip(self.phases, self.ends[:, queue].tolist(), strict=True):
            begin = int(phase.sent[queue])
            some = np.flatnonzero((start < end) & (start + length > begin))
            if not len(some):
                continue
            a, b = np.maximum(start[some], begin) - begin, np.minimum(start[some] + length[some], end) - begin
            first, last = self._window(phase, queue, a), self._window(phase, queue, b - 1)
            row = np.repeat(some, last - first + 1)
            window = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + np.repeat(first, last - first + 1)
            (sent, room), (upto, after) = self._state(phase, queue, window), self._state(phase, queue, window + 1)
            left, right = np.maximum(sent, np.repeat(a, last - first + 1)), np.minimum(upto, np.repeat(b, last - first + 1))
            kept = right > left  # a queue can send nothing in a window
            before = phase.capacity - (after - room)  # what the queues before it have sent in the window
            made.append(tuple(x[kept] for x in (row, left + begin, right - left, window + phase.first, before + left - sent)))
        return tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 5

    @staticmethod
    def _state(phase: Phase, queue: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for q, state in enumerate(phase.shares(windows)):
            if q == queue:
                return state
        raise IndexError(queue)

    def _window(self, phase: Phase, queue: int, place: np.ndarray) -> np.ndarray:
        """The window that the token at a place of the queue goes to: the last one before which no more than place were sent."""
        low, high = np.zeros(len(place), np.int64), np.full(len(place), phase.many - 1, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self._state(phase, queue, middle)[0] <= place
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _placed(schedule: Schedule, dtype: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "ids"):
            start, length = (batch.column(c).to_numpy() for c in ("start", "doc_tokens"))
            ids, queues = batch.column("ids").to_pylist(), batch.column("queue").to_numpy()
            made = []
            for q in np.unique(queues).tolist():
                rows = np.flatnonzero(queues == q)
                row, *rest = schedule.cuts(q, start[rows], length[rows])
                made.append((rows[row], *rest))
            row, left, size, window, offset = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 5
            begin = left - start[row]
            width = np.dtype(dtype).itemsize
            crc, kept = [], []
            for r, a, n in zip(row.tolist(), begin.tolist(), size.tolist(), strict=True):
                some = np.frombuffer(ids[r], dtype, n, a * width).astype("<u4")
                crc.append(zlib.crc32(some))
                if with_ids:
                    kept.append(some.astype(np.int32))
            at = pa.array(row)
            columns = [batch.column("doc_id").take(at), pa.array(begin), pa.array(size), pa.array(crc, pa.int64()), batch.column("doc_tokens").take(at), pa.array(window), pa.array(offset), batch.column("source").take(at)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _whole_weights(shares: list[float]) -> list[int]:
    """Positive whole numbers in the ratio of the shares."""
    scale = (WEIGHTS - len(shares)) / sum(shares)
    return [max(1, round(x * scale)) for x in shares]


def pack_mixture(documents: DataFrame, targets: Mapping[str | None, float] | None = None, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and ids).

    targets gives sources their share of every window, in any unit; without it sources have their share of the whole
    corpus, so all queues last to the end. Sources that targets leave out, or whose share is less than a token a window
    (at most capacity sources have more), are one queue together. Null is a source of its own; without a source column all
    are null. Null and empty texts are the end id alone; repeated rows and null ids are packed row by row; other columns
    are not read; an empty table gives no rows. The tokens beyond the last full window go to windows of powers of two.
    """
    spark = documents.sparkSession
    import public_tokenizers
    from tokenizers import Tokenizer

    dtype = id_type(Tokenizer.from_file(public_tokenizers.path(f"{tokenizer}.json")).get_vocab_size())
    source = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    path = fresh_path(spark, "mixture-packing")
    schema = "doc_id long, source string, ids binary, doc_tokens long, task int, place long"
    rows = bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    rows.mapInArrow(_tokenised(tokenizer), schema).write.parquet(path)
    tokenised = spark.read.schema(schema).parquet(path)

    totals = tokenised.groupBy("task", "source").agg(F.sum("doc_tokens").alias("tokens"), F.max("place").alias("last"))
    by_source = totals.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    everything = by_source.agg(F.sum("tokens")).first()[0] or 0
    if targets is None:
        named = {r.source: r.tokens for r in by_source.where(F.col("tokens") * capacity >= F.lit(everything)).collect()}  # capacity rows at most
    else:
        named = {r.source: r.tokens for r in by_source.where(F.col("source").isin([s for s in targets if s is not None]) | (F.col("source").isNull() & F.lit(None in targets))).collect()}
    shares = {s: float(targets[s]) if targets else float(n) for s, n in named.items()}
    order = sorted(named, key=lambda s: (-shares[s], s is not None, s or ""))
    tokens, rest = [named[s] for s in order], everything - sum(named.values())
    weights = [shares[s] for s in order]
    if rest:
        tokens.append(rest)
        weights.append(float(rest) if targets is None else sum(weights) * rest / max(1, everything - rest))
    schedule = Schedule(tokens, _whole_weights(weights) if tokens else [], capacity)

    numbers = spark.createDataFrame([(s, q) for q, s in enumerate(order)], "_source string, queue int")
    known = totals.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("_source")), "left").select("task", "source", F.coalesce("queue", F.lit(len(order))).alias("queue"), "tokens")
    upto = Window.partitionBy("queue").orderBy("task", "source")  # a row for each task and source
    before = known.select(F.col("task").alias("_task"), F.col("source").alias("_from"), "queue", (F.sum("tokens").over(upto) - F.col("tokens")).alias("_before"))
    small = before.limit(broadcast_rows + 1).count() <= broadcast_rows
    same = (F.col("task") == F.col("_task")) & F.col("source").eqNullSafe(F.col("_from"))
    joined = tokenised.join(F.broadcast(before) if small else before.hint("merge"), same)
    started = joined.select("doc_id", "source", "ids", "doc_tokens", "queue", (F.col("place") + F.col("_before")).alias("start"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<int>" * with_ids
    return bounded(started).mapInArrow(_placed(schedule, dtype, with_ids), schema)
