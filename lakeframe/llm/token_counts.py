"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree whose nodes hold sums of characters and tokens. An edit
replaces a range of characters: descending by sums of characters finds the pre-tokens it touches; scanning starts at
the first one whose characters, or those it looks ahead to, are touched, and goes on through the new text until it
is back at an old border of pre-tokens beyond the edit, from where all stays as it was. The new pre-tokens take the
place of the old ones in their leaves, and only the sums above these are renewed.

Pre-tokens are encoded alone, each once: byte-pair merges never cross them. Trees can be kept: token_trees gives a table
of them, edit_trees that table after a table of edits, without reading an untouched region again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, parts, texts_of

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Characters beyond its end that a pre-token depends on: a run of spaces gives its last one to a word after it.
LOOKAHEAD = 2
#: Pre-tokens of a leaf.
LEAF = 16
_EDIT_COLUMNS = (("start", "int"), ("end", "int"), ("new", "string"))
_EDIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())])
_EDIT_TYPE = "array<struct<start: int, end: int, new: string>>"
_STATE = "doc_id long, text string, lengths binary, tokens binary, n_tokens long"
_STATE_TYPES = (pa.string(), pa.binary(), pa.binary(), pa.int64())
_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_IPV4 = re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")


class PreTokenCounts(dict):
    """Tokens of a pre-token; forgets all when it has grown large."""

    def __init__(self, tokenizer: str = TOKENIZER) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(tokenizer), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n


class KnownCounts(dict):
    """Tokens of a kept tree's pre-tokens, and of what its edits bring; what it does not know is asked of the cache."""

    def __init__(self, pieces: list[str], tokens: np.ndarray, counts: PreTokenCounts) -> None:
        super().__init__(zip(pieces, tokens.tolist(), strict=True))
        self.counts, self.pattern = counts, counts.pattern

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.counts[piece]
        return n


class TokenTree:
    """A document's pre-tokens under sums of characters and tokens: leaf i is node size + i and holds about LEAF of them."""

    def __init__(self, pieces: list[str], tokens: np.ndarray, counts: PreTokenCounts | KnownCounts) -> None:
        """tokens: how many each piece has, known from an earlier count."""
        self.counts = counts
        self.scanned = 0  # characters that were cut and encoded anew, by all edits
        self._grow(pieces, tokens)

    @classmethod
    def of(cls, text: str, counts: PreTokenCounts) -> TokenTree:
        pieces = counts.pattern.findall(text)
        return cls(pieces, np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces)), counts)

    def _grow(self, pieces: list[str], tokens: np.ndarray) -> None:
        starts = range(0, len(pieces), LEAF)
        self.size = 1 << max(0, len(starts) - 1).bit_length()
        self.leaves = [pieces[i : i + LEAF] for i in starts] + [[]] * (self.size - len(starts))
        sums = []
        for values in (np.fromiter(map(len, pieces), np.int64, len(pieces)), tokens):
            level = np.zeros(self.size, np.int64)
            if len(pieces):
                level[: len(starts)] = np.add.reduceat(values, np.arange(0, len(pieces), LEAF))
            levels = [level]
            while len(levels[-1]) > 1:
                levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
            sums.append([0, *(x for level in reversed(levels) for x in level.tolist())])
        self.chars, self.tokens = sums

    def __len__(self) -> int:
        return self.tokens[1]

    def pieces(self) -> list[str]:
        return [p for leaf in self.leaves for p in leaf]

    def text(self) -> str:
        return "".join(self.pieces())

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place (the last leaf that has any, beyond the end), and where it begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if place - begin >= self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Put new in place of the characters from start to end."""
        leaf, at = self._leaf_at(max(0, start - LOOKAHEAD))
        first = leaf
        old: list[tuple[int, str]] = []  # begin and text of the pre-tokens drawn in so far

        def draw() -> bool:
            nonlocal leaf, at
            while leaf < self.size and not self.leaves[leaf]:
                leaf += 1
            if leaf == self.size:
                return False
            for piece in self.leaves[leaf]:
                old.append((at, piece))
                at += len(piece)
            leaf += 1
            return True

        while at <= end and draw():
            pass
        skip = 0  # pre-tokens that end before the edit, what they look ahead to included
        while skip < len(old) and old[skip][0] + len(old[skip][1]) + LOOKAHEAD <= start:
            skip += 1
        origin = old[skip][0] if skip < len(old) else at
        tail = "".join(p for _, p in old[skip:])
        text = tail[: start - origin] + new + tail[end - origin :]
        shift = len(new) - (end - start) - origin  # from old places beyond the edit to places in text
        borders = {b + shift for b, _ in old if b >= end} | {at + shift} if at >= end else set()
        pieces, place = [], 0
        while place not in borders or place < start - origin + len(new):
            found = self.counts.pattern.match(text, place)
            while found is None or found.end() + LOOKAHEAD > len(text):
                drawn = len(old)
                if not draw():
                    break
                text += "".join(p for _, p in old[drawn:])
                borders |= {b + shift for b, _ in old[drawn:]} | {at + shift}
                found = self.counts.pattern.match(text, place)
            if found is None:
                break
            pieces.append(found[0])
            place = found.end()
        self.scanned += place
        rest = [p for b, p in old if b >= end and b + shift >= place]
        self._put(first, leaf, [p for _, p in old[:skip]] + pieces + rest)

    def _put(self, first: int, last: int, pieces: list[str]) -> None:
        """Deal pieces to the leaves from first up to last, and renew the sums above them.

        Where they are too many for these leaves, all leaves are dealt anew; that sums, and encodes nothing.
        """
        last = max(last, first + 1)
        if len(pieces) > 4 * LEAF * (last - first):
            every = [p for leaf in self.leaves[:first] for p in leaf] + pieces + [p for leaf in self.leaves[last:] for p in leaf]
            self._grow(every, np.fromiter(map(self.counts.__getitem__, every), np.int64, len(every)))
            return
        each = -(-len(pieces) // (last - first))
        for i in range(first, last):
            own = pieces[(i - first) * each : (i - first + 1) * each]
            self.leaves[i] = own
            self.chars[self.size + i] = sum(map(len, own))
            self.tokens[self.size + i] = sum(self.counts[p] for p in own)
        low, high = (self.size + first) // 2, (self.size + last - 1) // 2
        while low:
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            low, high = low // 2, high // 2


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that a cleaning job makes, apart and in order: addresses are masked, lines that repeat an earlier one go."""
    edits, seen, begin = [], set(), 0
    for line in text.split("\n"):
        end = begin + len(line)
        if line.strip() and line in seen:
            edits.append((begin - 1, end, ""))
        else:
            seen.add(line)
            if "@" in line:
                edits += [(begin + m.start(), begin + m.end(), "[email]") for m in _EMAIL.finditer(line)]
            if line.count(".") > 2:
                edits += [(begin + m.start(), begin + m.end(), "[ip]") for m in _IPV4.finditer(line)]
        begin = end + 1
    done = []
    for e in sorted(edits):
        if not done or e[0] >= done[-1][1]:
            done.append(e)
    return done


def in_turn(edits: list[tuple[int, int, str]], n_chars: int) -> list[tuple[int, int, str]]:
    """Edits by place within the text, last first, so that places before one stay valid; of overlapping ones the first."""
    done: list[tuple[int, int, str]] = []
    for start, end, new in sorted((min(max(0, a), n_chars), min(max(0, a, b), n_chars), new or "") for a, b, new in edits):
        if not done or start >= done[-1][1]:
            done.append((start, end, new))
    return done[::-1]


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        edits = [[{"start": a, "end": b, "new": new} for a, b, new in redactions(x or "")] for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, pa.list_(_EDIT))], names=[*batch.schema.names, "edits"])


def _edits_of(value: list[dict] | None) -> list[tuple[int, int, str]]:
    return [(e["start"], e["end"], e["new"]) for e in value or () if e["start"] is not None and e["end"] is not None]


def _edited(tree: TokenTree, text: str, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
    turns = in_turn(edits, len(text))
    for start, end, new in turns:
        tree.edit(start, end, new)
    return (tree.text() if turns else text), len(turns)


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PreTokenCounts(tokenizer)
        for batch in parts(batches):
            rows = []
            for text, edits in zip(texts_of(batch.column("text")), batch.column("edits").to_pylist(), strict=True):
                tree = TokenTree.of(text, counts)
                before = len(tree)
                _, n = _edited(tree, text, _edits_of(edits))
                rows.append((before, n, len(tree), tree.scanned))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            names = ["n_tokens", "n_edits", "n_tokens_edited", "n_chars_scanned"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), pa.int64()) for x in columns)], names=["doc_id", *names])

    return run


def _with_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """An edits column, by doc_id: there are no more edits of a text that count than it has characters."""
    by_doc = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(*[F.col(n).cast(t).alias(n) for n, t in _EDIT_COLUMNS])).alias("edits"))
    return documents.join(by_doc, "doc_id", "left")


def edit_aware_counts(documents: DataFrame, edits: DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per row: doc_id, n_tokens, n_edits, n_tokens_edited (after the edits), n_chars_scanned (anew, for the edits).

    edits has rows (doc_id, start, end, new): new in place of the characters from start to end, places being those of
    the text as it was; without them, every text gets its redactions. Places are clipped to the text, of overlapping
    edits the first counts, and rows with a null place none. Null and empty texts have no tokens; each row is counted
    by itself, repeated or not (rows of one doc_id get the same edits), with a null id kept; other columns are not read.
    """
    rows = bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInArrow(_redact, f"doc_id long, text string, edits {_EDIT_TYPE}") if edits is None else _with_edits(rows, edits)
    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_scanned long"
    return rows.mapInArrow(_count(tokenizer), schema)


def _state(text: str, tree: TokenTree) -> tuple[str, bytes, bytes, int]:
    pieces = tree.pieces()
    tokens = np.fromiter(map(tree.counts.__getitem__, pieces), "<i4", len(pieces))
    return text, np.fromiter(map(len, pieces), "<i4", len(pieces)).tobytes(), tokens.tobytes(), len(tree)


def _plant(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PreTokenCounts(tokenizer)
        for batch in parts(batches):
            rows = [_state(text, TokenTree.of(text, counts)) for text in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _STATE_TYPES, strict=True))], names=["doc_id", "text", "lengths", "tokens", "n_tokens"])

    return run


def _replant(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PreTokenCounts(tokenizer)
        for batch in parts(batches):
            rows = []
            for row in batch.to_pylist():
                edits = _edits_of(row["edits"])
                if not edits:
                    rows.append((row["text"], row["lengths"], row["tokens"], row["n_tokens"], 0, 0))
                    continue
                ends = np.cumsum(np.frombuffer(row["lengths"], "<i4")).tolist()
                tokens = np.frombuffer(row["tokens"], "<i4").astype(np.int64)
                pieces = [row["text"][a:b] for a, b in zip([0, *ends], ends, strict=False)]
                tree = TokenTree(pieces, tokens, KnownCounts(pieces, tokens, counts))  # known from before, not encoded again
                text, n = _edited(tree, row["text"], edits)
                rows.append((*_state(text, tree), n, tree.scanned))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (*_STATE_TYPES, pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "text", "lengths", "tokens", "n_tokens", "n_edits", "n_chars_scanned"])

    return run


def token_trees(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The state to be kept, a row for each of documents: doc_id, text, its pre-tokens' lengths and tokens, n_tokens.

    A null text is kept as an empty one. lengths and tokens are little-endian 32-bit numbers, the leaves of the tree.
    """
    rows = bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_plant(tokenizer), _STATE)


def edit_trees(trees: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """trees after edits (doc_id, start, end, new), with n_edits and n_chars_scanned; edits count as in edit_aware_counts.

    Rows without edits come back as they are; in the others only what an edit touches is cut and encoded again.
    """
    rows = _with_edits(bounded(trees).select("doc_id", "text", "lengths", "tokens", "n_tokens"), edits)
    return rows.mapInArrow(_replant(tokenizer), f"{_STATE}, n_edits long, n_chars_scanned long")
