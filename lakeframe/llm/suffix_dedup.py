"""Suffix-array deduplication of repeated byte strings, by deep-shallow sorting.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else. Suffixes are sorted only where that
can matter:

1. Winnowing picks anchors: positions whose GRAM-byte hash is least in a window of SPAN - GRAM + 1 positions. Equal
   strings of SPAN bytes hold equal anchors at equal places, so whatever repeats has an anchor that repeats.
2. Anchors are shuffled by hash, after copies of a context in one batch have been settled on the spot. An anchor whose whole context (SPAN - GRAM bytes before, SPAN after) occurs again is
   settled: all of that context goes. One whose hash is alone has no repeat.
3. For the rest, contexts meet by anchor and are sorted as suffixes (to the right) and prefixes (to the left):
   multikey quicksort on 8-byte keys to a shallow depth, then blind tries for groups that still tie. Common-prefix
   lengths of sorted neighbours give, for each of the SPAN - GRAM + 1 places of a string around the anchor, the
   class of its right and of its left part; a pair of classes that occurs twice is a repeated string. An anchor with
   more than HOT different contexts (a common line) is not gathered. The strings around it are halved by their places:
   all strings of a half share more bytes than the anchor, so contexts meet by those, and halves in which they are
   still too many are halved again. A first pass tells which are common; contexts of a common line end alone mostly
   after one halving. Where NARROW strings or fewer are left (a line of over SPAN - NARROW bytes), or the first pass
   missed the anchor, being rare in each slice, each string goes by its own hash, so that only equal strings meet, and
   copies in one batch are settled on the spot. Rows that are known to be such are salted by context.
4. The ranges found are gathered by document and cut out.

Sorting work is linear in the anchors but for the sort itself; no pairs are formed within a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, byte_column, grouped_batches, mix64, row_key, slices

SPAN = 200
GRAM = 64
SHALLOW_WORDS = 4
#: Contexts of one anchor that are sorted together at most.
HOT = 20_000
#: Anchors and halves held to be common, at most, and their least share of a slice's contexts; this only decides which are halved or salted.
COMMON_LIMIT = 65_536
COMMON_SHARE = 1 / 4096
#: Strings around a common anchor, among which their places are not halved any more.
NARROW = 40
#: Contexts of hot anchors whose strings are compared before the shuffle at once.
HOT_BATCH = 2_000

_rng = np.random.default_rng(20)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of values[i : i + width] for each i, by doubling."""
    have = 1
    while have * 2 <= width:
        values = best(values[: len(values) - have], values[have:])
        have *= 2
    return best(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchors(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple:
    """Anchors of the documents in data: row, position within it, hash of the gram, hash of the context, and halves().

    Nodes are ranges of strings around an anchor: those that start first to last bytes before it.
    """
    n, width = len(data), span - gram + 1
    power, inverse = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    starts, ends = offsets[:-1], offsets[1:]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):  # no gram crosses documents or lies in a short one
        hashes[max(a, b - gram + 1) if b - a >= span else a : b] = top
    least = _sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    covered = _sliding(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero((covered[: len(hashes)] == hashes) & (hashes != top))
    row = np.searchsorted(offsets, at, side="right") - 1
    left = np.minimum(span - gram, at - starts[row])
    right = np.minimum(span, ends[row] - at)

    def hashed(i: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Hash of the bytes from before to after anchors i, and of how many these are."""
        start = at[i] - before
        string = (sums[at[i] + after] - sums[start]) * inverse[start]
        return mix64(string + mix64((before * 1024 + after).astype(np.uint64))).view(np.int64)

    def halves(i: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both halves of nodes, where a string fits: node, first, last, hash of what their strings share, hash of all their bytes."""
        middle = (first + last) // 2
        of, first, last = np.tile(np.arange(len(i)), 2), np.concatenate((first, middle + 1)), np.concatenate((middle, last))
        fits = (left[i[of]] >= first) & (right[i[of]] >= span - last)
        of, first, last = of[fits], first[fits], last[fits]
        i = i[of]
        shared = hashed(i, first, span - last).view(np.uint64)
        shared = mix64(shared + mix64((first * 1024 + last).astype(np.uint64))).view(np.int64)
        return of, first, last, shared, hashed(i, np.minimum(last, left[i]), np.minimum(span - first, right[i]))

    return row, at - starts[row], hashes[at].view(np.int64), hashed(np.arange(len(at)), left, right), halves


def blind_trie_order(strings: list[int], width: int) -> list[int]:
    """Sorted order of distinct big-endian integers of width bytes: a Patricia trie that keeps branching bytes only."""

    def byte(x: int, depth: int) -> int:
        return x >> 8 * (width - 1 - depth) & 255

    root: list | int = 0  # a leaf is an index, a node its depth and its children by byte
    for new in range(1, len(strings)):
        x, node = strings[new], root
        while isinstance(node, list):  # blind descent: skipped bytes are not compared
            node = node[1].get(byte(x, node[0]), node[2])
        differ = x ^ strings[node]
        depth = width - (differ.bit_length() + 7) // 8
        above, node = None, root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][byte(x, node[0])]
        if isinstance(node, list) and node[0] == depth:
            node[1][byte(x, depth)] = new
            continue
        some = node
        while isinstance(some, list):
            some = some[2]
        made = [depth, {byte(strings[some], depth): node, byte(x, depth): new}, some]
        if above is None:
            root = made
        else:
            above[1][byte(x, above[0])] = made
    order: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            order.append(node)
    return order


def deep_shallow_order(group: np.ndarray, raw: np.ndarray, avail: np.ndarray, shallow: int = SHALLOW_WORDS) -> np.ndarray:
    """Order of the rows of raw (n x width bytes, zeros beyond avail) by group, then bytes, then avail."""
    n, width = raw.shape
    words = np.ascontiguousarray(raw[:, : width // 8 * 8]).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    tied = group[order]
    where = np.arange(n)  # places in order that are not settled yet
    for depth in range(min(shallow, words.shape[1])):
        same = np.zeros(len(where), bool)
        if len(where):
            equal = (tied[1:] == tied[:-1]) & (np.diff(where) == 1)
            same[1:] |= equal
            same[:-1] |= equal
        where, tied = where[same], tied[same]
        if not len(where):
            return order
        rows = order[where]
        key = words[rows, depth]
        by = np.lexsort((key, tied))
        order[where], key = rows[by], key[by]
        tied = np.cumsum(np.concatenate(([True], (tied[1:] != tied[:-1]) | (key[1:] != key[:-1])))).astype(np.int64)
    ends = np.flatnonzero(np.concatenate((tied[1:] != tied[:-1], [True]))) + 1 if len(where) else []
    start = 0
    for end in ends:  # deep groups
        if end - start > 1:
            rows = order[where[start:end]]
            rows = rows[np.argsort(avail[rows], kind="stable")]
            equal: dict[int, list[int]] = {}
            for r in rows:
                equal.setdefault(int.from_bytes(raw[r].tobytes(), "big"), []).append(r)
            values = list(equal)
            order[where[start:end]] = [r for i in blind_trie_order(values, width) for r in equal[values[i]]]
        start = end
    return order


def neighbour_lcp(order: np.ndarray, group: np.ndarray, raw: np.ndarray, avail: np.ndarray) -> np.ndarray:
    """Bytes that each row of order shares with the one before it; -1 where a group begins."""
    lcp = np.full(len(order), -1, dtype=np.int64)
    width = raw.shape[1]
    for i in range(1, len(order), 8192):
        here, before = order[i : i + 8192], order[i - 1 : i - 1 + len(order[i : i + 8192])]
        differ = raw[here] != raw[before]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        first = np.minimum(first, np.minimum(avail[here], avail[before]))
        lcp[i : i + len(here)] = np.where(group[here] == group[before], first, -1)
    return lcp


def repeated_around(group: np.ndarray, left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, node: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the farthest and nearest start before it, within its node, of a repeated string; -1 if there is none."""
    n, reach = len(group), span - gram
    r_order = deep_shallow_order(group, right[:, gram:], right_n)  # the gram itself is equal
    r_lcp = neighbour_lcp(r_order, group, right, right_n)
    l_order = deep_shallow_order(group, left, left_n)
    l_lcp = neighbour_lcp(l_order, group, left, left_n)
    farthest, nearest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    first, last = node >> 10, node & 1023
    for before in range(reach + 1):
        r_class[r_order] = np.cumsum(r_lcp < span - before)
        l_class[l_order] = np.cumsum(l_lcp < before)
        rows = np.flatnonzero((left_n >= before) & (right_n >= span - before) & (first <= before) & (before <= last))
        key = r_class[rows] * (n + 1) + l_class[rows]
        by = np.argsort(key)
        key = key[by]
        twice = np.zeros(len(rows), bool)
        if len(rows):
            equal = key[1:] == key[:-1]
            twice[1:] |= equal
            twice[:-1] |= equal
        hit = rows[by[twice]]
        farthest[hit] = before
        nearest[hit[nearest[hit] < 0]] = before
    return farthest, nearest


def _in_order(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by h and c, and what repeats both of its neighbour."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    return order, np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))[: len(h)]


def _contexts(batch: pa.RecordBatch, span: int, gram: int) -> Iterator[tuple]:
    """Anchors of a batch, slice by slice: row, position, hash, context's hash and halves()."""
    data, offsets = byte_column(batch.column("text"))
    for i, j in slices(offsets):
        if offsets[j] - offsets[i] < span:
            continue
        row, at, h, c, halves = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], span, gram)
        if len(row):
            yield row + i, at, h, c, halves


def _nodes(h: np.ndarray, c: np.ndarray, halves, reach: int, common) -> Iterator[tuple[np.ndarray, ...]]:
    """Nodes of a slice, level by level: anchor, first, last, hash of what the strings share, hash of all their bytes, what repeats both, what occurs twice.

    Of equal nodes one goes on; what common(hash) holds of those is halved for the next level.
    """
    i, first, last = np.arange(len(h)), np.zeros(len(h), np.int64), np.full(len(h), reach)
    twice = np.zeros(len(h), bool)
    while len(i):
        order, again = _in_order(h, c)
        i, first, last, h, c = (x[order] for x in (i, first, last, h, c))
        twice = twice[order] | again | np.append(again[1:], False)
        often = np.zeros(len(i), bool)
        often[~again] = common(h[~again])
        on = often & (last - first >= NARROW)
        yield i, first, last, h, c, again, twice, often, on
        i, twice = i[on], twice[on]
        of, first, last, h, c = halves(i, first[on], last[on])
        i, twice = i[of], twice[of]


def _emit_common(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, c, halves in _contexts(batch, span, gram):
                least = max(4, COMMON_SHARE * len(h))

                def common(h: np.ndarray, least: float = least) -> np.ndarray:
                    _, where, n = np.unique(h, return_inverse=True, return_counts=True)
                    return n[where] >= least

                for _, _, _, h, c, _, twice, often, _ in _nodes(h, c, halves, span - gram, common):
                    if often.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[often]) for x in (h, c, twice)], names=["h", "c", "sure"])

    return run


def common_anchors(keyed: DataFrame, span: int, gram: int) -> np.ndarray:
    """Sorted hashes of anchors, and of halves around them, with more than HOT contexts, not all of which repeat: those of most contexts, COMMON_LIMIT at most.

    Contexts are counted in the slices of which their anchor is a share.
    """
    found = keyed.select("text").mapInArrow(_emit_common(span, gram), "h long, c long, sure boolean")
    found = found.groupBy("h", "c").agg((F.max("sure") | (F.count("*") > 1)).alias("settled")).groupBy("h").agg(F.count("*").alias("n"), F.min("settled").alias("settled"))
    return np.sort(np.array([r.h for r in found.where((F.col("n") > HOT) & ~F.col("settled")).orderBy(F.desc("n"), "h").limit(COMMON_LIMIT).select("h").collect()], np.int64))


def _emit_anchors(span: int, gram: int, hot: np.ndarray, salts: int):
    def common(h: np.ndarray) -> np.ndarray:
        return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k").to_numpy()
            for row, at, h, c, halves in _contexts(batch, span, gram):
                for i, first, last, h, c, again, twice, often, on in _nodes(h, c, halves, span - gram, common):
                    salt = np.where(often, 1 + c % salts, 0).astype(np.int32)
                    k, place = keys[row[i]], at[i]
                    # one row speaks for a node to the others of its hash; its copies here are settled and go anywhere
                    h = np.where(again, mix64(k.view(np.uint64) + place.astype(np.uint64)).view(np.int64), h)
                    columns = (h, salt, c, k, place.astype(np.int32), (first * 1024 + last).astype(np.int32), twice)
                    yield pa.RecordBatch.from_arrays([pa.array(x[~on]) for x in columns], names=["h", "salt", "c", "k", "at", "node", "sure"])

    return run


def string_keys(text: bytes, h: np.ndarray, at: np.ndarray, node: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of span bytes in text of one of these nodes: the node's number, bytes before its anchor, hash.

    The hash covers the node's hash and the place too: one string may hold several anchors and is no repeat of itself.
    """
    n = len(text)
    power, inverse = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[np.frombuffer(text, np.uint8)] * power[:n], out=sums[1:])
    before = np.arange(span - gram + 1)
    start = at[:, None] - before
    row, before = np.nonzero((start >= 0) & (start + span <= n) & (node[:, None] >> 10 <= before) & (before <= node[:, None] & 1023))
    start = at[row] - before
    string = (sums[start + span] - sums[start]) * inverse[start]
    return row, before, mix64(string + mix64(h[row].view(np.uint64) + before.astype(np.uint64))).view(np.int64)


def _settle_strings(found: list[tuple[np.ndarray, ...]], span: int) -> pa.RecordBatch:
    """Rows for the strings (anchor's number, document, place of the anchor, bytes before it, hash) of some contexts."""
    context, k, at, before, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((context, h))
    context, k, at, before, h = (x[order] for x in (context, k, at, before, h))
    again = np.concatenate(([False], h[1:] == h[:-1]))
    sure = again | np.append(again[1:], False)
    lo, hi = at - before, at - before + span
    # all strings of a context hold its anchor, so those that are settled make one range, which can go anywhere
    by = np.flatnonzero(sure)
    by = by[np.argsort(context[by], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], context[by][1:] != context[by][:-1]))) if len(by) else by
    settled = by[first]
    low, high = (np.minimum.reduceat(lo[by], first), np.maximum.reduceat(hi[by], first)) if len(by) else (lo[:0], hi[:0])
    one = ~again
    anywhere = mix64(k[settled].view(np.uint64) + at[settled].astype(np.uint64)).view(np.int64)
    columns = [np.concatenate(x) for x in ((h[one], anywhere), (k[one], k[settled]), (lo[one].astype(np.int32), low.astype(np.int32)), (hi[one].astype(np.int32), high.astype(np.int32)))]
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns[:3]), pa.nulls(n, pa.int32()), pa.array(columns[3]), pa.array(np.arange(n) >= one.sum()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["h", "k", "at", "node", "hi", "sure", "left", "right"])


def _emit_contexts(span: int, gram: int):
    """Contexts to be sorted have no hi; a string of a hot node has its range as at and hi instead of a context."""

    def contexts(h: list, k: list, at: list, node: list, left: list, right: list) -> pa.RecordBatch:
        columns = [pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(at, pa.int32()), pa.array(node, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.bool_()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["h", "k", "at", "node", "hi", "sure", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n_hot = [], 0
        for batch in batches:
            h, k, at, node, left, right = [], [], [], [], [], []
            texts = batch.column("text")
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                key = batch.column("k")[i].as_py()
                hot = [(x["h"], x["at"], x["node"]) for x in wanted if x["hot"]]
                for j in range(0, len(hot), HOT_BATCH):
                    hs, places, nodes = (np.array(x, np.int64) for x in zip(*hot[j : j + HOT_BATCH], strict=True))
                    row, before, strings = string_keys(text, hs, places, nodes, span, gram)
                    found.append((row + n_hot, np.full(len(row), key), places[row], before, strings))
                    n_hot += len(hs)
                    if n_hot >= HOT_BATCH:
                        yield _settle_strings(found, span)
                        found, n_hot = [], 0
                for x in wanted:
                    if x["hot"]:
                        continue
                    p = x["at"]
                    h.append(x["h"])
                    k.append(key)
                    at.append(p)
                    node.append(x["node"])
                    left.append(text[max(0, p - span + gram) : p][::-1])
                    right.append(text[p : p + span])
                if len(h) >= 20_000:
                    yield contexts(h, k, at, node, left, right)
                    h, k, at, node, left, right = [], [], [], [], [], []
            if h:
                yield contexts(h, k, at, node, left, right)
        if found:
            yield _settle_strings(found, span)

    return run


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in values), np.uint8).reshape(len(values), width), np.array([len(x) for x in values], np.int64)


def _sort_contexts(span: int, gram: int):
    reach = span - gram
    left_width = -(-reach // 8) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_batches(batches, "h", 20_000):
            hot = rows.filter(rows.column("hi").is_valid())
            if hot.num_rows:
                h = hot.column("h").to_numpy()  # in order
                again = np.concatenate(([False], h[1:] == h[:-1]))
                hit = pa.array(again | np.append(again[1:], False) | hot.column("sure").to_numpy().astype(bool))
                yield from hot.filter(hit).select(["k", "at", "hi"]).rename_columns(["k", "lo", "hi"]).combine_chunks().to_batches()
                rows = rows.filter(rows.column("hi").is_null())
                if not rows.num_rows:
                    continue
            rows = rows.combine_chunks()
            group = np.unique(rows.column("h").to_numpy(), return_inverse=True)[1].astype(np.int64)
            left, left_n = _matrix(rows.column("left"), left_width)
            right, right_n = _matrix(rows.column("right"), span)
            far, near = repeated_around(group, left, left_n, right, right_n, rows.column("node").to_numpy().astype(np.int64), span, gram)
            hit = np.flatnonzero(far >= 0)
            at = rows.column("at").to_numpy()[hit]
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("k").to_numpy()[hit]), pa.array((at - far[hit]).astype(np.int32)), pa.array((at + span - near[hit]).astype(np.int32))], names=["k", "lo", "hi"])

    return run


def _merged(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, maximal ranges of the union, within 0..n."""
    order = np.argsort(lo)
    lo, hi = np.maximum(lo[order], 0), np.minimum(np.maximum.accumulate(hi[order]), n)
    first = np.concatenate(([True], lo[1:] > hi[:-1]))
    last = np.concatenate((first[1:], [True]))
    return lo[first], hi[last]


def _cut_out(with_text: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, digest, kept_texts = [], [], [], [], []
            texts, ranges = batch.column("text"), batch.column("ranges")
            for i in range(batch.num_rows):
                text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                kept, gone, runs = text, 0, 0
                if ranges[i].is_valid and len(ranges[i]):
                    values = ranges[i].values
                    lo, hi = _merged(values.field("lo").to_numpy(), values.field("hi").to_numpy(), len(text))
                    gone, runs = int((hi - lo).sum()), len(lo)
                    edges = [0, *np.stack((lo, hi), axis=1).ravel().tolist(), len(text)]
                    kept = b"".join(text[edges[x] : edges[x + 1]] for x in range(0, len(edges), 2))
                n_bytes.append(len(text))
                removed.append(gone)
                spans.append(runs)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode("utf-8", "ignore") if texts[i].is_valid else None)
            made = {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                made["kept_text"] = pa.array(kept_texts, pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made.values()], names=[*columns, *made])

    return run


def open_contexts(keyed: DataFrame, near: DataFrame, span: int, gram: int) -> DataFrame:
    """What has to meet by h: contexts of nodes with up to HOT different ones, strings of the nodes with more."""
    by_node = Window.partitionBy("h", "salt")
    salted = F.col("salt") > 0  # a part of a node that is known to be hot
    # of a context that occurs often one row is enough for the others of its node to be compared with
    unsettled = near.where(F.col("varied") | salted).select(
        "*", (F.max(~F.col("settled")).over(by_node) | salted).alias("open"), ((F.count_if(~F.col("as_last")).over(by_node) > HOT) | salted).alias("hot")
    ).where("open and not as_last")
    wanted = unsettled.groupBy("k").agg(F.collect_list(F.struct("h", "at", "node", "hot")).alias("wanted"))
    # all columns, though few are needed: so this join and the last one read the same shuffle of the texts
    return keyed.join(wanted, "k").select(*keyed.columns, "wanted").mapInArrow(_emit_contexts(span, gram), "h long, k long, at int, node int, hi int, sure boolean, left binary, right binary")


def suffix_array_dedup(documents: DataFrame, span: int = SPAN, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, and a struct of the row).

    Strings are of UTF-8 bytes and judged on the input. Null text counts as empty (kept_text stays null); texts
    shorter than span lose nothing; repeated rows are copies of each other, so both lose what they share; a null
    doc_id is returned as it is; other columns, whatever their names, go into the struct "row" if with_text is set,
    else they are not read. kept_text drops bytes of characters that a cut splits.
    """
    spark = documents.sparkSession
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    row = [F.struct(*others).alias("row")] if with_text else []
    keyed = bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("binary").alias("text"), *row)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = common_anchors(keyed, span, gram)
    found = keyed.select("k", "text").mapInArrow(_emit_anchors(span, gram, common, parts), "h long, salt int, c long, k long, at int, node int, sure boolean")
    by_node = Window.partitionBy("h", "salt")
    in_order = by_node.orderBy("c")
    near = found.select(
        "h", "salt", "c", "k", "at", "node", "sure",
        (F.lag("c").over(in_order) == F.col("c")).alias("as_last"),
        (F.lead("c").over(in_order) == F.col("c")).alias("as_next"),
        (F.min("c").over(by_node) < F.max("c").over(by_node)).alias("varied"),
    ).select("h", "salt", "k", "at", "node", "varied", F.coalesce("as_last", F.lit(False)).alias("as_last"), (F.col("sure") | F.coalesce("as_last", F.lit(False)) | F.coalesce("as_next", F.lit(False))).alias("settled"))
    settled = near.where("settled").select("k", (F.col("at") - F.col("node").bitwiseAND(1023)).alias("lo"), (F.col("at") + span - F.shiftright("node", 10)).alias("hi"))
    contexts = open_contexts(keyed, near, span, gram)
    ranged = contexts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_sort_contexts(span, gram), "k long, lo int, hi int")
    ranges = settled.unionByName(ranged).groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    kept = ["doc_id", *["row"] * with_text]
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    texts = [T.StructField(c, T.StringType()) for c in ("kept_sha256", *["kept_text"] * with_text)]
    schema = T.StructType([*(keyed.schema[c] for c in kept), *counts, *texts])
    return keyed.join(ranges, "k", "left").select(*kept, "text", "ranges").mapInArrow(_cut_out(with_text, kept), schema)


def cut_repeats(documents: DataFrame) -> DataFrame:
    """documents with repeated strings cut out of their texts; n_chars, if there, follows; no row goes."""
    found = suffix_array_dedup(documents, with_text=True)
    columns = []
    for c in documents.columns:
        made = F.col("kept_text") if c == "text" else F.length("kept_text").cast(documents.schema[c].dataType) if c == "n_chars" else F.col("row").getField(c)
        columns.append(made.alias(c))
    return found.select(*columns)
