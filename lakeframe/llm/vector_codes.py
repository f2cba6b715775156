"""Product codes of vectors by dual-tree Lloyd: a codebook for each part of the vectors, exact in whole numbers.

Components are fixed-point whole numbers, and so are distances, sums and codebooks. Vectors lie in blocks; a block has a
tree over each part of its vectors, with a bounding box and the cached sum of every node, built once and written to the
shared folder. A round sends the codebooks with a tree over their entries to all blocks. Each block walks both trees
together: bounds of the distance between two nodes' boxes, and the farthest that a corner of a box can be from the
bisector of two entries, prune pairs of nodes; a node that one entry is left for goes to it as a whole, by its cached
sum; the leaves that stay uncertain compare their points with the entries that are left. Spark adds up the sums by part
and entry, at most parts x entries rows, from which the driver makes the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh_path, hand_back

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of this size or more have squared distances beyond 64 bits; their vectors are left out like infinite ones.
LIMIT = 1 << 20
#: Whole numbers below this take 64-bit arithmetic, larger ones Python's own.
SMALL = 1 << 22
BLOCK, LEAF = 4096, 32
#: Rows of label sums that are broadcast at most; beyond that they are joined in SALTS copies, a hot label's rows spread over them.
BROADCAST_ROWS, SALTS = 200_000, 16


@dataclass
class Tree:
    """Nodes over points in the order of the tree: node i has points start[i] to end[i], children left[i] and left[i] + 1 or none (-1)."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        """Halves along the widest side of a box, down to leaf points, or points that are all equal."""
        order = np.arange(len(points))
        start, end, left = [0], [len(points)], [-1]
        low, high = [points.min(axis=0)], [points.max(axis=0)]
        i = 0
        while i < len(start):
            a, b = start[i], end[i]
            width = high[i] - low[i]
            if b - a > leaf and width.any():
                middle = (a + b) // 2
                side = int(np.argmax(width))
                order[a:b] = order[a:b][np.argpartition(points[order[a:b], side], middle - a)]
                left[i] = len(start)
                for x, y in ((a, middle), (middle, b)):
                    some = points[order[x:y]]
                    start.append(x)
                    end.append(y)
                    left.append(-1)
                    low.append(some.min(axis=0))
                    high.append(some.max(axis=0))
            i += 1
        return cls(points[order], order, np.array(start), np.array(end), np.array(left), np.array(low), np.array(high))

    def sums(self) -> np.ndarray:
        upto = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points.astype(np.int64), axis=0)])
        return upto[self.end] - upto[self.start]

    def pack(self) -> bytes:
        head = np.array([len(self.order), len(self.start), self.points.shape[1]])
        arrays = (head, self.points, self.order, self.start, self.end, self.left, self.low, self.high)
        return b"".join(np.ascontiguousarray(x, "<i4").tobytes() for x in arrays)

    @classmethod
    def unpack(cls, packed: bytes) -> Tree:
        x = np.frombuffer(packed, "<i4")
        n, nodes, width = x[:3].tolist()
        kind = object if n and abs(x[3 : 3 + n * width].astype(np.int64)).max() >= SMALL else np.int64
        found, at = [], 3
        for size, wide in ((n * width, True), (n, False), (nodes, False), (nodes, False), (nodes, False), (nodes * width, True), (nodes * width, True)):
            some = x[at : at + size].astype(np.int64)
            found.append(some.astype(kind).reshape(-1, width) if wide else some)
            at += size
        return cls(*found)


def entry_tree(entries: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree down to single entries, and the entries' numbers in its order; of equal entries only the first can be nearest."""
    _, first = np.unique(entries, axis=0, return_index=True)
    first.sort()
    tree = Tree.over(entries[first], 1)
    return tree, first[tree.order]


def _least(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each value the least of its group; groups are runs."""
    return np.repeat(np.minimum.reduceat(values, begins), sizes)


def nearest(tree: Tree, sums: np.ndarray, entries: Tree, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For points in the tree's order the nearest entry (the lowest of equally near ones), and by entry the sums and counts of its points."""
    kind = object if tree.points.dtype == object or abs(entries.points).max() >= SMALL else np.int64
    points, low, high = (x.astype(kind) for x in (tree.points, tree.low, tree.high))
    entry_low, entry_high, vectors = (x.astype(kind) for x in (entries.low, entries.high, entries.points))
    squares = (vectors * vectors).sum(axis=1)
    found = np.zeros(len(points), np.int64)
    total, count = np.zeros((numbers.max() + 1, points.shape[1]), sums.dtype), np.zeros(numbers.max() + 1, np.int64)
    single = entries.left < 0
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def give(nodes: np.ndarray, places: np.ndarray) -> None:
        """Whole nodes go to an entry each: their cached sums are all that is read."""
        target = numbers[places]
        np.add.at(total, target, sums[nodes])
        np.add.at(count, target, tree.end[nodes] - tree.start[nodes])
        for node, number in zip(nodes.tolist(), target.tolist(), strict=True):
            found[tree.start[node] : tree.end[node]] = number

    def groups(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        return begins, np.diff(np.append(begins, len(p)))

    while len(p):
        begins, sizes = groups(p)
        gap = np.maximum(np.maximum(entry_low[e] - high[p], low[p] - entry_high[e]), 0)
        span = np.maximum(high[p] - entry_low[e], entry_high[e] - low[p])
        keep = (gap * gap).sum(axis=1) <= _least((span * span).sum(axis=1), begins, sizes)
        p, e = p[keep], e[keep]
        begins, sizes = groups(p)
        settled = np.repeat(np.logical_and.reduceat(single[e], begins), sizes)  # all that is left for the node are entries
        if settled.any():
            q, z = p[settled], entries.start[e[settled]]
            b, n = groups(q)
            twice = low[q] + high[q] - 2 * vectors[z]
            off = (twice * twice).sum(axis=1)
            place = np.where(off == _least(off, b, n), np.arange(len(q)), len(q))
            pivot = z[_least(place, b, n)]  # the entry nearest to the middle of the box
            lean = vectors[z] - vectors[pivot]
            ahead = np.maximum(2 * low[q] * lean, 2 * high[q] * lean).sum(axis=1) + squares[pivot] - squares[z]
            stays = (z == pivot) | (ahead > 0) | (ahead == 0) & (numbers[z] < numbers[pivot])
            keep = np.ones(len(p), bool)
            keep[settled] = stays
            p, e, settled = p[keep], e[keep], settled[keep]
            begins, sizes = groups(p)
            alone = begins[(sizes == 1) & settled[begins]]
            give(p[alone], entries.start[e[alone]])
            open_ = np.ones(len(p), bool)
            open_[alone] = False
            leaf = open_ & settled & (tree.left[p] < 0)
            if leaf.any():
                q, z = p[leaf], entries.start[e[leaf]]
                b, n = groups(q)
                for node, a, k in zip(q[b].tolist(), b.tolist(), n.tolist(), strict=True):
                    some = z[a : a + k]
                    some = some[np.argsort(numbers[some])]
                    x = points[tree.start[node] : tree.end[node]]
                    one = x[:1] if not (high[node] - low[node]).any() else x
                    best = numbers[some[(squares[some] - 2 * (one @ vectors[some].T)).argmin(axis=1)]]
                    found[tree.start[node] : tree.end[node]] = best
                    if len(one) < len(x):
                        total[best[0]] += sums[node]
                        count[best[0]] += len(x)
                    else:
                        np.add.at(total, best, x)
                        np.add.at(count, best, 1)
                open_ &= ~leaf
            p, e = p[open_], e[open_]
        if not len(p):
            break
        for nodes, sides in ((tree, 0), (entries, 1)):  # both trees go one level down
            of = (p, e)[sides]
            inner = nodes.left[of] >= 0
            halves = [np.where(inner, nodes.left[of], of), nodes.left[of][inner] + 1]
            other = (p, e)[1 - sides]
            moved, kept = np.concatenate(halves), np.concatenate([other, other[inner]])
            p, e = (moved, kept) if sides == 0 else (kept, moved)
        order = np.argsort(p, kind="stable")
        p, e = p[order], e[order]
    return found, total, count


def _blocks(parts: int, label: pa.DataType):
    """Rows of BLOCK vectors with a tree for each part."""

    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        values = table.column("v").combine_chunks()
        vectors = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        trees = [Tree.over(x.copy(), LEAF).pack() for x in np.split(vectors, parts, axis=1)]
        columns = [pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([table.column("label").to_pylist()], pa.list_(label)), pa.array([trees], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, BLOCK - rows)
                held.append(some)
                rows += some.num_rows
                at += some.num_rows
                if rows == BLOCK:
                    yield one(held)
                    held, rows = [], 0
        if rows:
            yield one(held)
        hand_back()

    return run


def _sums(books: list[np.ndarray]):
    """A task's sums and counts by part and entry."""
    trees = [entry_tree(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for packed in batch.column("trees"):
                for k, part in enumerate(packed):
                    tree = Tree.unpack(part.as_buffer())
                    _, total, count = nearest(tree, tree.sums(), *trees[k])
                    totals[k][: len(total)] += total
                    counts[k][: len(count)] += count
        rows = [(k, j, int(c[j]), t[j].tolist()) for k, (t, c) in enumerate(zip(totals, counts, strict=True)) for j in np.flatnonzero(c).tolist()]
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=["part", "entry", "n", "sums"])
        hand_back()

    return run


def _codes(books: list[np.ndarray]):
    trees = [entry_tree(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("vec_id")[row].values
                codes, error = np.zeros((len(ids), len(books)), np.int64), np.zeros(len(ids), np.int64)
                for k, part in enumerate(batch.column("trees")[row]):
                    tree = Tree.unpack(part.as_buffer())
                    found, _, _ = nearest(tree, tree.sums(), *trees[k])
                    off = tree.points.astype(np.int64) - books[k][found]
                    codes[tree.order, k] = found
                    error[tree.order] += (off * off).sum(axis=1)
                text = ["".join(f"{x:02x}" for x in c) for c in codes.tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(text), pa.array(error), batch.column("label")[row].values], names=["vec_id", "code", "error", "label"])
        hand_back()

    return run


def _next(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: floors of means, entries without points as they were."""
    width = books[0].shape[1]
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    summed = bounded(blocks.select("trees")).mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact)
    made = [b.copy() for b in books]
    for row in summed.collect():  # parts x entries rows at most
        made[row.part][row.entry] = [int(row[f"s{i}"]) // row.n for i in range(width)]
    return made


def vector_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256, label.

    Vectors that are null or hold null, non-finite or too large (LIMIT) components are dropped, and so are those whose
    number of components is not that of the first kept vector (by vec_id, nulls last) or no multiple of parts. Repeated
    rows and ids count row by row; of equal ids the smaller vector comes first. Without a label column all labels are
    null. Other columns are not read; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    has_label = "label" in embeddings.columns
    kind = dict(embeddings.dtypes)["label"] if has_label else "int"
    fits = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT)) & (F.size("embedding") > 0)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v")
    kept = embeddings.where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if has_label else F.lit(None).cast(kind)).alias("label"), whole)
    order = (F.col("vec_id").asc_nulls_last(), "v")
    first = kept.orderBy(*order).limit(1).collect()
    size = len(first[0].v) if first else 0
    final = f"vec_id long, code string, error long, label_error long, codebooks_sha256 string, label {kind}"
    if not size or size % parts:
        return spark.createDataFrame([], final)
    kept = kept.where(F.size("v") == size)
    start = np.array([r.v for r in kept.orderBy(*order).limit(entries).collect()], np.int64)  # entries rows at most
    books = np.split(start, parts, axis=1)

    path = fresh_path(spark, "vector-codes")
    schema = f"vec_id array<long>, label array<{kind}>, trees array<binary>"
    label = pa.from_numpy_dtype("int32") if kind == "int" else None
    if label is None:
        from pyspark.sql.pandas.types import to_arrow_type

        label = to_arrow_type(kept.schema["label"].dataType)
    bounded(kept).mapInArrow(_blocks(parts, label), schema).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    for _ in range(rounds):
        books = _next(blocks, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    bounded(blocks).mapInArrow(_codes(books), f"vec_id long, code string, error long, label {kind}").write.parquet(f"{path}/codes")
    codes = spark.read.parquet(f"{path}/codes")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    if sums.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        copies = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = codes.join(copies.hint("merge"), F.col("label").eqNullSafe(F.col("_label")) & (F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)) == F.col("_salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
