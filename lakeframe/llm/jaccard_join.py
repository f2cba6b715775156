"""Jaccard self-join of documents on word shingles, by signature trees, and the components of its links.

1. Rows with equal shingle sets form a class, known by a 64-bit digest of the set; one row of each goes on.
2. Prefix filter: in one order of all shingles (by hash, those that are common in some part of the input last), two
   sets of similarity >= 80 % share at least l of their first n - ceil(0.8 n) + l shingles. So a set none or few of
   whose prefix shingles occur in another set's prefix has no partner and leaves; then those leave whose shingles were
   shared with such sets.
3. The rest is chained: within a shingle's sets, in order of size, each is tied to the next unless their sizes alone
   rule a link out. Components of these ties are a partition that no link crosses.
4. Each component's sets meet once. A signature tree over them (nodes hold OR-combined bitmaps and size ranges) is
   traversed against itself; a pair of nodes goes if even its greatest possible overlap is too small, or if all its
   sets are connected already. Pairs of leaves that remain are compared exactly, most promising first.
   Components of more than BLOCK sets are cut into blocks by size. At first each block meets itself and the next, which
   is linear and connects most of a group of near copies. Then only sets outside a component's largest part are dealt
   out with all blocks whose sizes allow a link; what both lie in the largest part is connected already.
5. Found links give the final components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank_within
from .common import BATCH_BYTES, bounded, cut, grouped_batches, mix64, parts, row_key

WORDS = 5
PERCENT = 80
BLOCK = 2048
LEAF = 32
#: Bytes of candidates (keys and the groups they are dealt to) up to which they are broadcast; beyond, texts and
#: candidates are shuffled.
BROADCAST_BYTES = 32 << 20
#: Shingles held to be common, at most; this only decides their place in the order.
COMMON_LIMIT = 65_536

_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    The top bits count how often a word follows itself, so that the order of hashes puts shingles such as "of of of of
    of", which many repetitive texts share, last.
    """
    if not text:
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII lower case, ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    total = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        total = (total + h[i : i + n]) * _STEP
        total ^= total >> np.uint64(29)
    same = np.zeros(n, np.uint64)
    for i in range(min(words, len(h)) - 1):
        same += h[i : i + n] == h[i + 1 : i + 1 + n]
    return np.unique(mix64(total) >> np.uint64(3) | np.minimum(same, 7) << np.uint64(61))


def digest_of(shingles: np.ndarray) -> int:
    if not len(shingles):
        return 0
    return int((mix64(np.array([mix64(shingles + np.uint64(1)).sum()], np.uint64)) + np.uint64(len(shingles)))[0].astype(np.int64))


def _slack(n: np.ndarray | int) -> np.ndarray | int:
    return np.maximum(1, n // 16)  # l


def _sets_with_common(part_share: float, words: int):
    """Rows (kind 0: doc_id, k, digest, n; kind 1: a shingle common here as digest, its count as n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in parts(batches, limit=BATCH_BYTES):
            sets = [shingle_set(x, hashes, words) for x in batch.column("text").to_pylist()]
            n, d = np.array([len(x) for x in sets], np.int64), np.array([digest_of(x) for x in sets], np.int64)
            kind = np.zeros(len(sets), np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(kind), batch.column("doc_id").cast(pa.int64()), batch.column("k"), pa.array(d), pa.array(n)], names=["kind", "doc_id", "k", "d", "n"])
            _, first = np.unique(d, return_index=True)  # copies say nothing about how common a passage is
            for i in range(0, len(first), 2000):
                some = first[i : i + 2000]
                everything = np.sort(np.concatenate([sets[x] for x in some]))
                edges = np.flatnonzero(np.concatenate(([True], everything[1:] != everything[:-1]))) if len(everything) else np.zeros(0, np.int64)
                count = np.diff(np.append(edges, len(everything)))
                often = count >= max(4, part_share * len(some))
                if often.any():
                    m, tokens = int(often.sum()), everything[edges[often]].view(np.int64)
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), none, none, pa.array(tokens), pa.array(count[often])], names=["kind", "doc_id", "k", "d", "n"])

    return run


def _emit_prefixes(common: np.ndarray, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        seen: set[int] = set()  # copies of a set in one partition count once
        for batch in parts(batches):
            tokens, digests, sizes, rows = [], [], [], 0
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, hashes, words)
                n, d = len(found), digest_of(found)
                if not n or d in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(d)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    late = common[at] == found
                    found = np.concatenate((found[~late], found[late]))
                take = min(n, n - -(-percent * n // 100) + int(_slack(n)))
                tokens.append(found[:take])
                digests.append(d)
                sizes.append((n, take))
                rows += take
                if rows > 200_000:
                    yield _prefix_batch(tokens, digests, sizes)
                    tokens, digests, sizes, rows = [], [], [], 0
            if rows:
                yield _prefix_batch(tokens, digests, sizes)

    return run


def _prefix_batch(tokens: list, digests: list, sizes: list) -> pa.RecordBatch:
    n, take = np.array(sizes, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(digests, np.int64), take)), pa.array(np.repeat(n, take).astype(np.int32))], names=["tok", "d", "n"])


def _emit_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in parts(batches):
            sets = [shingle_set(x, hashes, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("groups"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["d", "groups", "shingles"])

    return run


class _Forest:
    """Union-find; a root is the least index of its tree."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _bits(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A bitmap of 64 * words bits for each set."""
    maps = np.zeros((len(sets), words), np.uint64)
    for i, s in enumerate(sets):
        bit = s % np.uint64(64 * words)
        flags = np.zeros(64 * words, np.uint8)
        flags[bit.astype(np.int64)] = 1
        maps[i] = np.packbits(flags, bitorder="little").view(np.uint64)
    return maps


def signature_tree_links(sets: list[np.ndarray], percent: int = PERCENT, fanout: int = 8) -> tuple[list[tuple[int, int]], _Forest]:
    """Links that connect whatever sets of the given similarity connect: a spanning forest of the join's graph."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    band = np.floor(np.log(np.maximum(size, 1)) / np.log(1.25))
    order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets], np.uint64), band))  # alike sets near each other
    sets, size = [sets[i] for i in order], size[order]
    forest, links = _Forest(n), []
    words = int(np.clip(2 ** np.ceil(np.log2(max(1, np.median(size)) / 16)), 1, 1024))
    maps = _bits(sets, words)
    extra = size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)

    # levels[0]: leaves of LEAF sets; each node has its range of sets, OR bitmap, size range and greatest slack
    levels = []
    starts = np.arange(0, n, LEAF)
    while True:
        ends = np.append(starts[1:], n)
        levels.append({"a": starts, "b": ends, "or": np.bitwise_or.reduceat(maps, starts, axis=0), "low": np.minimum.reduceat(size, starts), "high": np.maximum.reduceat(size, starts), "extra": np.maximum.reduceat(extra, starts)})
        if len(starts) == 1:
            break
        starts = starts[::fanout]
    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        k, i, j = stack.pop()
        node = levels[k]
        a, b, c, d = int(node["a"][i]), int(node["b"][i]), int(node["a"][j]), int(node["b"][j])
        if i != j:
            if 100 * node["high"][i] < percent * node["low"][j] or 100 * node["high"][j] < percent * node["low"][i]:
                continue
            most = int(np.bitwise_count(node["or"][i] & node["or"][j]).sum()) + min(int(node["extra"][i]), int(node["extra"][j]))
            if (100 + percent) * most < percent * (node["low"][i] + node["low"][j]):
                continue
            root = forest.root(a)
            if all(forest.root(x) == root for x in range(a, b)) and all(forest.root(x) == root for x in range(c, d)):
                continue
        if k:
            below = levels[k - 1]["a"]
            left = range(i * fanout, min((i + 1) * fanout, len(below)))
            right = range(j * fanout, min((j + 1) * fanout, len(below)))
            stack.extend((k - 1, x, y) for x in reversed(left) for y in reversed(right) if x <= y)
            continue
        both = np.bitwise_count(maps[a:b, None, :] & maps[None, c:d, :]).sum(axis=2, dtype=np.int64)
        most = both + np.minimum(extra[a:b, None], extra[None, c:d])  # tokens that share a bit may all be common
        least = np.minimum(size[a:b, None], size[None, c:d])
        able = (100 + percent) * np.minimum(most, least) >= percent * (size[a:b, None] + size[None, c:d])
        for x, y in np.argwhere(np.triu(able, 1) if i == j else able).tolist():
            x, y = x + a, y + c
            if forest.root(x) == forest.root(y):
                continue
            common = len(sets[x]) + len(sets[y]) - len(np.union1d(sets[x], sets[y]))
            if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                links.append((int(order[x]), int(order[y])))
                forest.join(x, y)
    return links, forest


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_batches(batches, "g", 256):
            group = rows.column("g").to_numpy()
            digests = rows.column("d").to_numpy()
            packed = rows.column("shingles").to_pylist()
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            a, b = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                _, first = np.unique(digests[lo:hi], return_index=True)
                own = [int(lo + x) for x in first]
                for x, y in signature_tree_links([np.frombuffer(packed[i], np.uint64) for i in own], percent)[0]:
                    a.append(int(digests[own[x]]))
                    b.append(int(digests[own[y]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the partition's links."""
    number: dict[int, int] = {}
    forest = _Forest(0)
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for v in (x, y):
                if v not in number:
                    number[v] = len(number)
                    forest.up.append(number[v])
            forest.join(number[x], number[y])
        if len(number) > 500_000:
            yield _star(number, forest)
            number, forest = {}, _Forest(0)
    yield _star(number, forest)


def _star(number: dict[int, int], forest: _Forest) -> pa.RecordBatch:
    names = list(number)
    pairs = [(v, names[forest.root(i)]) for v, i in number.items() if forest.root(i) != i]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node of links (a, b) but roots.

    Partitions shrink to forests first; then large and small stars alternate until nothing changes.
    """
    links = links.mapInArrow(_contract, "a long, b long")
    stars = cut(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root").unionByName(least.select("node", F.col("m").alias("root")))
        stars = cut(small.distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first()
        if now == state:
            return stars
        state = now


def _links(keyed: DataFrame, members: DataFrame, percent: int, words: int, wanted: F.Column) -> DataFrame:
    """Links between members (k, d, comp, side, n, block) of one component, in those pairs of blocks that are wanted.

    A block is known by its side and number; pairs whose sizes rule a link out are left out.
    """
    ranges = members.groupBy("comp", "side", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    others = ranges.select("comp", F.col("side").alias("other_side"), F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    ordered = "(side, block) <= (other_side, other)"
    pairs = ranges.join(others, "comp").where(ordered).where(wanted).where(f"100 * high >= {percent} * other_low and 100 * other_high >= {percent} * low")
    pairs = pairs.select("comp", "side", "block", "other_side", "other", F.xxhash64("comp", "side", "block", "other_side", "other").alias("g"))
    both = pairs.select("comp", "side", "block", "g").union(pairs.where("side < other_side or block < other").select("comp", "other_side", "other", "g"))
    groups = both.groupBy("comp", "side", "block").agg(F.collect_list("g").alias("groups"))
    chosen = cut(members.join(groups, ["comp", "side", "block"]).select("k", "d", "groups"))
    size = chosen.agg(F.coalesce(F.sum(8 * F.size("groups") + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    sets = keyed.select("k", "text").join(chosen, "k").select("d", "groups", "text").mapInArrow(_emit_sets(words), "d long, groups array<long>, shingles binary")
    dealt = sets.select(F.explode("groups").alias("g"), "d", "shingles")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_verify(percent), "a long, b long")


def _outside(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """Members of the components whose blocks have not all met, in two sides: 0 the largest part, 1 the rest, in blocks of its own.

    None if there is no rest anywhere.
    """
    many = members.groupBy("comp").agg(F.max("block").alias("most")).where("most > 1").select("comp")
    if many.isEmpty():
        return None
    rooted = members.join(many, "comp").join(found.select(F.col("node").alias("d"), "root"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    parts = rooted.groupBy("comp", "root").agg(F.count("*").alias("m"))
    largest = parts.groupBy("comp").agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    sided = cut(rooted.join(largest, "comp").withColumn("side", (F.col("root") != F.col("main")).cast("int")).select("k", "d", "comp", "side", "n", "block"))
    rest = sided.where("side = 1")
    if rest.isEmpty():
        return None
    numbered = rank_within(rest.select("k", "d", "comp", "side", F.col("n").alias("size")), ["comp"], ["size", "d"])
    numbered = numbered.select("k", "d", "comp", "side", F.col("size").alias("n"), F.floor((F.col("rn") - 1) / BLOCK).cast("int").alias("block"))
    return cut(sided.where("side = 0").join(rest.select("comp").distinct(), "comp", "left_semi").unionByName(numbered))


def jaccard_components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, common_share: float = 0.002, with_key: bool = False) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included).

    Null, empty and blank texts have no shingles and are alone; shorter texts than words count as one shingle;
    repeated rows are in one component; a null doc_id takes part but is never a component's id, unless it is alone.
    Other columns are not read. with_key adds the row's key and its component as the digest of one of its sets.
    """
    spark = documents.sparkSession
    keyed = bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), "text")
    made = cut(keyed.mapInArrow(_sets_with_common(common_share, words), "kind byte, doc_id long, k long, d long, n long"))
    rows = made.where("kind = 0").select("doc_id", "k", "d", "n")
    common = made.where("kind = 1").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(COMMON_LIMIT)
    common = np.sort(np.array([r.d for r in common.select("d").collect()], np.int64).view(np.uint64))
    prefixes = keyed.select("text").mapInArrow(_emit_prefixes(common, words, percent), "tok long, d long, n int")
    by_token = Window.partitionBy("tok")
    met = F.min("d").over(by_token) < F.max("d").over(by_token)
    shared = cut(prefixes.select("tok", "d", "n", met.alias("met")).where("met").select("tok", "d", "n"))
    # at least as many shared prefix shingles as the smallest possible partner calls for
    enough = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 16))
    for _ in range(2):  # what was shared only with sets that have left is shared no more
        able = shared.groupBy("d", "n").agg(F.count_distinct("tok").alias("met")).where(F.col("met") >= enough).select("d")
        shared = shared.join(able, "d", "left_semi").select("tok", "d", "n", met.alias("met")).where("met").select("tok", "d", "n")
    in_size = by_token.orderBy("n", "d")
    ties = shared.select("d", "n", F.lag("d").over(in_size).alias("last"), F.lag("n").over(in_size).alias("last_n"))
    ties = ties.where(f"last <> d and 100 * last_n >= {percent} * n").select(F.greatest("d", "last").alias("a"), F.least("d", "last").alias("b")).distinct()
    loose = connected_components(ties)
    loose = loose.select(F.col("node").alias("d"), F.col("root").alias("comp")).unionByName(loose.select(F.col("root").alias("d"), F.col("root").alias("comp")).distinct())
    one_row = rows.where("n > 0").groupBy("d").agg(F.min("k").alias("k"), F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    blocked = rank_within(loose.join(one_row, "d").select("k", "d", "comp", F.col("n").alias("size")), ["comp"], ["size", "d"])
    members = cut(blocked.select("k", "d", "comp", F.lit(0).alias("side"), F.col("size").alias("n"), F.floor((F.col("rn") - 1) / BLOCK).cast("int").alias("block")))
    links = cut(_links(keyed, members, percent, words, F.col("other") <= F.col("block") + 1))
    found = connected_components(links)
    rest = _outside(members, found)
    if rest is not None:
        found = connected_components(links.unionByName(cut(_links(keyed, rest, percent, words, F.col("other_side") == 1))))
    roots = found.select(F.col("node").alias("d"), F.col("root")).unionByName(found.select(F.col("root").alias("d"), F.col("root")).distinct())
    named = roots.join(one_row.select("d", "rep"), "d")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("comp_rep")), "root").select("d", "root", "comp_rep")
    classes = one_row.select("d", "rep").join(named, "d", "left").select("d", F.coalesce("comp_rep", "rep").alias("component"), F.coalesce("root", "d").alias("root"))
    key = ["k", "root"] if with_key else []
    return rows.join(classes, "d", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *key)


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """documents with one row of each component, that of the least doc_id; texts without words all stay."""
    found = jaccard_components(documents, with_key=True)
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")).alias("x"))
    chosen = first.select(F.col("x.k").alias("k"), F.lit(True).alias("one")).unionByName(found.where("n_shingles = 0").select("k", F.lit(False).alias("one")).distinct())
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), row_key().alias("k"))
    kept = keyed.join(chosen, "k").withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.lit(1)))).where("not one or nth = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
