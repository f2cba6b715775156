"""Collocations: each language's best phrases of 2 to 5 words, by best-first branch and bound over phrases' first words.

The score of a phrase is 1000 a n / (l r) for its worst cut into a first part (l) and a rest (r); a is how often the
phrase occurs. As a is at most r, a phrase that begins with word w scores at most 1000 n / f(w), and so does all that
grows out of it: counts of prefixes bound whole branches. The frontier holds words, and phrases that occur often enough
to be grown by a word. A step takes the best nodes of each language (NODES in all; a phrase of an opened branch comes
first, as its bound is the higher one), counts every word that follows them in one pass over the texts, and keeps those
that occur often enough. A lower bound of the scores found so far (a rest occurs at most as often as any of its words)
gives the score of the TOP-th phrase that survives; branches whose bound is below it are never grown. When no node is
left above it, rests that lie in unopened branches are counted for the phrases that can still be among the best, and
scores are exact.

A phrase goes if a longer one that holds it is as frequent. Then one with a word more is, too: all its occurrences have
the same word before them, or the same word after them, which the counting pass sees.

Words are known by 64-bit hashes that depend on the language; phrases by the hashes of their words, all compared. What
reaches the driver and is sent to tasks is a step's nodes and a bitmap of frequent words of a fixed size.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fresh_path, hand_back, mix64, parts

LEAST, LONGEST, TOP = 100, 5, 2000
#: Nodes that are grown, or rests that are counted, in one pass over the texts.
NODES = 1 << 17
#: Bits of the bitmap of frequent words: 2 MB whatever the corpus; what passes it by chance is counted and then left out.
BITS = 24
#: Words that are counted in a task before their counts are given to Spark, and hashes that are remembered.
DISTINCT, REMEMBERED = 300_000, 400_000
#: Followers that are held before they are counted.
HELD = 1 << 20
_FOLD = bytes(0x2E if x in b".,;:!?\n\x0b\x0c\r" else 0x20 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))
_STEP, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with b"." where a piece ends."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


class WordHashes(dict):
    """64-bit hashes of a language's words, never 0."""

    def __init__(self, lang: str) -> None:
        self.seed = xxhash.xxh64_intdigest(lang.encode()) & 0x7FFFFFFFFFFFFFFF
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self[b"."] = 0
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed) or 1
        return h


def _language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """A batch's languages, each with the bytes of its texts."""
    langs = np.array(["und" if x is None else x for x in batch.column("lang").to_pylist()], object)
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    for lang in sorted(set(langs.tolist())):
        yield lang, [texts[i] for i in np.flatnonzero(langs == lang) if texts[i]]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, hash, n) of what was read since the last such rows; the empty word stands for all words of a language."""
    counts: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        lang, word, hashed, n = [], [], [], []
        for name, counter in counts.items():
            hashes = WordHashes(name)
            counter.pop(b".", None)
            counter[b""] = sum(counter.values())
            lang += [name] * len(counter)
            word += counter.keys()
            n += counter.values()
            hashed.append(np.array([hashes[w] for w in counter], np.uint64).astype(np.int64))
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(np.concatenate([*hashed, np.zeros(0, np.int64)])), pa.array(n, pa.int64())], names=["lang", "word", "h", "n"])

    for batch in parts(batches):
        for lang, texts in _language(batch):
            counter = counts.setdefault(lang, Counter())
            for text in texts:
                counter.update(tokens(text))
        if sum(map(len, counts.values())) > DISTINCT:
            yield flush()
    yield flush()
    hand_back()


def _hashes(batch: pa.RecordBatch, known: dict[str, WordHashes]) -> np.ndarray:
    """The hashes of all words of a batch in order, 0 where a piece or a text ends."""
    found = []
    for lang, texts in _language(batch):
        hashes = known.setdefault(lang, WordHashes(lang))
        for text in texts:
            words = tokens(text)
            found += [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), np.zeros(1, np.uint64)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class Phrases:
    """Phrases of up to LONGEST - 1 words by length, to be found in a stream of words."""

    def __init__(self, words: list[list[int]]) -> None:
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for m in sorted({len(w) for w in words}):
            rows = np.array([i for i, w in enumerate(words) if len(w) == m], np.int64)
            table = np.array([words[i] for i in rows], np.int64).astype(np.uint64).reshape(len(rows), m)
            key = functools.reduce(_chain, table.T)
            order = np.argsort(key)
            likely = np.zeros(1 << 20, bool)
            likely[(key >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[m] = key[order], rows[order], table[order], likely

    def places(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, places and phrases (as their number) of all occurrences in h; none crosses a 0, as no phrase holds one."""
        if not len(h):
            return
        chained, upto = None, 0
        for m, (key, rows, table, likely) in self.by_length.items():
            while upto < m and upto < len(h):
                chained = h if chained is None else _chain(chained[: len(h) - upto], h[upto:])
                upto += 1
            if upto < m:
                return
            at = np.flatnonzero(likely[(chained >> np.uint64(44)).astype(np.int64)])
            near = np.minimum(np.searchsorted(key, chained[at]), len(key) - 1)
            hit = key[near] == chained[at]
            at, near = at[hit], near[hit]
            same = np.ones(len(at), bool)
            for j in range(m):
                same &= h[at + j] == table[near, j]
            yield m, at[same], rows[near[same]]


def _chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * _STEP + right * _ODD)


def _grouped(keys: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Distinct keys with their counts and the least and greatest word before and after them."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if len(order) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    if not len(begins):
        return [*keys, *[np.zeros(0, np.int64)] * 5]
    ends = [f.reduceat(x[order], begins) for x in (before, after) for f in (np.minimum, np.maximum)]
    return [*[k[begins] for k in keys], np.diff(np.append(begins, len(order))), *ends]


_NEIGHBOURS = ("before_low", "before_high", "after_low", "after_high")


def _grown(nodes: list[list[int]], frequent: np.ndarray):
    """(node, next, n, and the range of words before and after) of the words that follow nodes, of frequent ones by the bitmap."""
    phrases = Phrases(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, WordHashes] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            node, word, before, after = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 4
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _grouped([node, word], before, after)], names=["node", "next", "n", *_NEIGHBOURS])

        for batch in parts(batches):
            h = np.concatenate([np.zeros(1, np.uint64), _hashes(batch, known), np.zeros(1, np.uint64)])
            for m, at, node in phrases.places(h):
                word = h[at + m]
                keep = word != 0
                keep[keep] = _in_bitmap(word[keep], frequent)
                at, node = at[keep], node[keep]
                if len(at):
                    held.append((node, *(x.astype(np.int64) for x in (h[at + m], h[at - 1], h[at + m + 1]))))
                    size += len(at)
            if size > HELD:
                yield flush()
                size = 0
        yield flush()
        hand_back()

    return run


def _counted(rests: list[list[int]]):
    """(node, n) of given phrases."""
    phrases = Phrases(rests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, WordHashes] = {}
        total = np.zeros(len(rests), np.int64)
        for batch in parts(batches):
            for _, _, node in phrases.places(_hashes(batch, known)):
                total += np.bincount(node, minlength=len(rests))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["node", "n"])
        hand_back()

    return run


def _in_bitmap(words: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = (words & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1 != 0


def _bitmap(words: DataFrame) -> np.ndarray:
    """A bit for each frequent word's hash."""
    place = words.select(F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)).alias("p"))
    rows = place.groupBy(F.expr("shiftright(p, 5)").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("b")).collect()  # 2^(BITS - 5) rows at most
    found = np.zeros(1 << BITS - 5, "<u4")
    for r in rows:
        found[r.i] = r.b
    return found.view(np.uint8)


def _div(a: str, n: str, left: str, right: str) -> str:
    """floor(1000 a n / (left right)) in whole numbers of up to 36 digits."""
    return f"(1000BD * cast({a} as decimal(15,0)) * cast({n} as decimal(15,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))"


#: Over words, the counts of their prefixes (the whole phrase last) and of themselves: the score if every rest occurred as often
#: as its rarest word, and if longer rests occurred as seldom as the phrase.
_A, _CUTS = "element_at(prefixes, -1)", "sequence(1, size(words) - 1)"
_LOWER = f"array_min(transform({_CUTS}, k -> {_div(_A, 'total', 'prefixes[k - 1]', 'array_min(slice(singles, k + 1, size(words)))')}))"
_UPPER = f"array_min(transform({_CUTS}, k -> {_div(_A, 'total', 'prefixes[k - 1]', f'if(k = size(words) - 1, element_at(singles, -1), {_A})')}))"
_FOUND = f"lang string, words array<long>, prefixes array<long>, singles array<long>, total long, {' long, '.join(_NEIGHBOURS)} long, lower long, upper long, bound long"
_ROW = "node long, lang string, words array<long>, prefixes array<long>, singles array<long>, total long"


class _Growth:
    """The frontier and what has been found, in tables of the shared folder."""

    def __init__(self, documents: DataFrame, least: int, longest: int, top: int, nodes: int) -> None:
        self.spark = documents.sparkSession
        self.path = fresh_path(self.spark, "collocations")
        self.least, self.longest, self.top, self.nodes = least, longest, top, nodes
        lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
        self.texts = documents.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
        counted = bounded(self.texts).mapInArrow(_count_words, "lang string, word binary, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("f"))
        counted.where((F.col("f") >= least) | (F.col("word") == F.lit(b""))).write.parquet(f"{self.path}/words")
        table = self.spark.read.parquet(f"{self.path}/words")
        self.words = table.where(F.col("word") != F.lit(b""))
        self.total = {r.lang: r.f for r in table.where(F.col("word") == F.lit(b"")).collect() if r.f}  # a row for each language
        self.opened = dict.fromkeys(self.total, (0, -(1 << 63)))  # the last word of each language whose branch was opened, by (f, h)
        self.threshold = dict.fromkeys(self.total, 0)
        self.found: DataFrame | None = None
        self.steps = 0
        self.frequent = _bitmap(self.words)

    def _languages(self, langs: list[str]) -> DataFrame:
        rows = [(x, self.total[x], self.threshold[x], *self.opened.get(x, (0, 0))) for x in langs]
        return F.broadcast(self.spark.createDataFrame(rows, "lang string, total long, threshold long, last_f long, last_h long"))

    def open(self, room: int) -> list[tuple]:
        """The next words of each language, rarest first, whose branches can hold one of the best phrases."""
        langs = list(self.opened)
        if not langs:
            return []
        each = max(1, room // len(langs))
        beyond = "(f, h) > (last_f, last_h) and (1000 * total) div f >= threshold"
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("f", "h"))
        rows = self.words.join(self._languages(langs), "lang").where(beyond).withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "h", "f").collect()  # room rows at most
        for lang in langs:
            last = max(((r.f, r.h) for r in rows if r.lang == lang), default=None)
            if last:
                self.opened[lang] = last
            else:
                del self.opened[lang]  # nothing is left above the threshold, which only rises
        return [(r.lang, [r.h], [r.f], [r.f]) for r in rows]

    def grow(self, nodes: list[tuple]) -> DataFrame:
        """What occurs often enough of the nodes with a word more; written, and taken up among what was found."""
        table = self.spark.createDataFrame([(i, *n, self.total[n[0]]) for i, n in enumerate(nodes)], _ROW)  # nodes rows
        schema = "node long, next long, n long, " + ", ".join(f"{c} long" for c in _NEIGHBOURS)
        ranges = [(F.min if c.endswith("low") else F.max)(c).alias(c) for c in _NEIGHBOURS]
        followers = bounded(self.texts).mapInArrow(_grown([n[1] for n in nodes], self.frequent), schema).groupBy("node", "next").agg(F.sum("n").alias("n"), *ranges).where(F.col("n") >= self.least)
        singles = self.words.select("lang", F.col("h").alias("next"), "f")
        grown = followers.join(F.broadcast(table), "node").join(singles, ["lang", "next"]).selectExpr("lang", "array_append(words, next) as words", "array_append(prefixes, n) as prefixes", "array_append(singles, f) as singles", "total", *_NEIGHBOURS)
        grown = grown.selectExpr("*", f"{_LOWER} as lower", f"{_UPPER} as upper", "(1000 * total) div prefixes[0] as bound")
        self.steps += 1
        grown.write.parquet(f"{self.path}/found/step={self.steps}")
        self.found = self.spark.read.schema(_FOUND).parquet(f"{self.path}/found")
        return self.spark.read.schema(_FOUND).parquet(f"{self.path}/found/step={self.steps}").where(F.size("words") < self.longest)

    def survivors(self) -> DataFrame:
        """Phrases that no longer one, with the same word before or after at every occurrence, takes the place of."""
        same = "before_low = before_high and before_low <> 0 or after_low = after_high and after_low <> 0"
        return self.found.where(f"size(words) = {self.longest} or not ({same})")

    def settle(self) -> None:
        """The score that the TOP-th survivor of each language has at least."""
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("lower")))
        ranked = self.survivors().select("lang", "lower", nth.alias("nth")).where(F.col("nth") <= self.top)
        for r in ranked.where(F.col("nth") == self.top).collect():  # a row for each language
            self.threshold[r.lang] = r.lower

    def above(self, phrases: DataFrame, score: str) -> DataFrame:
        return phrases.join(self._languages(list(self.threshold)).select("lang", "threshold"), "lang").where(F.col(score) >= F.col("threshold")).drop("threshold")

    def run(self) -> None:
        waiting: list[DataFrame] = []
        while True:
            nodes: list[tuple] = []
            while waiting and len(nodes) < self.nodes:
                some = self.above(waiting.pop(), "bound").select("lang", "words", "prefixes", "singles")
                nodes += [tuple(r) for r in some.collect()]  # about nodes / 2 rows
            if len(nodes) < self.nodes:
                nodes += self.open(self.nodes - len(nodes))
            if not nodes:
                return
            fresh = self.grow(nodes)
            shares = -(-fresh.count() // max(1, self.nodes // 2))
            waiting += [fresh.where(F.pmod(F.xxhash64("words"), F.lit(shares)) == i) for i in range(shares)]
            self.settle()

    def rests(self, wanted: DataFrame) -> DataFrame:
        """(lang, rest, r) of phrases: from what was found, else by counting them in the texts."""
        known = self.found.select("lang", F.col("words").alias("rest"), F.expr(_A).alias("r"))
        wanted.distinct().join(known, ["lang", "rest"], "left").write.parquet(f"{self.path}/rests")
        table = self.spark.read.parquet(f"{self.path}/rests")
        made, missing = table.where("r is not null"), table.where("r is null").select("lang", "rest")
        rounds = -(-missing.count() // max(1, self.nodes // 2))
        for i in range(rounds):
            rows = missing.where(F.pmod(F.xxhash64("rest"), F.lit(rounds)) == i).collect()  # about nodes / 2 rows
            if not rows:
                continue
            table = F.broadcast(self.spark.createDataFrame([(k, r.lang, r.rest) for k, r in enumerate(rows)], "node long, lang string, rest array<long>"))
            counts = bounded(self.texts).mapInArrow(_counted([r.rest for r in rows]), "node long, n long").groupBy("node").agg(F.sum("n").alias("r"))
            counts.join(table, "node").select("lang", "rest", "r").write.parquet(f"{self.path}/counted/{i}")
            made = made.unionByName(self.spark.read.parquet(f"{self.path}/counted/{i}"))
        return made

    def scored(self) -> DataFrame:
        """(lang, words, a, n, score, l, r) of the survivors that can be among the best, by their worst cut."""
        near = self.above(self.survivors(), "upper").selectExpr("lang", "words", f"{_A} as a", "total as n", "prefixes", "element_at(singles, -1) as last", f"explode({_CUTS}) as k")
        near = near.selectExpr("lang", "words", "a", "n", "k", "prefixes[k - 1] as l", "slice(words, k + 1, size(words)) as rest", "if(k = size(words) - 1, last, null) as single")
        known = self.rests(near.where("single is null").select("lang", "rest"))
        cuts = near.join(known, ["lang", "rest"], "left").withColumn("r", F.coalesce("single", "r")).drop("rest", "single")
        worst = F.min(F.expr(f"struct({_div('a', 'n', 'l', 'r')} as score, k, l, r)")).alias("w")
        return cuts.groupBy("lang", "words", "a", "n").agg(worst).select("lang", "words", "a", "n", "w.score", "w.l", "w.r")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, nodes: int = NODES) -> DataFrame:
    """Per language its top phrases: lang, rank, phrase, a, l, r, n, score.

    Null languages are "und", null and empty texts have no words; repeated rows count each time. Ties go by count, then
    by the phrase's bytes. Other columns are not read; an empty table gives no rows.
    """
    growth = _Growth(documents, least, longest, top, nodes)
    growth.run()
    final = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if growth.found is None:
        return growth.spark.createDataFrame([], final)
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = growth.scored().withColumn("place", F.rank().over(first)).where(F.col("place") <= top)  # ties included
    spelled = best.select("*", F.posexplode("words").alias("i", "h")).join(growth.words.select("lang", "h", "word"), ["lang", "h"])
    phrase = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("word").cast("string").alias("w")))), lambda x: x.w))
    named = spelled.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(phrase.alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")  # a language's best
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """The same by counting every phrase."""
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS m, unnest([w[i:i + {m - 1}] for i in range(1, len(w) - {m - 2})]) AS g FROM p WHERE len(w) >= {m}" for m in range(1, LONGEST + 1))
    return rf"""
    WITH p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({fold}, '[.,;:!?
-
]')) AS piece FROM documents)),
    t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
    f AS (SELECT lang, m, g, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
    k AS (SELECT f.lang, f.g, f.m, f.f AS a, n, k.k, l.f AS l, r.f AS r, (1000::HUGEINT * f.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM f JOIN t USING (lang) JOIN (SELECT unnest(range(1, {LONGEST})) AS k) k ON k.k < f.m JOIN f l ON l.lang = f.lang AND l.g = f.g[1:k.k] JOIN f r ON r.lang = f.lang AND r.g = f.g[k.k + 1:]),
    s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    x AS (SELECT DISTINCT o.lang, o.g[j.j:j.j + i.m - 1] AS g, o.f FROM f o, (SELECT unnest(range(2, {LONGEST})) AS m) i, (SELECT unnest(range(1, {LONGEST})) AS j) j WHERE i.m < o.m AND j.j + i.m - 1 <= o.m),
    d AS (SELECT lang, g, max(f) AS f FROM x GROUP BY ALL),
    o AS (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, s.l, s.r, s.n, s.score FROM s LEFT JOIN d ON d.lang = s.lang AND d.g = s.g WHERE d.f IS NULL OR 100 * d.f < 100 * s.a),
    z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
    SELECT * FROM z WHERE rank <= {TOP}"""
