"""Synthetic rows from a Gaussian copula over columns of any kind, and how good they are."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import null_if_nan, rounded
from ..functions.storage import stored
from . import drift

#: A column with more distinct values is not kept whole in each task; its values of more than this part of the rows are.
SMALL = 10_000
#: Draws and values of a column that meet in one group, about.
DRAWS = 50_000
#: Rows that a task numbers, about.
TASK = 1_000_000
#: So much more of the even scale a value is dealt to, in case two processors round an exponential differently.
SLACK = 1e-12
#: Terms of the series of a correlation.
TERMS = 9

_WHOLE = ("tinyint", "smallint", "int", "bigint")
_REAL = ("float", "double")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def _kind(dtype: str) -> str:
    for kind, types in (("whole", _WHOLE), ("real", _REAL), ("time", _TIMES), ("level", ("string", "boolean"))):
        if dtype in types:
            return kind
    if dtype.startswith("decimal"):
        return "real"
    if dtype.startswith(("varchar", "char")):
        return "level"
    raise ValueError(f"a column of type {dtype} has no order to synthesize it from")


def _number(c: Column, dtype: str) -> Column:
    """A number in the order of the column: days of dates, microseconds of times, null for strings. -0.0 is 0.0."""
    if dtype == "date":
        return F.unix_date(c).cast("double")
    if dtype in _TIMES:
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if dtype == "boolean":
        return c.cast("int").cast("double")
    return F.lit(None).cast("double") if _kind(dtype) == "level" else c.cast("double") + F.lit(0.0)


def _back(number: Column, text: Column, dtype: str) -> Column:
    if dtype == "date":
        return F.date_from_unix_date(F.round(number).cast("int"))
    if dtype in _TIMES:
        return F.timestamp_micros(F.round(number).cast("long")).cast(dtype)
    if dtype == "boolean":
        return number == 1
    if _kind(dtype) == "level":
        return text
    return (F.round(number) if _kind(dtype) == "whole" else number).cast(dtype)


#: Numerators and denominators of Wichura's AS 241 for the middle, the sides and the tails, highest powers first.
_AS241 = (
    (2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987, 13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665),
    (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597, 5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0),
    (0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684, 3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835),
    (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008, 0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0),
    (2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124, 0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103),
    (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133, 0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0),
)


def _quantile(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal distribution, as NormalDist has them; infinite at 0 and 1."""
    q = p - 0.5
    middle = np.abs(q) <= 0.425
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    made = np.copysign(np.inf, q)
    for which, x, (num, den), factor in (
        (middle, 0.180625 - q * q, _AS241[:2], q), (~middle & (r <= 5), r - 1.6, _AS241[2:4], np.sign(q)), (~middle & (r > 5) & (r < np.inf), r - 5, _AS241[4:], np.sign(q))
    ):
        made[which] = factor[which] * np.polyval(num, x[which]) / np.polyval(den, x[which])
    return made


def _mixed(x: np.ndarray) -> np.ndarray:
    """Steele, Lea and Flood's mixing of 64 bits (splitmix64), one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, name: str) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{name}".encode(), usedforsecurity=False).digest()[:8], "big")


def _normal(ids: np.ndarray, stream: int) -> np.ndarray:
    """Standard normal numbers that depend on id and stream alone."""
    bits = _mixed(_mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(stream))
    return _quantile(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)


def _even(z: np.ndarray) -> np.ndarray:
    """Rises from 0 to 1 and deals normal numbers about evenly."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-1.702 * z))


def _part(even: np.ndarray, parts: int) -> np.ndarray:
    return np.clip(np.floor(even * parts), 0, parts - 1).astype(np.int64)


def _moments(low: np.ndarray, high: np.ndarray, terms: int) -> list[np.ndarray]:
    """The integrals of the first Hermite polynomials, times the normal density, from low to high."""

    def ends(z: np.ndarray) -> list[np.ndarray]:
        z = np.where(np.isfinite(z), z, 0.0) if (far := ~np.isfinite(z)).any() else z
        density = np.where(far, 0.0, np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        found = [np.ones_like(z), z]
        while len(found) < terms:
            found.append(z * found[-1] - (len(found) - 1) * found[-2])
        return [h * density for h in found[:terms]]

    if len(low) and np.array_equal(low[1:], high[:-1]):  # each end is the next one's beginning
        return [h[:-1] - h[1:] for h in ends(np.append(low, high[-1]))]
    return [a - b for a, b in zip(ends(low), ends(high))]


def _bounds(before: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The intervals on the normal scale of values with so many rows before them and of them."""
    upto = before + m
    if len(m) and np.array_equal(before[1:], upto[:-1]):
        z = _quantile(np.append(before, upto[-1]) / n)
        return z[:-1], z[1:]
    return _quantile(before / n), _quantile(upto / n)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)  # null is NaN


def _nullable(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.float64(), mask=np.isnan(numbers))


def _drawn(values: pa.Array, m: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> pa.Array:
    """The value whose interval holds each x; between two numbers that were seen once, a number between them."""
    at = np.minimum(np.searchsorted(high, x, side="right"), len(high) - 1)
    if not pa.types.is_floating(values.type):
        return values.take(pa.array(at))
    following = np.minimum(at + 1, len(high) - 1)
    inside = (m[at] == 1) & (m[following] == 1) & (low[at] > -np.inf) & (high[at] < np.inf)
    numbers = _numbers(values)
    found, at, following = numbers[at], at[inside], following[inside]
    found[inside] += (x[inside] - low[at]) / (high[at] - low[at]) * (numbers[following] - numbers[at])
    return _nullable(found)


@dataclass(frozen=True)
class _Few:
    """All distinct values of a column in order, null first: rows of each, bounds of its share on the normal scale, mean there."""

    values: pa.Array
    m: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray

    @staticmethod
    def of(values: list, m: list[int], text: bool) -> _Few:
        m, upto = np.array(m, np.int64), np.cumsum(m)
        low, high = _bounds(upto - m, m, upto[-1])
        return _Few(pa.array(values, pa.string() if text else pa.float64()), m, low, high, _moments(low, high, 1)[0] / (m / upto[-1]))

    def series(self) -> np.ndarray:
        return np.array([np.sum(self.mean * c) for c in _moments(self.low, self.high, TERMS)])


@dataclass(frozen=True)
class _Ordered:
    """A column of many values. runs: (v, p, place, m, s0, ...), a row for each distinct value in each part p of its order.

    parts has a row for each part: p, the rows before it and in it, the rows before its first value and of it, the same of
    its last value, both over all parts, and whether its first value began in an earlier part.
    """

    runs: DataFrame
    parts: np.ndarray
    n_rows: int
    text: bool

    def whole(self) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For a batch of runs: the rows before each value, those of it, and whether the run is the first of its value."""
        parts = self.parts

        def found(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p, place, m = (batch.column(c).to_numpy() for c in ("p", "place", "m"))
            of = parts[np.searchsorted(parts[:, 0], p)]
            first, last = place == 0, place + m == of[:, 2]
            before = np.where(last, of[:, 5], np.where(first, of[:, 3], of[:, 1] + place))
            return before, np.where(last, of[:, 6], np.where(first, of[:, 4], m)), ~first | (of[:, 7] == 0)

        return found

    def summed(self, columns: int) -> np.ndarray:
        """How many values, the Hermite coefficients, and the sums over rows of the mean times each of the columns."""
        whole, n = self.whole(), self.n_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + TERMS + columns)
            for batch in batches:
                before, m, new = whole(batch)
                moments = _moments(*_bounds(before, m, n), TERMS)
                mean = moments[0] / (m / n)
                total[0] += new.sum()
                total[1 : 1 + TERMS] += [np.sum(mean * c * new) for c in moments]
                total[1 + TERMS :] += [np.sum(mean * batch.column(f"s{j}").to_numpy()) for j in range(columns)]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["total"])

        return np.sum(sorted(r.total for r in self.runs.mapInArrow(run, "total array<double>").collect()), axis=0)  # a row for each task

    def means(self) -> DataFrame:
        """(v, m, mean) of each distinct value."""
        whole, n = self.whole(), self.n_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before, m, new = whole(batch)
                mean = _moments(*_bounds(before, m, n), 1)[0] / (m / n)
                yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(m), pa.array(mean)], ["v", "m", "mean"]).filter(pa.array(new))

        return self.runs.mapInArrow(run, f"v {_type(self.text)}, m long, mean double")

    def dealt(self, parts: int) -> DataFrame:
        """(part, v, place, m): each value in all parts of the normal scale that its interval or that of the value before reaches."""
        whole, n = self.whole(), self.n_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before, m, new = whole(batch)
                batch, before, m = batch.filter(pa.array(new)), before[new], m[new]
                first = _part(_even(_quantile(np.maximum(before - 1, 0) / n)) - SLACK, parts)  # - 1: draws between two values seen once need both
                times = _part(_even(_quantile((before + m) / n)) + SLACK, parts) - first + 1
                at = np.repeat(np.arange(len(m)), times)
                part = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("v").take(pa.array(at)), pa.array(before[at]), pa.array(m[at])], ["part", "v", "place", "m"])

        return self.runs.mapInArrow(run, f"part long, v {_type(self.text)}, place long, m long")


def _type(text: bool) -> str:
    return "string" if text else "double"


@dataclass(frozen=True)
class Copula:
    """few and many have what is known of each column, by its number; root is the Cholesky root of the correlation of the
    normal numbers behind the values."""

    columns: tuple[tuple[str, str], ...]
    n_rows: int
    distinct: tuple[int, ...]
    few: dict[int, _Few]
    many: dict[int, _Ordered]
    root: np.ndarray
    spark: SparkSession

    def sample(self, n: int, seed: int = 7, key: str = "id") -> DataFrame:
        """n rows, numbered by key: hashes of the number, correlated, looked up in the distribution of each column.

        Values that repeat are drawn as they are; between two that were seen once, draws lie between them. Columns of few
        values take no shuffle; for others, draws meet the values of their part of the normal scale, some DRAWS of both.
        """
        if n < 0 or key in dict(self.columns):
            raise ValueError(f"n is below 0, or {key} is a column that was fitted")
        k, few, many = len(self.columns), self.few, list(self.many)
        parts = {c: max(n // DRAWS, self.distinct[c] // DRAWS, 1) for c in many}
        root, streams = self.root, [_stream(seed, f"copula{i}") for i in range(k)]
        types = {f"v{i}": _type(self._text(i)) for i in range(k)} | {f"x{i}": "double" for i in many} | {"id": "long", "part": "long"}

        def schema(names: list[str]) -> str:
            return ", ".join(f"{c} {types[c]}" for c in names)

        made = looked_up = ["id", *[f"v{i}" for i in few], *[f"x{i}" for i in many], *["part"][: len(many)]]

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                normal = [_normal(batch.column("id").to_numpy(), stream) for stream in streams]
                x = [sum((root[i, j] * normal[j] for j in range(1, i + 1)), root[i, 0] * normal[0]) for i in range(k)]
                found = [batch.column("id"), *[_drawn(f.values, f.m, f.low, f.high, x[i]) for i, f in few.items()], *[pa.array(x[i]) for i in many]]
                found += [pa.array(_part(_even(x[i]), parts[i])) for i in many[:1]]
                yield pa.RecordBatch.from_arrays(found, looked_up)

        tasks = max(self.spark.sparkContext.defaultParallelism, n // TASK)
        rows = self.spark.range(0, n, 1, tasks).mapInArrow(look_up, schema(made))
        for nth, c in enumerate(many):
            made = [x for x in made if x not in (f"x{c}", "part")] + [f"v{c}"] + ["part"][: len(many) - nth - 1]
            met = _meet(c, self.n_rows, many[nth + 1] if "part" in made else None, parts, made)
            rows = rows.groupBy("part").cogroup(self.many[c].dealt(parts[c]).groupBy("part")).applyInArrow(met, schema(made))
        return rows.select(F.col("id").alias(key), *[_back(F.col(f"v{i}"), F.col(f"v{i}"), t).alias(c) for i, (c, t) in enumerate(self.columns)])

    def _text(self, i: int) -> bool:
        return self.many[i].text if i in self.many else pa.types.is_string(self.few[i].values.type)


def _meet(c: int, n: int, following: int | None, parts: dict[int, int], made: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a part: column c's value of each draw; then the part of the following column."""

    def met(draws: pa.Table, values: pa.Table) -> pa.Table:
        found = {name: draws.column(name) for name in draws.column_names}
        x = found.pop(f"x{c}").to_numpy()
        values = values.take(pa.array(np.argsort(values.column("place").to_numpy())))
        before, m = values.column("place").to_numpy(), values.column("m").to_numpy()
        v = pa.concat_arrays(values.column("v").chunks)
        found[f"v{c}"] = _drawn(v, m, *_bounds(before, m, n), x) if len(x) else v.slice(0, 0)
        if following is not None:
            found["part"] = pa.array(_part(_even(found[f"x{following}"].to_numpy()), parts[following]))
        return pa.table([found[name] for name in made], names=made)

    return met


def fit_copula(df: DataFrame, columns: Sequence[str], min_rows: int = 50) -> Copula:
    """Distributions of the columns and the correlations of the normal numbers behind them.

    Numbers, times, booleans, strings (in their order) and nulls (first; NaN is null) all own an interval of the normal
    scale as wide as their share. The rows are written once. Columns of up to SMALL values are counted and kept whole; each
    other one takes a range partitioning of the rows by its values, in which those are counted in order, and sums beside
    each value what its covariances need. Refused are fewer than min_rows rows, no columns, and columns of other types.
    """
    types = dict(df.dtypes)
    if not columns or len(set(columns)) < len(columns) or set(columns) - set(types):
        raise ValueError(f"columns {list(columns)} are none, repeated or not in the frame")
    kinds = [types[c] for c in columns]
    texts = [_kind(t) == "level" and t != "boolean" for t in kinds]
    plain = null_if_nan(df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]))
    rows = stored(plain.select(*[(F.col(f"c{k}").cast("string") if texts[k] else _number(F.col(f"c{k}"), t)).alias(f"v{k}") for k, t in enumerate(kinds)]))
    n, *about = rows.agg(F.count("*"), *[F.approx_count_distinct(f"v{k}") for k in range(len(kinds))]).first()
    if n < min_rows:
        raise ValueError(f"a synthesizer needs {min_rows} rows, there are {n}")
    few = _few(rows, [k for k in range(len(kinds)) if about[k] <= 2 * SMALL], texts)
    large = [k for k in range(len(kinds)) if k not in few]
    series = np.zeros((len(kinds), TERMS))
    covariance, distinct = np.zeros((len(kinds), len(kinds))), {k: len(f.m) for k, f in few.items()}
    for k, f in few.items():
        series[k] = f.series()
    state, joined, many = rows, [], {}
    for k in large:
        many[k], together = _ordered(state, k, few, joined, n, texts[k], k == large[0])
        count, *found = many[k].summed(len(few) + len(joined))
        distinct[k], series[k] = int(count), found[:TERMS]
        covariance[k, [*few, *joined]] = covariance[[*few, *joined], k] = np.array(found[TERMS:]) / n
        if few and k == large[0]:
            covariance[np.ix_(list(few), list(few))] = together / n
        if k != large[-1]:
            state, joined = _joined(state, k, many[k].means(), n), [*joined, k]
    if few and not large:
        covariance[np.ix_(list(few), list(few))] = _together(rows, few) / n
    return Copula(tuple(zip(columns, kinds)), n, tuple(distinct[k] for k in range(len(kinds))), few, many, _root(covariance, series), df.sparkSession)


def _few(rows: DataFrame, candidates: list[int], texts: list[bool]) -> dict[int, _Few]:
    """Those of the columns that have SMALL values at most."""
    if not candidates:
        return {}
    each = [F.struct(F.lit(k).alias("k"), (F.lit(None) if texts[k] else F.col(f"v{k}")).cast("double").alias("number"), (F.col(f"v{k}") if texts[k] else F.lit(None)).cast("string").alias("text")) for k in candidates]
    cells = stored(rows.select(F.explode(F.array(*each)).alias("x")).groupBy("x.k", "x.number", "x.text").agg(F.count("*").alias("m")))
    counted = {r.k: r["count"] for r in cells.groupBy("k").count().collect()}  # a row for each column
    kept = [k for k in candidates if counted[k] <= SMALL]
    found: dict[int, list] = {k: [] for k in kept}
    for r in cells.where(F.col("k").isin(kept)).collect():  # SMALL rows for each column at most
        found[r.k].append((r.text if texts[r.k] else r.number, r.m))
    made = {}
    for k, cells_ in found.items():
        cells_.sort(key=lambda c: (c[0] is not None, c[0] if c[0] is not None else 0))
        made[k] = _Few.of([v for v, _ in cells_], [m for _, m in cells_], texts[k])
    return made


def _mean_of(f: _Few, column: pa.Array) -> np.ndarray:
    return f.mean[pc.index_in(column, value_set=f.values).to_numpy(zero_copy_only=False)]


def _means_of(few: dict[int, _Few], batch: pa.RecordBatch) -> np.ndarray:
    return np.array([_mean_of(f, batch.column(f"v{k}")) for k, f in few.items()]).reshape(len(few), batch.num_rows)


def _added(totals: list[list[float]], columns: int) -> np.ndarray:
    return np.sum(sorted(totals), axis=0).reshape(columns, columns)


def _together(rows: DataFrame, few: dict[int, _Few]) -> np.ndarray:
    """The sums over rows of the products of any two columns' means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(few), len(few)))
        for batch in batches:
            z = _means_of(few, batch)
            total += z @ z.T
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["total"])

    found = rows.select(*[f"v{k}" for k in few]).mapInArrow(run, "total array<double>").collect()  # a row for each task
    return _added([r.total for r in found], len(few))


def _ordered(state: DataFrame, k: int, few: dict[int, _Few], joined: list[int], n: int, text: bool, pairs: bool) -> tuple[_Ordered, np.ndarray | None]:
    """The distinct values of column k in order, with the sums of other columns' means beside each; if asked, _together().

    Rows are dealt by ranges of the value and a salt, so rows of one value may lie in many parts; each part has a run of
    them, and what the parts' first and last values have in all is told from a row for each part.
    """
    others = [*[f"v{j}" for j in few], *[f"z{j}" for j in joined]]
    salted = state.select(F.col(f"v{k}").alias("v"), *[c for c in others], F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("smallint").alias("_salt"))
    spread = salted.repartitionByRange("v", "_salt").sortWithinPartitions("v", "_salt").drop("_salt").withColumn("p", F.spark_partition_id())
    sums = len(few) + len(joined)
    schema = ", ".join([f"v {_type(text)}, p int, place long, m long", *[f"s{j} double" for j in range(sums)], "total array<double>"])
    made = stored(spread.mapInArrow(_counted(few, joined, pairs), schema))
    runs = made.where("m > 0").drop("total")
    least, most = (lambda c: F.min_by(c, "place")), (lambda c: F.max_by(c, "place"))
    ends = runs.groupBy("p").agg(F.sum("m").alias("n"), least("v").alias("v"), least("m").alias("m"), most("v").alias("last_v"), most("m").alias("last_m"), F.count("*").alias("runs"))
    found, before, last = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r.p):  # a row for each part
        goes_on = last is not None and last[0] == r.v
        first = last[1] if goes_on else [before, 0]  # rows before the value and of it; the latter grows by each part
        first[1] += r.m
        end = first if r.runs == 1 else [before + r.n - r.last_m, r.last_m]
        found.append((r.p, before, r.n, first, end, int(goes_on)))
        before, last = before + r.n, (r.last_v, end)
    parts = np.array([(p, b, size, *first, *end, goes_on) for p, b, size, first, end, goes_on in found], np.int64)
    together = _added([r.total for r in made.where("m = 0").select("total").collect()], len(few)) if pairs and few else None  # a row for each part
    return _Ordered(runs, parts, n, text), together


def _counted(few: dict[int, _Few], joined: list[int], pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of equal values in sorted rows: the rows of the part before them, how many they are, sums of the other columns' means.

    pairs: then a row with m = 0 and the sums of the products of any two of few.
    """
    columns = len(few) + len(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, p, total = None, 0, 0, np.zeros((len(few), len(few)))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _means_of(few, batch)
            if pairs:
                total += z @ z.T
            v, p = batch.column("v"), batch.column("p")[0].as_py()
            a, b = v.slice(1), v.slice(0, len(v) - 1)
            differ = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
            starts = np.append(0, np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1)
            values, m = v.take(pa.array(starts)), np.diff(np.append(starts, len(v)))
            sums = [np.add.reduceat(c, starts) for c in [*z, *[batch.column(f"z{j}").to_numpy() for j in joined]]]
            if held:
                if held[0][0].as_py() == values[0].as_py():
                    m[0] += held[1]
                    for s, more in zip(sums, held[2]):
                        s[0] += more
                else:
                    values, m = pa.concat_arrays([held[0], values]), np.append(held[1], m)
                    sums = [np.append(more, s) for s, more in zip(sums, held[2])]
            held = values.slice(len(values) - 1), m[-1], [s[-1] for s in sums]
            yield made(values.slice(0, len(values) - 1), p, place, m[:-1], [s[:-1] for s in sums])
            place += int(m[:-1].sum())
        if held:
            yield made(held[0], p, place, np.array([held[1]]), [np.array([s]) for s in held[2]])
            if pairs:
                yield made(held[0], p, -1, np.zeros(1), [np.zeros(1)] * columns, total.ravel().tolist())

    def made(values: pa.Array, p: int, place: int, m: np.ndarray, sums: list[np.ndarray], total: list[float] | None = None) -> pa.RecordBatch:
        m = m.astype(np.int64)
        found = [values, pa.array(np.full(len(m), p, np.int32)), pa.array(place + np.cumsum(m) - m), pa.array(m), *map(pa.array, sums), pa.array([total] * len(m), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(found, ["v", "p", "place", "m", *[f"s{j}" for j in range(columns)], "total"])

    return run


def _joined(state: DataFrame, k: int, means: DataFrame, n: int) -> DataFrame:
    """state with the mean z<k> of each value in place of v<k>.

    The at most SMALL values that more than n / SMALL rows have are broadcast; others are joined by value, where rows with a
    broadcast value are dealt out by their hash.
    """
    frequent = F.col("m") * SMALL > n
    known = means.where(frequent).select(F.col("v").alias("_known"), F.col("mean").alias("_z"))
    rest = means.where(~frequent).select(F.col("v").alias("_v"), F.lit(0).cast("long").alias("_nth"), F.col("mean").alias("_mean"))
    rows = state.join(F.broadcast(known), F.col(f"v{k}").eqNullSafe(F.col("_known")), "left")
    rows = rows.withColumn("_salt", F.when(F.col("_z").isNull(), 0).otherwise(F.xxhash64(*state.columns).bitwiseOR(F.lit(1))))
    rows = rows.join(rest, [F.col(f"v{k}").eqNullSafe(F.col("_v")), F.col("_salt") == F.col("_nth")], "left")
    return rows.select(*[c for c in state.columns if c != f"v{k}"], F.coalesce("_z", "_mean").alias(f"z{k}"))


def _root(covariance: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Cholesky root of the correlation of the normal numbers, of which only the values' means are seen.

    The covariance of two columns' means is a power series in that correlation, whose terms are each column's Hermite
    coefficients; the correlation is what gives the covariance found (for columns without repeats, the covariance).
    """
    tried = np.linspace(-1, 1, 4001)
    powers = np.array([tried**t / math.factorial(t) for t in range(1, TERMS + 1)])
    correlation = np.eye(len(series))
    for i, j in combinations(range(len(series)), 2):
        if min(series[i, 0], series[j, 0]) > 1e-9:  # a column of one value goes with nothing
            correlation[i, j] = correlation[j, i] = tried[np.argmin(np.abs((series[i] * series[j]) @ powers - covariance[i, j]))]
    size, axes = np.linalg.eigh(correlation)
    correlation = axes * np.maximum(size, 1e-6) @ axes.T  # pairs that were found one by one may not go together
    scale = np.sqrt(np.diag(correlation))
    return np.linalg.cholesky(correlation / np.outer(scale, scale))


def copula_synthesize(df: DataFrame, columns: Sequence[str], n: int, seed: int = 7, min_rows: int = 50) -> DataFrame:
    """n rows (id, columns) with the columns' distributions and dependence, see fit_copula."""
    return fit_copula(df, columns, min_rows).sample(n, seed)


BINS = 10


def _sides(real: DataFrame, synthetic: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Both frames below each other, columns that are numbers or times (as doubles) and levels (as text)."""
    if set(real.columns) != set(synthetic.columns):
        only = sorted(set(real.columns) - set(synthetic.columns)), sorted(set(synthetic.columns) - set(real.columns))
        raise ValueError(f"the frames differ in columns: only real {only[0]}, only synthetic {only[1]}")
    types = dict(real.dtypes)
    numbers = [c for c in real.columns if _kind(types[c]) != "level"]
    levels = [c for c in real.columns if _kind(types[c]) == "level"]
    made = []
    for side, df in (("reference", real), ("current", synthetic)):
        df = null_if_nan(df)
        plain = [_number(F.col(f"`{c}`").cast(types[c]), types[c]).alias(c) for c in numbers]
        made.append(df.select(F.lit(side).alias("_side"), *plain, *[F.col(f"`{c}`").cast("string").alias(c) for c in levels]))
    return made[0].unionByName(made[1]), numbers, levels


def column_shapes(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(feature, kind, score): one minus the KS statistic of numbers and times, or the total variation of levels. Nulls are left out."""
    both, numbers, levels = _sides(real, synthetic)
    return _shapes(both, numbers, levels)


def _shapes(both: DataFrame, numbers: list[str], levels: list[str]) -> DataFrame:
    made = []
    if numbers:
        made.append(drift.ks_statistic(both, "_side", numbers).select("feature", F.lit("number").alias("kind"), (1 - F.col("d")).alias("score")))
    if levels:
        counts = drift.level_counts(both, "_side", levels)
        made.append(drift.total_variation(counts).select("feature", F.lit("level").alias("kind"), (1 - F.col("tv")).alias("score")))
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def pair_trends(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(a, b, kind, score) of every pair of columns, in the frame's order of numbers and then levels.

    Two numbers: one minus half the difference of their correlations, null where a side has none. Other pairs: one minus
    the total variation of their joint counts, numbers cut into BINS of the real range, nulls a level of their own.
    """
    both, numbers, levels = _sides(real, synthetic)
    return _pairs(both, numbers, levels)


def _pairs(both: DataFrame, numbers: list[str], levels: list[str]) -> DataFrame:
    spark, real = both.sparkSession, F.col("_side") == "reference"
    result = spark.createDataFrame([], "a string, b string, kind string, score double")
    of = {side: F.col("_side") == side for side in ("reference", "current")}
    pairs = list(combinations(numbers, 2))
    if pairs:
        found = []
        for a, b in pairs:
            r, s = (_correlation(c, F.col(f"`{a}`"), F.col(f"`{b}`")) for c in of.values())
            found.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit("numbers").alias("kind"), (1 - F.abs(r - s) / 2).alias("score")))
        result = result.unionByName(both.agg(F.array(*found).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    pairs = [(a, b) for a, b in combinations([*numbers, *levels], 2) if b in levels]
    if not pairs:
        return result
    sizes = [F.count_if(c) for c in of.values()]
    ends = [f(F.when(real, F.col(f"`{c}`"))) for c in numbers for f in (F.min, F.max)]
    n_ref, n_cur, *ends = both.agg(*sizes, *ends).first()  # one row
    text = {c: F.col(f"`{c}`") for c in levels}
    for i, c in enumerate(numbers):
        text[c] = _bin(F.col(f"`{c}`"), ends[2 * i], ends[2 * i + 1]).cast("string")
    cells = [F.struct(F.lit(i).alias("pair"), text[a].alias("va"), text[b].alias("vb")) for i, (a, b) in enumerate(pairs)]
    counted = both.select("_side", F.explode(F.array(*cells)).alias("x")).groupBy("x.pair", "x.va", "x.vb").agg(*[F.count_if(c).alias(s) for s, c in of.items()])
    gap = F.abs(F.try_divide("reference", F.lit(n_ref)) - F.try_divide("current", F.lit(n_cur)))
    names = spark.createDataFrame([(i, a, b, "levels" if a in levels else "mixed") for i, (a, b) in enumerate(pairs)], "pair int, a string, b string, kind string")
    scored = counted.groupBy("pair").agg((1 - F.sum(gap) / 2).alias("score"))
    return result.unionByName(scored.join(F.broadcast(names), "pair").select("a", "b", "kind", "score"))


def _correlation(where: Column, a: Column, b: Column) -> Column:
    """Of the rows where both are known; null if one does not vary."""
    a, b = F.when(where & b.isNotNull(), a), F.when(where & a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _bin(c: Column, low: float | None, high: float | None) -> Column:
    """0 to BINS - 1 within the real range, -1 below it and BINS above; null stays null."""
    if low is None or low == high:
        return F.when(c.isNotNull(), 0 if low is None else F.signum(c - low).cast("int"))
    place = F.least(F.floor((c - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("int")
    return F.when(c < low, -1).when(c > high, BINS).when(c.isNotNull(), place)


def novelty(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n and novelty, the share of synthetic rows that no real row equals, nulls being equal; counted by distinct row."""
    counted = synthetic.groupBy(*columns).agg(F.count("*").alias("n"))
    known = real.distinct().select(*[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("known"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return counted.join(known, match, "left").agg(F.sum("n").alias("n"), rounded(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("novelty"))


def quality_report(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """shape_score, pair_score, their mean quality, novelty and a note on the two together, over all columns.

    Scores that cannot be measured (no rows, a single column) are null and left out of the mean.
    """
    both, numbers, levels = _sides(real, synthetic)
    shape = _shapes(both, numbers, levels).agg(F.avg("score").alias("shape"))
    pair = _pairs(both, numbers, levels).agg(F.avg("score").alias("pair"))
    columns = real.columns
    new = novelty(real, synthetic.select(*columns), columns).select("novelty")
    one = shape.crossJoin(pair).crossJoin(new)  # one row each
    one = one.withColumn("q", (F.coalesce("shape", "pair") + F.coalesce("pair", "shape")) / 2)
    note = F.when((F.col("novelty") < 0.9) & (F.col("q") > 0.85), "copying").when((F.col("novelty") >= 0.9) & (F.col("q") < 0.6), "inventing")
    return one.select(rounded("shape").alias("shape_score"), rounded("pair").alias("pair_score"), rounded("q").alias("quality"), "novelty", note.alias("note"))
