"""Global order, running sums and exact order statistics, none of which puts all rows, or all of a value, in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, stored

#: Rows of one bracket that are ranked in one task, at most.
AT_ONCE = 1_000_000
#: Rows of a table of parts and groups that is broadcast, at most.
FEW = 100_000
#: Cells that the values of a column are counted in at once.
CELLS = 4096
#: monotonically_increasing_id() holds a row's place in its partition in so many bits.
_PLACE_BITS = 33


def bucket_of(value: Column, edges: list[float], first: int = 0) -> Column:
    """How many of the sorted edges are <= value, by halving; nested conditions take a few comparisons a row."""
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    return F.when(value < edges[middle], bucket_of(value, edges[:middle], first)).otherwise(bucket_of(value, edges[middle + 1 :], first + middle + 1))


def digitize(c: Column, cuts: list[float]) -> Column:
    """How many of the cuts are <= c."""
    return F.when(c.isNotNull(), bucket_of(c, sorted(cuts)))


def in_order(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df range-partitioned by all of order and sorted, with the part (_p) and the place in it (_i) of each row.

    Ranges are sampled over every column of order, ties included, so a value that most rows share is still dealt to
    many parts; their number is that of shuffle partitions. The rows are written once, so parts stay as they are: select
    the columns that are needed before.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", place))


def global_row_number(df: DataFrame, by: str | Sequence[str], ties: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """1, 2, ... in the order of by (nulls first) and then ties."""
    spread = in_order(df, [*([by] if isinstance(by, str) else by), *ties])
    counts = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each part
    return spread.join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_before") + 1).cast("long")).drop("_p", "_i", "_before")


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rn: place of a row within its group by, in the order given; n: rows of the group. A group may hold all rows.

    A row's place follows from its place in its part and from how many rows of its group lie in earlier parts: a table
    of (part, group), which is broadcast up to FEW rows and met by both keys beyond, so that no group is gathered.
    """
    spread = in_order(df, [*by, *order])
    counts = spread.groupBy("_p", *by).agg(F.min("_i").alias("_low"), F.count("*").alias("_c"))
    whole, up_to = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_p")
    before = F.sum("_c").over(up_to) - F.col("_c")
    groups = cut(counts.select(F.col("_p").alias("_gp"), *[F.col(c).alias(f"_{c}") for c in by], (before - F.col("_low")).alias("_shift"), F.sum("_c").over(whole).alias("n")))
    same = [F.col("_p") == F.col("_gp"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]
    joined = spread.join(F.broadcast(groups) if groups.count() <= FEW else groups, same)
    return joined.withColumn("rn", (F.col("_i") + F.col("_shift") + 1).cast("long")).drop("_p", "_i", "_gp", "_shift", *[f"_{c}" for c in by])


def running_sums(values: DataFrame, by: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """values with cum_<c>: the sum of c up to and with the row, and total_<c>: its sum over the group, within by.

    order is distinct within a group: rows are aggregated beforehand. Sums go within the parts of a range partitioning
    and then over the parts, a row for each part and group in it.
    """
    spread = in_order(values, [*by, order])
    totals = spread.groupBy("_p", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    whole, up_to = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_p")
    offsets = totals.select("_p", *by, *[(F.sum(f"_t_{c}").over(up_to) - F.col(f"_t_{c}")).alias(f"_b_{c}") for c in sums], *[F.sum(f"_t_{c}").over(whole).alias(f"total_{c}") for c in sums])
    within = Window.partitionBy("_p", *by).orderBy(order)
    joined = spread.join(F.broadcast(offsets), ["_p", *by])  # parts + groups rows at most
    return joined.select(*values.columns, *[(F.sum(c).over(within) + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in sums], *[f"total_{c}" for c in sums])


def higher_rank(n: int, level: float) -> int:
    """1-based rank of the smallest order statistic at or above position level * (n - 1)."""
    return -int(-round(level * (n - 1), 9) // 1) + 1 if n else 0


@dataclass(frozen=True)
class _Bracket:
    """A range of a column's values that holds wanted ranks: its least and greatest value, the values below it and within."""

    low: float
    high: float
    below: int
    inside: int


def _numbers(values: Sequence[float], kind: str) -> Column:
    """A literal array, however long, as one text that is read when the query is planned."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _magnitude(v: float) -> float:
    return math.copysign(min(math.log(abs(v)) + 750, 3000), v) if v else 0.0


def _cell(i: int, brackets: list[_Bracket], at_once: int, by_size: bool) -> tuple[Column, list[int]]:
    """The cell of v<i> in its bracket p<i>, and the bracket of each cell. Cells are in the order of the values.

    Brackets of more than at_once different values are cut into cells of equal width, others are one cell. by_size cuts
    by magnitude instead, as do ranges whose width is no number, so that far outliers do not decide all widths.
    """
    wide = [b.inside > at_once for b in brackets]
    many = max(2, CELLS // max(1, sum(wide)))
    n, low, width, logarithmic, of = [], [], [], [], []
    for j, b in enumerate(brackets):
        ends = _magnitude(b.low), _magnitude(b.high)
        logarithmic.append(int(not math.isfinite(b.high - b.low) or (by_size and ends[0] < ends[1])))
        start, end = ends if logarithmic[-1] else (b.low, b.high)
        n.append(many if wide[j] else 1)
        low.append(start)
        width.append((end - start) or 1.0)
        of += [j] * n[-1]
    place, v = F.col(f"p{i}"), F.col(f"v{i}")
    size = F.when(v == 0, 0.0).otherwise(F.signum(v) * F.least(F.log(F.abs(v)) + 750, F.lit(3000.0)))
    at = F.when(F.get(_numbers(logarithmic, "int"), place) == 1, size).otherwise(v) if any(logarithmic) else v
    cells = F.get(_numbers(n, "int"), place)
    nth = F.floor((at - F.get(_numbers(low, "double"), place)) / F.get(_numbers(width, "double"), place) * cells)
    first = F.get(_numbers([sum(n[:j]) for j in range(len(n))], "int"), place)
    return F.when(place.isNotNull(), (first + F.greatest(F.lit(0), F.least(nth, cells - 1))).cast("int")), of


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks: Callable[[str, int], list[int]], at_once: int = AT_ONCE) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column its number n of values that are neither null nor NaN, and the values of the ranks (from 1) asked for.

    The range of each column is cut into CELLS cells, whose counts tell in which one a rank lies; cells of more than
    at_once values are cut again. Counts are exact, so the result is; a pass counts all columns, and what is shuffled and
    reaches the driver is a row for each cell. Only values of cells with a rank are ordered.
    """
    names = list(columns)
    values = [F.when(~F.isnan(columns[c].cast("double")), columns[c].cast("double") + 0.0).alias(f"v{i}") for i, c in enumerate(names)]  # -0.0 is 0.0
    kept = df.select(*values).persist()
    ends = kept.agg(*[f(f"v{i}") for i in range(len(names)) for f in (F.count, F.min, F.max)]).first()
    result: dict[str, tuple[int, dict[int, float]]] = {c: (ends[3 * i], {}) for i, c in enumerate(names)}
    wanted = {i: sorted(set(ranks(c, ends[3 * i]))) if ends[3 * i] else [] for i, c in enumerate(names)}
    brackets = {i: [_Bracket(ends[3 * i + 1], ends[3 * i + 2], 0, ends[3 * i])] for i in wanted if wanted[i]}
    state = kept.select("*", *[F.when(F.col(f"v{i}").isNotNull(), 0).alias(f"p{i}") for i in brackets])
    rounds = 0
    while any(b.inside > at_once and b.low < b.high for found in brackets.values() for b in found):
        made = {i: _cell(i, found, at_once, rounds % 2 == 1) for i, found in brackets.items()}
        state = state.select(*[f"v{i}" for i in made], *[cell.alias(f"c{i}") for i, (cell, _) in made.items()])
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("c"), F.col(f"v{i}").alias("v")) for i in made])  # array_compact would not be compiled
        counted = state.select(F.explode(each).alias("x")).where("x.c is not null").groupBy("x.i", "x.c").agg(F.count("*").alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))
        cells = sorted(counted.collect(), key=lambda r: (r.i, r.c))  # at most CELLS and a few for each column
        places = []
        for i, (_, of) in made.items():
            old, rest, found, lookup = brackets[i], wanted[i], [], [-1] * len(of)
            below = {j: b.below for j, b in enumerate(old)}
            for r in (r for r in cells if r.i == i):
                j = of[r.c]
                held = [k for k in rest if below[j] < k <= below[j] + r.n]
                if held and r.low == r.high:
                    result[names[i]][1].update(dict.fromkeys(held, r.low))
                elif held:
                    lookup[r.c] = len(found)
                    found.append(_Bracket(r.low, r.high, below[j], r.n))
                below[j] += r.n
            brackets[i] = found
            place = F.get(_numbers(lookup, "int"), F.col(f"c{i}"))
            places.append(F.when(place >= 0, place).alias(f"p{i}"))
        state = state.select(*[f"v{i}" for i in made], *places)
        brackets = {i: found for i, found in brackets.items() if found}
        rounds += 1
    start, asked, each = 0, [], []
    for i, found in brackets.items():
        each.append(F.struct((F.col(f"p{i}") + start).alias("i"), F.col(f"v{i}").alias("v")))
        asked += [(start + j, i, r, r - b.below) for j, b in enumerate(found) for r in wanted[i] if b.below < r <= b.below + b.inside]
        start += len(found)
    if asked:
        met = state.select(F.explode(F.array(*each)).alias("x")).where("x.i is not null").groupBy("x.i", "x.v").agg(F.count("*").alias("m"))
        upto = met.withColumn("cum", F.sum("m").over(Window.partitionBy("i").orderBy("v")))  # at most at_once values of a bracket
        nth = df.sparkSession.createDataFrame(asked, "i int, column int, r long, nth long")
        for row in upto.join(F.broadcast(nth), "i").where("cum - m < nth and nth <= cum").select("column", "r", "v").collect():  # a row for each rank
            result[names[row.column]][1][row.r] = row.v
    kept.unpersist()
    return result


def exact_quantiles(df: DataFrame, columns: Sequence[str] | dict[str, Column], levels: Sequence[float], at_once: int = AT_ONCE) -> dict[str, list[float] | None]:
    """Interpolated quantiles of several columns at once; None for a column without values."""
    named = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}

    def places(n: int) -> list[tuple[int, float]]:
        return [(int(math.floor(p * (n - 1))), p * (n - 1) - math.floor(p * (n - 1))) for p in levels]

    found = order_statistics(df, named, lambda _, n: [x for i, part in places(n) for x in ([i + 1, i + 2] if part else [i + 1])], at_once)
    made: dict[str, list[float] | None] = {}
    for c, (n, values) in found.items():
        made[c] = [values[i + 1] + part * (values[i + 2] - values[i + 1]) if part else values[i + 1] for i, part in places(n)] if n else None
    return made
