"""Exact order statistics of many columns at once, without a global sort.

Three scans find the ranks of all columns, whatever the number of rows.  The first
builds a mergeable quantile sketch per column, whose quantiles bracket every rank.
The second counts exactly how many rows lie below, on and between the brackets, so
the sketches only steer the search and never decide the answer; a heavy value shows
up as a bracket that already holds the rank.  The third takes what lies inside the
brackets, well under one percent of the values: where few remain they are sorted in
one aggregate buffer, else they are written as a table of their own, which is
searched in the same way.  Sketches are merged per group of tasks before they meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns, require_numeric
from tablewright.session import materialise

SMALL_ROWS = 100_000
#: Values gathered by one job, over all intervals.
GATHERED_VALUES = 1_000_000
#: Size of the quantile sketches: about 50 KB each, ranks within some 0.14 % of the rows.
SKETCH_SIZE = 2048
#: Quantiles read from a sketch.
GRID = 1000
_MERGE_GROUPS = 256
_SKETCHES = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint"}
_SKETCHES |= {"float": "double", "double": "double"}


def nearest_rank(n: int, q: float) -> int:
    """Zero-based rank of the ``nearest`` quantile, halves rounding up."""
    return math.floor((n - 1) * q + 0.5)


@dataclass
class _Search:
    column: str
    rank: int
    low: Any = None  # open bounds, None = unbounded
    high: Any = None
    below: int = 0
    within: int = 0
    answer: Any = None
    done: bool = False

    @property
    def interval(self) -> tuple:
        return (self.column, self.low, self.high)

    def inside(self) -> Column:
        value = F.col(self.column)
        cond = value.isNotNull()
        if self.low is not None:
            cond = cond & (value > F.lit(self.low))
        if self.high is not None:
            cond = cond & (value < F.lit(self.high))
        return cond

    def settle(self, value: Any) -> None:
        self.answer, self.done = value, True


def _sample_size(rows: int, small: int) -> int:
    """Sample whose pivots should leave about half of ``small`` rows between them.

    The pivots lie four standard errors, ``2 / sqrt(sample)`` of the rows, to
    either side.  Past the upper limit another round is cheaper than a larger sample.
    """
    wanted = (8 * rows / small) ** 2
    return int(min(max(5_000, wanted), 500_000, max(small, 100)))


def _groups(searches: Sequence[_Search]) -> list[list[_Search]]:
    grouped: dict[tuple, list[_Search]] = {}
    for search in searches:
        grouped.setdefault(search.interval, []).append(search)
    return list(grouped.values())


def _finish(df: DataFrame, searches: Sequence[_Search]) -> None:
    """Sort the few remaining rows of every interval and pick the ranks."""
    blocks: list[list[list[_Search]]] = [[]]
    gathered = 0
    for group in _groups(searches):
        if blocks[-1] and gathered + group[0].within > GATHERED_VALUES:
            blocks.append([])
            gathered = 0
        blocks[-1].append(group)
        gathered += group[0].within
    for groups in blocks:
        aggregates = []
        for g, group in enumerate(groups):
            values = F.sort_array(F.collect_list(F.when(group[0].inside(), F.col(group[0].column))))
            picks = [F.element_at(values, s.rank - s.below + 1) for s in group]
            aggregates.append(F.array(*picks).alias(f"g{g}"))
        row = df.agg(*aggregates).first()
        for g, group in enumerate(groups):
            for search, value in zip(group, row[f"g{g}"]):
                search.settle(value)


def grid_quantiles(
    df: DataFrame, values: Sequence[tuple[Column, str]], sketch_size: int = SKETCH_SIZE
) -> list[tuple[int, list]]:
    """Per value and type: number of sketched values, and their approximate quantiles
    at the shares ``0, 1/GRID, ..., 1``; one scan.

    Nulls and NaN are not sketched.  Without any value the list is empty.
    """
    build = {"bigint": F.kll_sketch_agg_bigint, "double": F.kll_sketch_agg_double}
    merge = {"bigint": F.kll_merge_agg_bigint, "double": F.kll_merge_agg_double}
    read = {"bigint": F.kll_sketch_get_quantile_bigint, "double": F.kll_sketch_get_quantile_double}
    shares = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    size = F.lit(sketch_size)
    built, merged, found = [], [], []
    for i, (value, dtype) in enumerate(values):
        kind = _SKETCHES[dtype]
        value = value.cast(kind)
        if kind == "double":
            value = F.when(~F.isnan(value), value)
        sketch, number = F.col(f"s{i}"), F.col(f"n{i}")
        built += [build[kind](value, size).alias(f"s{i}"), F.count(value).alias(f"n{i}")]
        merged += [merge[kind](sketch, size).alias(f"s{i}"), F.sum(number).alias(f"n{i}")]
        # an empty sketch has no quantiles
        found += [F.when(number > 0, read[kind](sketch, shares)).alias(f"q{i}"), number]
    parts = df.withColumn("_p", F.spark_partition_id() % _MERGE_GROUPS).groupBy("_p").agg(*built)
    row = parts.agg(*merged).select(*found).first()
    return [(row[f"n{i}"] or 0, row[f"q{i}"] or []) for i in range(len(values))]


def _sketched_pivots(
    df: DataFrame, groups: Sequence[list[_Search]], types: Sequence[str], sketch_size: int
) -> list[list]:
    """Per interval, increasing values that bracket its ranks.

    NaN is the greatest value: the open stretch above the last pivot holds it.
    """
    inside = [F.when(group[0].inside(), F.col(group[0].column)) for group in groups]
    error = 1.5 * 2.296 / sketch_size**0.9723  # rank error of such sketches, with a margin
    pivots = []
    for group, (n, grid) in zip(groups, grid_quantiles(df, list(zip(inside, types)), sketch_size)):
        picked = set()
        for search in group if n else []:
            share = (search.rank - search.below + 0.5) / n
            for place in (math.floor((share - error) * GRID), math.ceil((share + error) * GRID)):
                picked.add(grid[min(max(place, 0), GRID)])
        pivots.append(sorted(picked))
    return pivots


def _sampled_pivots(
    df: DataFrame, groups: Sequence[list[_Search]], small: int, seed: int
) -> list[list]:
    """Per interval, increasing values from a random sample that bracket its ranks;
    for types that have no sketch."""
    shares, sizes = [], []
    for group in groups:
        sizes.append(_sample_size(group[0].within, small))
        shares.append(min(1.0, sizes[-1] / group[0].within))
    # rows that no interval draws are dropped before anything is gathered
    drawn = df.withColumn("_r", F.rand(seed)).where(F.col("_r") < F.lit(max(shares)))
    aggregates = []
    for g, group in enumerate(groups):
        first = group[0]
        keep = first.inside() & (F.col("_r") < F.lit(shares[g]))
        values = F.sort_array(F.collect_list(F.when(keep, F.col(first.column))))
        size = F.size(values)
        picks = []
        for search in group:
            f = (search.rank - search.below + 0.5) / search.within
            margin = 4 * math.sqrt(max(f * (1 - f), 1 / sizes[g]) / sizes[g]) + 2 / sizes[g]
            for edge in (f - margin, f + margin):
                index = F.least(F.greatest(F.floor(size * F.lit(edge)), F.lit(0)), size - 1)
                picks.append(F.get(values, index.cast("int")))
        aggregates.append(F.array_sort(F.array_distinct(F.array(*picks))).alias(f"g{g}"))
    row = drawn.agg(*aggregates).first()
    return [[v for v in row[f"g{g}"] if v is not None] for g in range(len(groups))]


def _narrow(
    df: DataFrame, searches: Sequence[_Search], small: int, sketch_size: int, seed: int
) -> None:
    """Shrink every interval to the stretch between pivots that holds its rank."""
    types = dict(df.dtypes)
    groups, rest = [], []
    for group in _groups(searches):
        (groups if types[group[0].column] in _SKETCHES else rest).append(group)
    pivots = []
    if groups:
        kinds = [types[group[0].column] for group in groups]
        pivots += _sketched_pivots(df, groups, kinds, sketch_size)
    if rest:
        pivots += _sampled_pivots(df, rest, small, seed)
    groups += rest
    for group, found in zip(groups, pivots):
        if not found and types[group[0].column] in ("float", "double"):
            for search in group:  # no value but NaN
                search.settle(math.nan)
    aggregates = []
    for g, group in enumerate(groups):
        value, inside = F.col(group[0].column), group[0].inside()
        for j, pivot in enumerate(pivots[g]):
            aggregates += [
                F.count(F.when(inside & (value < F.lit(pivot)), 1)).alias(f"lt{g}_{j}"),
                F.count(F.when(inside & (value <= F.lit(pivot)), 1)).alias(f"le{g}_{j}"),
            ]
    if not aggregates:
        return
    row = df.agg(*aggregates).first()
    for g, group in enumerate(groups):
        for search in group:
            if search.done:
                continue
            low, start, offset = search.low, 0, search.rank - search.below
            high, end = search.high, search.within
            for j, pivot in enumerate(pivots[g]):
                less, upto = row[f"lt{g}_{j}"], row[f"le{g}_{j}"]
                if less <= offset < upto:
                    search.settle(pivot)
                    break
                if upto <= offset:
                    low, start = pivot, upto
                else:
                    high, end = pivot, less
                    break
            search.low, search.high = low, high
            search.below, search.within = search.below + start, end - start


def _solve(
    df: DataFrame, searches: Sequence[_Search], small: int, sketch_size: int, seed: int = 1
) -> None:
    """Settle all searches with at most three scans of ``df``."""
    wide = [s for s in searches if s.within > small]
    if wide:
        _narrow(df, wide, small, sketch_size, seed)
    left = [s for s in searches if not s.done]
    if not left:
        return
    groups = _groups(left)
    if all(s.within <= small for s in left):
        gathered = sum(group[0].within for group in groups)
        if not wide or gathered <= GATHERED_VALUES:
            _finish(df, left)
            return
    # what lies inside the intervals becomes a table with one column for each of them
    inside = df.select(
        *[F.when(group[0].inside(), F.col(group[0].column)).alias(f"w{g}") for g, group in enumerate(groups)]
    )
    known = reduce(or_, [F.col(c).isNotNull() for c in inside.columns])
    stored = materialise(inside.where(known))
    inner = {}
    for g, group in enumerate(groups):
        for search in group:
            inner[id(search)] = _Search(f"w{g}", search.rank - search.below, within=search.within)
    _solve(stored, list(inner.values()), small, sketch_size, seed + 1)
    for search in left:
        search.settle(inner[id(search)].answer)


def kth_values(
    df: DataFrame,
    ranks: dict[str, Sequence[int]],
    counts: dict[str, int],
    small: int = SMALL_ROWS,
    sketch_size: int = SKETCH_SIZE,
) -> dict[tuple[str, int], Any]:
    """Value at each zero-based ``rank`` among the non-null values of each column.

    ``counts`` gives the exact non-null count per column.  Values are gathered in one
    task only where at most ``small`` of them remain.
    """
    names = list(ranks)
    searches: dict[tuple[str, int], _Search] = {}
    renamed = df.select(*[col(name).alias(f"v{i}") for i, name in enumerate(names)])
    for i, name in enumerate(names):
        for rank in ranks[name]:
            if not 0 <= rank < counts[name]:
                raise ValueError(f"rank {rank} outside column {name}")
            searches[name, rank] = _Search(f"v{i}", rank, within=counts[name])
    if searches:
        _solve(renamed, list(searches.values()), small, sketch_size)
    return {key: search.answer for key, search in searches.items()}


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(columns)}


def quantile_ranks(n: int, probs: Sequence[float], interpolation: str) -> list[int]:
    """Ranks whose values decide the quantiles of ``n`` values."""
    if interpolation == "nearest":
        return sorted({nearest_rank(n, q) for q in probs})
    return sorted({edge((n - 1) * q) for q in probs for edge in (math.floor, math.ceil)})


def quantile_of(n: int, q: float, interpolation: str, value_at: Callable[[int], Any]) -> Any:
    """Quantile of ``n`` values from those at its ranks."""
    if interpolation == "nearest":
        return value_at(nearest_rank(n, q))
    position = (n - 1) * q
    low, high = math.floor(position), math.ceil(position)
    a, b = value_at(low), value_at(high)
    return float(a) if low == high else a + (b - a) * (position - low)


def quantile_values(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    interpolation: str = "nearest",
    small: int = SMALL_ROWS,
    accuracy: int = 10_000,
    counts: dict[str, int] | None = None,
) -> dict[str, dict[float, Any]]:
    """Quantiles per column as driver values (a few numbers per column).

    ``nearest`` and ``linear`` are exact; ``approx`` is one pass with a sketch.
    A column without values yields ``None``.  Known non-null ``counts`` save a scan.
    """
    columns = require_columns(df, columns)
    if interpolation == "approx":
        row = df.agg(
            *[
                F.percentile_approx(col(c), list(probs), accuracy).alias(f"q{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        return {
            c: dict(zip(probs, row[f"q{i}"] or [None] * len(probs)))
            for i, c in enumerate(columns)
        }
    if interpolation not in ("nearest", "linear"):
        raise ValueError(f"Unknown interpolation: {interpolation}")
    counts = counts or non_null_counts(df, columns)
    ranks = {c: quantile_ranks(counts[c], probs, interpolation) for c in columns if counts[c]}
    found = kth_values(df, ranks, counts, small)
    return {
        c: {
            q: quantile_of(counts[c], q, interpolation, lambda rank, c=c: found[c, rank])
            if counts[c]
            else None
            for q in probs
        }
        for c in columns
    }


def quantiles(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    probs: Sequence[float] = (0.25, 0.75),
    interpolation: str = "nearest",
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Long table ``(column, q, value)``."""
    columns = require_numeric(df, columns)
    values = quantile_values(df, columns, probs, interpolation, small)
    rows = [
        (c, float(q), None if v is None else float(v))
        for c in columns
        for q, v in values[c].items()
    ]
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double")


def medians(
    df: DataFrame,
    columns: Sequence[str],
    small: int = SMALL_ROWS,
    counts: dict[str, int] | None = None,
) -> dict[str, Any]:
    values = quantile_values(df, columns, [0.5], "linear", small, counts=counts)
    return {c: v[0.5] for c, v in values.items()}
