"""Outliers by the inter-quartile range."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    as_rows,
    col,
    numeric_columns,
    require_columns,
    require_numeric,
)
from tablewright.operators.order_stats import (
    SMALL_ROWS,
    grid_quantiles,
    kth_values,
    non_null_counts,
    quantile_of,
    quantile_ranks,
    quantile_values,
)
from tablewright.operators.profile import require_rows
from tablewright.session import materialise


def iqr_bounds(
    df: DataFrame,
    columns: Sequence[str],
    iqr_multiplier: float = 1.5,
    interpolation: str = "nearest",
    small: int = SMALL_ROWS,
    counts: dict[str, int] | None = None,
) -> dict[str, tuple[float, float] | None]:
    """Lower and upper bound per column; ``None`` where a column has no value."""
    quartiles = quantile_values(
        df, columns, [0.25, 0.75], interpolation, small, counts=counts
    )
    bounds: dict[str, tuple[float, float] | None] = {}
    for c, q in quartiles.items():
        low, high = q[0.25], q[0.75]
        if low is None:
            bounds[c] = None
            continue
        bounds[c] = _reach(low, high, iqr_multiplier)
    return bounds


def _reach(low, high, iqr_multiplier: float) -> tuple[float, float]:
    reach = iqr_multiplier * (high - low)
    return float(low - reach), float(high + reach)


def detect_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    iqr_multiplier: float = 1.5,
    interpolation: str = "nearest",
    small: int = SMALL_ROWS,
) -> DataFrame:
    """``(column, lower_bound, upper_bound, count, percentage)`` per numeric column.

    Nulls count neither as outliers nor as inliers, but do count as rows in the
    percentage.
    """
    columns = require_columns(df, columns) if columns else require_numeric(df)
    counts = non_null_counts(df, columns)
    if not any(counts.values()):
        require_rows(df)
    bounds = iqr_bounds(df, columns, iqr_multiplier, interpolation, small, counts)
    aggregates = [F.count(F.lit(1)).alias("n")]
    rows = []
    for i, c in enumerate(columns):
        low, high = bounds[c] or (None, None)
        if bounds[c] is None:
            outside = F.lit(None).cast("boolean")
        else:
            outside = (col(c) < F.lit(low)) | (col(c) > F.lit(high))
        aggregates.append(F.count(F.when(outside, 1)).alias(f"c{i}"))
        rows.append(
            {
                "column": F.lit(c),
                "lower_bound": F.lit(low).cast("double"),
                "upper_bound": F.lit(high).cast("double"),
                "count": F.col(f"c{i}"),
                "percentage": F.col(f"c{i}") / F.col("n") * 100,
            }
        )
    return as_rows(df.agg(*aggregates), rows)


def outlier_total(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_outliers"))


@dataclass
class OutlierPlan:
    """Bounds per column; ``transform`` keeps the rows inside all of them."""

    bounds: dict[str, tuple[float, float] | None]

    def transform(self, df: DataFrame) -> DataFrame:
        for c, bound in self.bounds.items():
            if bound is None:
                return df.where(F.lit(False))
            df = df.where(col(c).between(F.lit(bound[0]), F.lit(bound[1])))
        return df


def _binned(df: DataFrame, columns: Sequence[str], edges: Sequence[list[float]]) -> DataFrame:
    """Values ``v<i>`` and their bins ``b<i>``: bin ``j`` reaches from edge ``j`` up to, but
    not including, the next; NaN has a bin of its own at the end, null has none."""
    values = df.select(*[col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    doubled = values.withColumns({f"d{i}": F.col(f"v{i}").cast("double") for i in range(len(columns))})
    binned = Bucketizer(
        splitsArray=list(edges),
        inputCols=[f"d{i}" for i in range(len(columns))],
        outputCols=[f"b{i}" for i in range(len(columns))],
        handleInvalid="keep",
    ).transform(doubled)
    bins = [
        F.when(F.col(f"v{i}").isNotNull(), F.col(f"b{i}").cast("smallint")).alias(f"b{i}")
        for i in range(len(columns))
    ]
    return binned.select(*values.columns, *bins)


def _sequential_bounds(
    df: DataFrame, columns: Sequence[str], iqr_multiplier: float, interpolation: str, small: int
) -> dict[str, tuple[float, float] | None]:
    """Bounds of each column among the rows inside the bounds of those before it.

    Two scans of ``df`` for any number of columns: one for sketches of all columns, whose
    quantiles are the edges of bins, and one that stores values and bins.  A column
    then takes its counts per bin, and the exact values of the bins that hold its
    quartiles, from the rows left in the stored table, whose files skip what
    earlier bounds rule out.
    """
    types = dict(df.dtypes)
    grids = grid_quantiles(df, [(col(c), types[c]) for c in columns])
    edges = []
    for _, grid in grids:
        inner = sorted({float(v) for v in grid} - {math.inf, -math.inf})
        edges.append([-math.inf, *(inner or [0.0]), math.inf])
    left = materialise(_binned(df, columns, edges))
    bounds: dict[str, tuple[float, float] | None] = {}
    for i, c in enumerate(columns):
        value, place = f"v{i}", f"b{i}"
        per_bin = left.where(F.col(place).isNotNull()).groupBy(place).agg(F.count(F.lit(1)).alias("n"))
        counted = sorted((row[place], row["n"]) for row in per_bin.collect())
        n = sum(rows for _, rows in counted)
        if n == 0:
            bounds[c] = None
            return bounds
        wanted, ranks, counts, below = quantile_ranks(n, [0.25, 0.75], interpolation), {}, {}, 0
        start = {}
        for b, rows in counted:
            inside = [r - below for r in wanted if below <= r < below + rows]
            if inside:
                ranks[f"x{b}"], counts[f"x{b}"], start[f"x{b}"] = inside, rows, below
            below += rows
        holding = left.where(F.col(place).isin([int(x[1:]) for x in ranks]))
        split = holding.select(*[F.when(F.col(place) == int(x[1:]), F.col(value)).alias(x) for x in ranks])
        found = kth_values(split, ranks, counts, small)
        exact = {start[x] + r: v for (x, r), v in found.items()}
        low, high = (quantile_of(n, q, interpolation, exact.__getitem__) for q in (0.25, 0.75))
        bounds[c] = _reach(low, high, iqr_multiplier)
        left = left.where(F.col(value).between(*[F.lit(bound) for bound in bounds[c]]))
    return bounds


def fit_outliers(
    df: DataFrame,
    columns: Sequence[str],
    iqr_multiplier: float = 1.5,
    mode: str = "sequential",
    interpolation: str = "nearest",
    small: int = SMALL_ROWS,
) -> OutlierPlan:
    """Bounds of ``remove_outliers``, to be applied to any table.

    ``sequential`` with numeric columns reads ``df`` twice; other types search
    column after column.
    """
    columns = require_columns(df, columns)
    if mode not in ("sequential", "joint"):
        raise ValueError(f"Unknown mode: {mode}")
    if mode == "joint" or len(columns) == 1:
        return OutlierPlan(iqr_bounds(df, columns, iqr_multiplier, interpolation, small))
    if set(columns) <= set(numeric_columns(df)):
        distinct = list(dict.fromkeys(columns))
        if len(distinct) == len(columns):
            return OutlierPlan(
                _sequential_bounds(df, columns, iqr_multiplier, interpolation, small)
            )
    plan = OutlierPlan({})
    for c in columns:
        found = iqr_bounds(plan.transform(df), [c], iqr_multiplier, interpolation, small)
        known, new = plan.bounds.get(c), found[c]
        if known and new:  # a column named twice keeps the narrower of its bounds
            new = (max(known[0], new[0]), min(known[1], new[1]))
        plan.bounds[c] = new
    return plan


def remove_outliers(
    df: DataFrame,
    columns: Sequence[str],
    iqr_multiplier: float = 1.5,
    mode: str = "sequential",
    interpolation: str = "nearest",
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Keep rows inside the bounds of every column; nulls in these columns go.

    ``sequential`` takes the bounds of each column from the rows that survived
    the columns before it; ``joint`` takes all bounds from the input, which needs
    one search for all columns.
    """
    return fit_outliers(df, columns, iqr_multiplier, mode, interpolation, small).transform(df)
