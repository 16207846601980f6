"""Missing values: drop rows, or fill with mean, median, mode or zero."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, numeric_columns, require_columns
from tablewright.operators.heavy import proven_counts
from tablewright.operators.order_stats import SMALL_ROWS, medians

STRATEGIES = ("drop", "mean", "median", "mode", "zero")


@dataclass(frozen=True)
class FillPlan:
    """Fill value per column, to be applied to any table with these columns."""

    strategy: str
    values: dict[str, Any] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "drop":
            return df.na.drop("any")
        dtypes = dict(df.dtypes)
        filled = {}
        for c, value in self.values.items():
            target = "double" if self.strategy in ("mean", "median") else dtypes[c]
            filled[c] = F.coalesce(col(c).cast(target), F.lit(value).cast(target))
        return df.withColumns(filled) if filled else df


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Most frequent non-null value per column, the smallest among equals.

    Columns whose mode is proven from counters shuffle only the counts of candidates;
    the others are grouped in full, each on its own.
    """
    proven = proven_counts(df, columns, 1, nulls=False)
    counted = {
        c: proven[c]
        if c in proven
        else df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        for c in columns
    }
    parts = [
        counted[c]
        .orderBy(F.desc("n"), F.asc("v"))
        .limit(1)
        .select(F.lit(i).alias("i"), F.struct("v").alias(f"s{i}"))
        for i, c in enumerate(columns)
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    found = {r["i"]: r for r in merged.collect()}
    return {c: found[i][f"s{i}"]["v"] for i, c in enumerate(columns) if i in found}


def fit_fill(
    df: DataFrame,
    strategy: str = "drop",
    columns: Sequence[str] | None = None,
    small: int = SMALL_ROWS,
) -> FillPlan:
    """Find the fill values.  Mean, median and zero concern numeric columns, mode all."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such filling strategy: {strategy}")
    if strategy == "drop":
        return FillPlan("drop")
    if columns is not None:
        chosen = require_columns(df, columns)
    else:
        chosen = list(df.columns) if strategy == "mode" else numeric_columns(df)
    if not chosen:
        return FillPlan(strategy)
    if strategy == "zero":
        return FillPlan(strategy, {c: 0 for c in chosen})
    if strategy == "mean":
        row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(chosen)]).first()
        found = {c: row[f"m{i}"] for i, c in enumerate(chosen)}
    elif strategy == "median":
        found = medians(df, chosen, small)
    else:
        found = modes(df, chosen)
    values = {c: found[c] for c in chosen if found.get(c) is not None}
    return FillPlan(strategy, values, [c for c in chosen if c not in values])


def impute(
    df: DataFrame,
    strategy: str = "drop",
    columns: Sequence[str] | None = None,
    small: int = SMALL_ROWS,
) -> DataFrame:
    return fit_fill(df, strategy, columns, small).transform(df)
