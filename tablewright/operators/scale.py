"""Feature scaling with statistics fitted once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.operators.order_stats import SMALL_ROWS, quantile_values

METHODS = ("standard", "minmax", "robust")


@dataclass(frozen=True)
class ScalePlan:
    """``(x - shift) / width`` per column; constant columns are listed as skipped."""

    method: str
    parameters: dict[str, tuple[float, float]] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {
            c: (col(c) - F.lit(shift)) / F.lit(width)
            for c, (shift, width) in self.parameters.items()
        }
        return df.withColumns(scaled) if scaled else df


def fit_scale(
    df: DataFrame, columns: Sequence[str], method: str = "standard", small: int = SMALL_ROWS
) -> ScalePlan:
    if method not in METHODS:
        raise ValueError(f"no such scaling method: {method}")
    columns = require_columns(df, columns)
    pairs: dict[str, tuple] = {}
    if method == "robust":
        linear = quantile_values(df, columns, [0.25, 0.5, 0.75], "linear", small)
        for c in columns:
            q = linear[c]
            pairs[c] = (q[0.5], None if q[0.5] is None else q[0.75] - q[0.25])
    else:
        aggregates = []
        for i, c in enumerate(columns):
            value = col(c).cast("double")
            if method == "standard":
                aggregates += [F.avg(value).alias(f"a{i}"), F.stddev_samp(value).alias(f"b{i}")]
            else:
                aggregates += [
                    F.min(value).alias(f"a{i}"),
                    (F.max(value) - F.min(value)).alias(f"b{i}"),
                ]
        row = df.agg(*aggregates).first()
        pairs = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}
    parameters = {c: p for c, p in pairs.items() if p[0] is not None and p[1]}
    return ScalePlan(method, parameters, [c for c in columns if c not in parameters])


def scale(
    df: DataFrame, columns: Sequence[str], method: str = "standard", small: int = SMALL_ROWS
) -> DataFrame:
    return fit_scale(df, columns, method, small).transform(df)
