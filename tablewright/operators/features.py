"""Feature construction: target means, products, parts of dates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.session import broadcast_if_small, materialise


@dataclass
class TargetEncoding:
    """Smoothed mean of the target per category, the overall mean for unseen ones."""

    column: str
    means: DataFrame
    overall: float

    @classmethod
    def fit(
        cls, df: DataFrame, column: str, target: str, smoothing: float = 0.0
    ) -> TargetEncoding:
        require_columns(df, [column, target])
        y = col(target).cast("double")
        overall = df.agg(F.avg(y)).first()[0]
        n = F.count(y)
        mean = (F.sum(y) + F.lit(smoothing) * F.lit(overall)) / (n + F.lit(smoothing))
        means = materialise(
            df.where(y.isNotNull()).groupBy(col(column).alias("_value")).agg(mean.alias("_mean"))
        )
        return cls(column, broadcast_if_small(means), overall)

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        require_columns(df, [self.column])
        order = df.columns
        joined = df.join(self.means, col(self.column).eqNullSafe(F.col("_value")), "left")
        name = output or self.column
        encoded = F.coalesce("_mean", F.lit(self.overall))
        kept = order if name in order else [*order, name]
        return joined.withColumn(name, encoded).select(*[col(c) for c in kept])


def polynomial(
    df: DataFrame, columns: Sequence[str], degree: int = 2, interactions_only: bool = False
) -> DataFrame:
    """Add products of up to ``degree`` columns, named ``a*b``; a narrow projection."""
    columns = require_columns(df, columns)
    added = {}
    for size in range(2, degree + 1):
        for group in combinations_with_replacement(columns, size):
            if interactions_only and len(set(group)) < size:
                continue
            product = col(group[0]).cast("double")
            for name in group[1:]:
                product = product * col(name).cast("double")
            added["*".join(group)] = product
    return df.withColumns(added) if added else df


def temporal(df: DataFrame, column: str) -> DataFrame:
    """Add year, quarter, month, day, day of week (Sunday = 1) and hour of a date column."""
    require_columns(df, [column])
    value = col(column)
    return df.withColumns(
        {
            f"{column}_year": F.year(value),
            f"{column}_quarter": F.quarter(value),
            f"{column}_month": F.month(value),
            f"{column}_day": F.dayofmonth(value),
            f"{column}_dayofweek": F.dayofweek(value),
            f"{column}_hour": F.hour(value),
        }
    )
