"""Column selection and naming helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types that count as numeric; every other type is categorical.
NUMERIC_TYPES = ("int", "bigint", "float", "double")


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or other symbols."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Return ``names`` as a list; raise ``ValueError`` naming the first absent one."""
    names = list(names)
    present = set(df.columns)
    for name in names:
        if name not in present:
            raise ValueError(f"there is no column {name}")
    return names


def numeric_columns(df: DataFrame, types: Sequence[str] = NUMERIC_TYPES) -> list[str]:
    return [name for name, dtype in df.dtypes if dtype in types]


def categorical_columns(df: DataFrame, types: Sequence[str] = NUMERIC_TYPES) -> list[str]:
    return [name for name, dtype in df.dtypes if dtype not in types]


def require_numeric(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    """Chosen (or all) numeric columns; raise when there is none."""
    if names is not None:
        return require_columns(df, names)
    found = numeric_columns(df)
    if not found:
        raise ValueError("the table has no numeric column")
    return found


def as_rows(aggregated: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry of ``rows``."""
    structs = [F.struct(*[expr.alias(name) for name, expr in row.items()]) for row in rows]
    return aggregated.select(F.inline(F.array(*structs)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def one_row(frames: Sequence[DataFrame]) -> DataFrame:
    """Merge one-row frames with different columns into a single row."""
    names = [name for frame in frames for name in frame.columns]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.first(col(n), ignorenulls=True).alias(n) for n in names])
