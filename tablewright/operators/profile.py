"""Table profile: shape, types, missing values, distributions, feature types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    NUMERIC_TYPES,
    as_rows,
    categorical_columns,
    col,
    numeric_columns,
    one_row,
    require_columns,
    union_all,
)
from tablewright.operators.heavy import proven_counts
from tablewright.operators.order_stats import SMALL_ROWS, medians

# Bytes taken by one value of each fixed-width type.
_WIDTHS = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "bigint": 8,
    "float": 4,
    "double": 8,
    "date": 4,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


_DISTRIBUTION = (
    "column string, dtype string, count bigint, null_count bigint, mean double, std double, "
    "min double, max double, median double"
)


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("the table has no rows")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct values per column, null counted as a value.

    One branch per column: each reads only that column and shuffles only its
    distinct values, so rows are never expanded into one copy per column.
    """
    return union_all(
        [
            df.select(col(c).alias("v"))
            .distinct()
            .agg(F.count(F.lit(1)).alias("unique"))
            .select(F.lit(c).alias("column"), "unique")
            for c in columns
        ]
    )


def table_info(df: DataFrame) -> DataFrame:
    """One row: row and column counts, and the size of the values in MB.

    Size counts fixed-width values at their width and text at its UTF-8 length.
    """
    sizes = []
    for name, dtype in df.dtypes:
        if dtype in ("string", "binary"):
            sizes.append(F.coalesce(F.sum(F.octet_length(col(name))), F.lit(0)))
        elif dtype in _WIDTHS:
            sizes.append(F.count(col(name)) * _WIDTHS[dtype])
        elif dtype.startswith("array"):
            inner = dtype[len("array<") : -1]
            sizes.append(
                F.coalesce(F.sum(F.size(col(name))), F.lit(0)) * _WIDTHS.get(inner, 8)
            )
        else:
            sizes.append(F.count(col(name)) * 8)
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        (total / F.lit(1024.0 * 1024.0)).alias("memory_mb"),
    )


def column_types(df: DataFrame) -> DataFrame:
    """``(position, column, dtype)`` of the schema."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def table_metadata(df: DataFrame) -> DataFrame:
    """One row holding the whole metadata record, nested."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    missing = [F.col("n") - F.col(f"c{i}") for i in range(len(df.columns))]
    names = F.array(*[F.lit(c) for c in df.columns])
    info = counts.select(
        F.array(F.col("n"), F.lit(len(df.columns)).cast("bigint")).alias("shape"),
        names.alias("columns"),
        F.map_from_arrays(names, F.array(*[F.lit(t) for _, t in df.dtypes])).alias("dtypes"),
        F.map_from_arrays(names, F.array(*missing)).alias("missing_counts"),
    )
    return one_row([info, table_info(df).select("memory_mb")])


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, missing, total)`` for every column, one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    return as_rows(
        counts,
        [
            {
                "column": F.lit(c),
                "missing": F.col("n") - F.col(f"c{i}"),
                "total": F.col("n"),
            }
            for i, c in enumerate(df.columns)
        ],
    )


def numeric_distributions(
    df: DataFrame, columns: Sequence[str] | None = None, small: int = SMALL_ROWS
) -> DataFrame:
    """One row per numeric column: counts, mean, sample std, range, median, distinct values."""
    columns = require_columns(df, columns) if columns else numeric_columns(df)
    if not columns:
        raise ValueError("No numerical columns found")
    dtypes = dict(df.dtypes)
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        value = col(c)
        aggregates += [
            F.count(value).alias(f"count{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_samp(value.cast("double")).alias(f"std{i}"),
            F.min(value).cast("double").alias(f"min{i}"),
            F.max(value).cast("double").alias(f"max{i}"),
        ]
    row = df.agg(*aggregates).first()
    if row["n"] == 0:
        raise ValueError("the table has no rows")
    counts = {c: row[f"count{i}"] for i, c in enumerate(columns)}
    middle = medians(df, columns, small, counts)
    stats = [
        (
            c,
            dtypes[c],
            counts[c],
            row["n"] - counts[c],
            *[row[f"{name}{i}"] for name in ("mean", "std", "min", "max")],
            None if middle[c] is None else float(middle[c]),
        )
        for i, c in enumerate(columns)
    ]
    frame = df.sparkSession.createDataFrame(stats, _DISTRIBUTION)
    return frame.join(distinct_counts(df, columns), "column")


def categorical_distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per non-numeric column: counts and distinct values."""
    columns = require_columns(df, columns) if columns else categorical_columns(df)
    if not columns:
        raise ValueError("No categorical columns found")
    require_rows(df)
    dtypes = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    stats = as_rows(
        counts,
        [
            {
                "column": F.lit(c),
                "dtype": F.lit(dtypes[c]),
                "count": F.col(f"c{i}"),
                "null_count": F.col("n") - F.col(f"c{i}"),
            }
            for i, c in enumerate(columns)
        ],
    )
    return stats.join(distinct_counts(df, columns), "column")


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column, null being a value.

    Ties go to the smaller value.  Columns whose most frequent values are proven from
    counters shuffle only the counts of candidates; the others are counted in full, each
    on its own.  Both are cut by a bounded top-k, not a sort.
    """
    columns = require_columns(df, columns) if columns else categorical_columns(df)
    if not columns:
        raise ValueError("No categorical columns found")
    proven = proven_counts(df, columns, k)
    parts = []
    for c in columns:
        if c in proven:
            counted = proven[c].withColumnRenamed("n", "count")
        else:
            counted = df.groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("count"))
        best = counted.orderBy(F.desc("count"), F.asc_nulls_first("v")).limit(k)
        parts.append(best.select(F.lit(c).alias("column"), F.col("v").cast("string").alias("value"), "count"))
    return union_all(parts)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return df.select(col(column)).distinct()


def feature_types(
    df: DataFrame,
    categorical_threshold: int = 20,
    types: Sequence[str] = NUMERIC_TYPES,
) -> DataFrame:
    """``(column, feature_type)``: binary, categorical or numerical.

    Decided by the exact number of distinct values, NULL and NaN each counting
    as one; columns that are not numeric are categorical.
    """
    if categorical_threshold <= 0:
        raise ValueError(f"categorical_threshold must be positive, not {categorical_threshold}")
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if kinds[c] in types]
    other = [(c, "categorical") for c in df.columns if c not in numeric]
    frames = []
    if other:
        frames.append(df.sparkSession.createDataFrame(other, "column string, feature_type string"))
    if numeric:
        unique = F.col("unique")
        kind = F.when(unique == 2, "binary").when(unique <= categorical_threshold, "categorical")
        frames.append(
            distinct_counts(df, numeric).select(
                "column", kind.otherwise("numerical").alias("feature_type")
            )
        )
    return union_all(frames)
