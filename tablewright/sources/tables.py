"""Reading and writing tables."""

from __future__ import annotations

import os
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tablewright.functions.columns import col, require_columns
from tablewright.session import scratch_path

FORMATS = ("csv", "parquet", "json", "orc")

#: Text comes back as it was written: quotes are doubled inside quoted fields, which
#: may hold line breaks; white space stays; empty text is quoted and NULL is nothing.
_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "nullValue": "",
    "emptyValue": '""',
}
#: The reader puts the mark where a field is empty without quotes, and takes it for NULL.
_CSV_READ = {**_CSV, "multiLine": True, "emptyValue": "", "nullValue": "\u0001null\u0001"}


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    for known in FORMATS:
        if path.rstrip("/").endswith("." + known):
            return known
    return "parquet"


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read a table; the format follows the file name unless given.

    CSV has a header and inferred types, which costs one extra pass over the
    text: give a schema, or keep parquet as the working format.  A value that does
    not fit the given schema is an error.
    """
    path = os.path.expanduser(path)
    fmt = _format_of(path, fmt)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(**_CSV_READ)
        if schema is None:
            reader = reader.option("inferSchema", True)
        else:
            reader = reader.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"No table at {path}") from error
        raise


def read_csv(spark: SparkSession, path: str, infer_rows: int = 1_000) -> DataFrame:
    """Read CSV with the types of its first ``infer_rows`` rows.

    The whole table is read with these types; a later value that does not fit is
    an error, not a silent NULL.
    """
    if infer_rows <= 0:
        raise ValueError(f"infer_rows must be positive, not {infer_rows}")
    path = os.path.expanduser(path)
    try:
        records = spark.read.options(**_CSV_READ).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"No table at {path}") from error
        raise
    head = records.limit(infer_rows)  # whole records, quoted line breaks included
    sample = scratch_path(spark, "csv-head")
    head.coalesce(1).write.options(**_CSV).csv(sample)
    inferred = spark.read.options(**_CSV_READ).option("inferSchema", True).csv(sample).schema
    return spark.read.options(**_CSV_READ).option("mode", "FAILFAST").schema(inferred).csv(path)


def preview(df: DataFrame, n_rows: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``n_rows`` rows; with ``order_by`` the choice is repeatable."""
    if n_rows <= 0:
        raise ValueError(f"n_rows must be positive, not {n_rows}")
    if order_by:
        df = df.orderBy(*[col(c) for c in require_columns(df, order_by)])
    return df.limit(n_rows)


def as_dataframe(spark: SparkSession, data: Any) -> DataFrame:
    """A Spark frame from a Spark frame, a pandas frame or a path."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    return read_table(spark, os.fspath(data))


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> str:
    fmt = _format_of(path, fmt)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.options(**_CSV)
    if partition_by:
        writer = writer.partitionBy(*require_columns(df, partition_by))
    writer.save(path)
    return path


def write_split(train: DataFrame, test: DataFrame, target: str, path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write train, test without the target, and validation (test with the target)."""
    require_columns(train, [target])
    parts = {"train": train, "test": test.drop(target), "validation": test}
    return {name: write_table(part, f"{path}/{name}", fmt) for name, part in parts.items()}
