"""Categorical encoding: label codes with a reusable mapping, and one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns, union_all
from tablewright.operators.ranking import SMALL_ROWS, ordered_codes
from tablewright.session import BROADCAST_BYTES, materialise

_ENTRY_OVERHEAD = 64
_SCHEMA = "column string, value string, code bigint"


class LabelEncoding:
    """Mapping from the sorted distinct values of each column to codes 0..n-1.

    NULL, when present, sorts first and gets code 0.  The mapping is fitted once
    and applied to any number of tables, so train and test agree.  It is a table
    ``(column, value, code)`` with values as text and may be of any size: it is
    broadcast only when its measured bytes allow, and shuffled otherwise.
    """

    def __init__(self, mapping: DataFrame, sizes: dict[str, tuple[int, int]]):
        self.mapping = mapping
        self._sizes = sizes

    @classmethod
    def fit(
        cls, df: DataFrame, columns: Sequence[str], small: int = SMALL_ROWS
    ) -> LabelEncoding:
        columns = require_columns(df, columns)
        parts = []
        for c in columns:
            values = materialise(df.select(col(c).alias("v")).distinct())
            coded = ordered_codes(values, "v", values.count(), small)
            parts.append(
                coded.select(
                    F.lit(c).alias("column"), F.col("v").cast("string").alias("value"), "code"
                )
            )
        return cls._measured(materialise(union_all(parts)))

    @classmethod
    def _measured(cls, mapping: DataFrame) -> LabelEncoding:
        text = F.coalesce(F.octet_length("value"), F.lit(0)) + _ENTRY_OVERHEAD
        measured = mapping.groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.sum(text).alias("bytes")
        )
        return cls(mapping, {r["column"]: (r["n"], r["bytes"]) for r in measured.collect()})

    def size(self, column: str) -> int:
        return self._sizes[column][0]

    def _part(self, column: str) -> DataFrame:
        if column not in self._sizes:
            raise ValueError(f"Column {column} was not fitted")
        part = self.mapping.where(F.col("column") == column).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        if self._sizes[column][1] <= BROADCAST_BYTES:
            return F.broadcast(part)
        return part  # shuffle join; adaptive execution splits a hot value

    def transform(
        self, df: DataFrame, columns: Sequence[str] | None = None, unseen: str = "null"
    ) -> DataFrame:
        """Replace values by codes; ``unseen`` values become NULL, -1 or an error."""
        if unseen not in ("null", "error", "minus_one"):
            raise ValueError(f"Unknown unseen policy: {unseen}")
        order = df.columns
        for c in require_columns(df, columns or list(self._sizes)):
            text = _as_text(df, c)
            joined = df.join(self._part(c), text.eqNullSafe(F.col("_value")), "left")
            code = F.col("_code")
            if unseen == "minus_one":
                code = F.coalesce(code, F.lit(-1).cast("bigint"))
            elif unseen == "error":
                message = F.concat(
                    F.lit(f"unseen value in {c}: "), F.coalesce(text, F.lit("NULL"))
                )
                code = F.coalesce(code, F.raise_error(message).cast("bigint"))
            df = joined.withColumn(c, code).select(*[col(name) for name in order])
        return df

    def inverse(self, df: DataFrame, column: str, fitted: str | None = None) -> DataFrame:
        """Replace codes by the original text; codes outside the mapping stay, as text."""
        require_columns(df, [column])
        order = df.columns
        current = col(column)
        if dict(df.dtypes)[column] == "string":
            current = current.cast("double")
        part = self._part(fitted or column).withColumn("_hit", F.lit(True))
        coded = df.withColumn("_as_code", current.cast("bigint"))
        joined = coded.join(part, F.col("_as_code") == F.col("_code"), "left")
        text = F.when(F.col("_hit"), F.col("_value")).otherwise(F.col("_as_code").cast("string"))
        return joined.withColumn(column, text).select(*[col(name) for name in order])

    def save(self, path: str, fmt: str = "json") -> None:
        """One folder per column, as JSON lines or parquet."""
        self.mapping.write.mode("overwrite").partitionBy("column").format(fmt).save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, fmt: str = "json") -> LabelEncoding:
        mapping = spark.read.format(fmt).schema(_SCHEMA).load(path)
        return cls._measured(mapping.select("column", "value", "code"))


@dataclass(frozen=True)
class OneHot:
    """Categories per column, applied as 0/1 columns in place of the column."""

    categories: dict[str, list[Any]] = field(default_factory=dict)

    @classmethod
    def fit(
        cls, df: DataFrame, columns: Sequence[str], max_categories: int | None = None
    ) -> OneHot:
        """Distinct values per column, NULL included, in order of their column names.

        Every category becomes a column, whose name must be new; NULL is ``null``,
        or ``<null>`` where the text ``null`` is a category too.  For very many
        values use ``one_hot_vector``; ``max_categories`` makes more an error.
        """
        categories = {}
        for c in require_columns(df, columns):
            values = df.select(col(c).alias("v")).distinct()
            if max_categories is not None:
                values = values.limit(max_categories + 1)
            found = [r["v"] for r in values.collect()]  # each becomes a column of the plan
            if max_categories is not None and len(found) > max_categories:
                raise ValueError(f"{c} has over {max_categories} categories")
            categories[c] = sorted(found, key=_label)
        fitted = cls(categories)
        names = [c for c in df.columns if c not in categories]
        names += [name for c in categories for name in fitted.names(c)]
        clashes = sorted({n for n in names if names.count(n) > 1})
        if clashes:
            raise ValueError(f"categories give the same column name: {clashes}")
        return fitted

    def names(self, column: str) -> list[str]:
        """Names of the columns that stand for a column's categories."""
        labels = [_label(v) for v in self.categories[column]]
        if labels.count("null") > 1:
            labels = ["<null>" if v is None else _label(v) for v in self.categories[column]]
        return [f"{column}_{label}" for label in labels]

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.categories)
        output = []
        for name in df.columns:
            if name not in self.categories:
                output.append(col(name))
                continue
            for value, label in zip(self.categories[name], self.names(name)):
                hit = col(name).eqNullSafe(F.lit(value))
                output.append(F.when(hit, 1).otherwise(0).alias(label))
        return df.select(*output)


def _as_text(df: DataFrame, name: str) -> Column:
    """Text of a value; the two floating zeros are one value, as in grouping."""
    dtype = dict(df.dtypes)[name]
    value = col(name)
    if dtype in ("float", "double"):
        value = value + F.lit(0.0).cast(dtype)
    return value.cast("string")


def _label(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def one_hot(
    df: DataFrame, columns: Sequence[str], max_categories: int | None = None
) -> DataFrame:
    return OneHot.fit(df, columns, max_categories).transform(df)


def one_hot_vector(df: DataFrame, column: str, encoding: LabelEncoding | None = None) -> DataFrame:
    """Replace a column by a sparse 0/1 vector; suits columns with very many values."""
    encoding = encoding or LabelEncoding.fit(df, [column])
    width = encoding.size(column)
    coded = encoding.transform(df, [column], unseen="error")
    encoder = OneHotEncoder(inputCols=[column], outputCols=["_vector"], dropLast=False)
    bounds = df.sparkSession.createDataFrame([(float(width - 1),)], [column])
    encoded = encoder.fit(bounds).transform(coded.withColumn(column, col(column).cast("double")))
    return encoded.withColumn(column, F.col("_vector")).select(*[col(n) for n in df.columns])
