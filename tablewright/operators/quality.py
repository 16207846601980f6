"""Data quality: missing values, constant columns, duplicate rows, step reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tablewright.functions.columns import as_rows, col, one_row
from tablewright.operators.profile import missing_counts, require_rows
from tablewright.session import broadcast_if_small, materialise


def quality_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
    )


def _missing(counts: DataFrame) -> DataFrame:
    return counts.where("missing > 0").select(
        "column",
        F.col("missing").alias("count"),
        (F.col("missing") / F.col("total") * 100).alias("percentage"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with at least one null: count and percentage of all rows."""
    return _missing(missing_counts(df))


def column_facts(df: DataFrame) -> DataFrame:
    """``(column, missing, total, constant)`` for every column, one scan.

    A column is constant when it holds a single value: all null counts, one value
    plus nulls does not.  The extremes and the null count tell, so no values are
    shuffled.
    """
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggregates += [
            F.count(col(c)).alias(f"c{i}"),
            F.min(col(c)).eqNullSafe(F.max(col(c))).alias(f"same{i}"),
        ]
    return as_rows(
        df.agg(*aggregates),
        [
            {
                "column": F.lit(c),
                "missing": F.col("n") - F.col(f"c{i}"),
                "total": F.col("n"),
                "constant": (F.col("n") > 0)
                & F.col(f"same{i}")
                & ((F.col(f"c{i}") == 0) | (F.col(f"c{i}") == F.col("n"))),
            }
            for i, c in enumerate(df.columns)
        ],
    )


def constant_columns(df: DataFrame) -> DataFrame:
    return column_facts(df).where("constant").select("column")


def _comparable(df: DataFrame) -> DataFrame:
    """``df`` with maps as sorted entries, which can be hashed and grouped."""
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, MapType)}
    return df.select(
        *[
            F.array_sort(F.map_entries(col(c))).alias(c) if c in maps else col(c)
            for c in df.columns
        ]
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: number of rows beyond the first copy of each distinct row.

    Rows are first grouped by a 64-bit hash, so eight bytes per row are shuffled
    in place of the row.  Only rows whose hash occurs twice can be copies; these
    alone are compared in full, which keeps the count exact under collisions.
    Copies collapse before each shuffle, so a row repeated very often is cheap.
    """
    df = _comparable(df)
    keys = [col(c) for c in df.columns]
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    repeated = materialise(
        hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    )
    suspects = hashed.join(broadcast_if_small(repeated), "_hash", "left_semi")
    copies = suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame) -> DataFrame:
    """One row with the totals and the number of issues found."""
    require_rows(df)
    facts = column_facts(df).agg(
        F.max("total").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.count(F.when(F.col("missing") > 0, 1)).alias("missing_columns"),
        F.count(F.when(F.col("constant"), 1)).alias("constant_columns"),
    )
    return one_row([facts, duplicate_rows(df)]).withColumn(
        "issues",
        F.col("missing_columns")
        + F.col("constant_columns")
        + F.when(F.col("duplicate_rows") > 0, 1).otherwise(0),
    )


def step_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(rows_before, rows_after, rows_removed)`` of a cleaning step.

    Counts two given tables; ``StepLog`` counts while the result itself is made.
    """
    counted = one_row(
        [
            before.agg(F.count(F.lit(1)).alias("rows_before")),
            after.agg(F.count(F.lit(1)).alias("rows_after")),
        ]
    )
    return counted.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


class StepLog:
    """Row counts along a chain of cleaning steps, without a scan of their own.

    ``watch`` places a counter behind a step; the action that makes the result (a
    write, say) fills all counters of the chain at once, and ``report`` reads them.
    A counter stays in place whatever columns a caller selects.  ``report`` waits for
    that action, so it comes after it.  An action that stops early, as ``limit`` does,
    counts what it read; a result that is made twice is counted at the first time.
    """

    def __init__(self) -> None:
        self.steps: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, step: str) -> DataFrame:
        watched, watch = observed(df, f"{len(self.steps)}-{uuid.uuid4().hex}")
        self.steps.append((step, watch))
        return watched

    def counts(self) -> list[tuple[str, int]]:
        """``(step, rows)`` in order; an empty table counts zero."""
        return [(step, watch.get.get("rows") or 0) for step, watch in self.steps]

    def report(self, spark: SparkSession) -> DataFrame:
        """``(position, step, rows_before, rows_after, rows_removed)`` per step after the first."""
        counted = self.counts()
        rows = [
            (i, step, before, after, before - after)
            for i, ((_, before), (step, after)) in enumerate(zip(counted, counted[1:]), 1)
        ]
        return spark.createDataFrame(
            rows,
            "position int, step string, rows_before bigint, rows_after bigint, rows_removed bigint",
        )


def clean(
    df: DataFrame,
    steps: Sequence[tuple[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]]],
) -> tuple[DataFrame, DataFrame]:
    """Result of cleaning ``steps`` applied in order, and the report of their row counts.

    A step is a name and a function that looks at its input and returns what to do,
    such as ``lambda df: fit_fill(df, "mean").transform``.  The looks run on the plain
    chain; the result is written once to the shared folder, and that one write fills
    all counters.
    """
    log = StepLog()
    plain, watched = df, log.watch(df, "input")
    for name, fit in steps:
        apply = fit(plain)
        plain, watched = apply(plain), log.watch(apply(watched), name)
    return materialise(watched), log.report(df.sparkSession)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows while another action runs: ``observation.get["rows"]``."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
