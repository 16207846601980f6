"""Pearson correlation of numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns, require_numeric
from tablewright.session import materialise

_MOMENTS = "i int, j int, n double, mi double, mj double, sii double, sjj double, sij double"
_ROWS = 4_096


def correlations(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """Long matrix ``(col1, col2, corr)`` over rows where both values exist.

    The diagonal is 1; a pair with a constant column is NULL; a pair with a NaN
    is NaN.  One method serves any number of columns: tasks keep the means and
    the centred moments of every pair over its own rows and merge them block by
    block, so neither size nor distance of the values costs accuracy.
    """
    if method != "pearson":
        raise ValueError(f"Unsupported correlation method: {method}")
    columns = require_columns(df, columns) if columns else require_numeric(df)
    spark = df.sparkSession
    diagonal = spark.createDataFrame(
        [(c, c, 1.0) for c in columns], "col1 string, col2 string, corr double"
    )
    if len(columns) == 1:
        return diagonal
    parts = materialise(_partial_moments(df, columns))
    weight = F.col("n") / F.col("total")
    totals = parts.groupBy("i", "j").agg(F.sum("n").alias("total"))
    means = (
        parts.join(totals, ["i", "j"])
        .groupBy("i", "j")
        .agg(*[F.sum(F.col(m) * weight).alias(f"all_{m}") for m in ("mi", "mj")])
    )
    di, dj = F.col("mi") - F.col("all_mi"), F.col("mj") - F.col("all_mj")
    n = F.col("n")
    merged = (
        parts.join(means, ["i", "j"])
        .groupBy("i", "j")
        .agg(
            F.sum("n").alias("n"),
            F.max("all_mi").alias("mi"),
            F.max("all_mj").alias("mj"),
            F.sum(F.col("sii") + n * di * di).alias("sii"),
            F.sum(F.col("sjj") + n * dj * dj).alias("sjj"),
            F.sum(F.col("sij") + n * di * dj).alias("sij"),
        )
    )
    # a constant column keeps the rounding of its mean, a few units in the last place
    floor = lambda m: n * F.col(m) * F.col(m) * 1e-30
    spread = (F.col("sii") > floor("mi")) & (F.col("sjj") > floor("mj"))
    corr = F.when(F.isnan("sij"), F.col("sij")).when(
        spread, F.col("sij") / (F.sqrt("sii") * F.sqrt("sjj"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    first, second = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    both = merged.select(
        F.inline(
            F.array(
                F.struct(first.alias("col1"), second.alias("col2"), corr.alias("corr")),
                F.struct(second.alias("col1"), first.alias("col2"), corr.alias("corr")),
            )
        )
    )
    return both.unionByName(diagonal)


def _partial_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per task and pair: rows with both values, means, and centred moments."""
    width = len(columns)
    values = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    first, second = np.triu_indices(width, 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((width, width)) for _ in range(4)]  # n, mean, squares, products
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                raw = np.column_stack(
                    [c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]
                )
                known = np.column_stack(
                    [c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns]
                )
                _merge(total, _block(raw, known))
        n, mean, squares, products = total
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(first, pa.int32()),
                pa.array(second, pa.int32()),
                pa.array(n[first, second]),
                *(pa.array(m[a, b]) for m in (mean, squares) for a, b in ((first, second), (second, first))),
                pa.array(products[first, second]),
            ],
            names=["i", "j", "n", "mi", "mj", "sii", "sjj", "sij"],
        )

    return values.mapInArrow(partial, _MOMENTS).where("n > 0")


def _block(raw: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """Moments of one block; entry ``[i, j]`` belongs to column i on the rows where j is known too."""
    with np.errstate(invalid="ignore", over="ignore"):
        if known.all():
            rows, width = raw.shape
            shift = raw[0]
            mean = shift + (raw - shift).mean(axis=0)
            z = raw - mean
            products = z.T @ z
            squares = np.repeat(np.diag(products)[:, None], width, axis=1)
            return [np.full((width, width), float(rows)), np.repeat(mean[:, None], width, axis=1), squares, products]
        weights = known.astype(float)
        n = weights.T @ weights
        finite = known & np.isfinite(raw)
        # columns shifted by their own means in the block, so that sums of products lose little
        counts = np.maximum(finite.sum(axis=0), 1)
        shift = np.where(finite, raw / counts, 0.0).sum(axis=0)
        x = np.where(finite, raw - shift, 0.0)
        sums, raw_squares, products = x.T @ weights, (x * x).T @ weights, x.T @ x
        mean = sums / np.maximum(n, 1)
        squares = raw_squares - sums * mean
        products = products - sums * mean.T
        # where nearly all of a sum of squares was taken away again: that pair by itself
        for i, j in zip(*np.nonzero((squares <= 1e-6 * raw_squares) & (raw_squares > 0))):
            both = finite[:, i] & finite[:, j]
            if both.any():
                z = x[both, i] - x[both, i][0]
                centred = z - z.mean()
                mean[i, j] = x[both, i][0] + z.mean()
                squares[i, j] = centred @ centred
                products[i, j] = products[j, i] = centred @ x[both, j]
        odd = (known & ~finite).astype(float).T @ weights > 0  # a NaN or an infinity of i where j is known
        mean, squares = (np.where(odd, np.nan, m) for m in (mean + shift[:, None], squares))
        return [n, np.where(n > 0, mean, 0.0), squares, np.where(odd | odd.T, np.nan, products)]


def _merge(total: list[np.ndarray], block: list[np.ndarray]) -> None:
    """Add a block's moments to those of the rows before it."""
    n, mean, squares, products = total
    bn, bmean, bsquares, bproducts = block
    with np.errstate(invalid="ignore", over="ignore"):
        both = np.maximum(n + bn, 1)
        away = np.where(bn > 0, bmean - mean, 0.0)
        away_n = n * bn / both
        squares += bsquares + away * away * away_n
        products += bproducts + away * away.T * away_n
        mean += away * bn / both
        n += bn
