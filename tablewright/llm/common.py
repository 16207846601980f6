"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.session import row_bytes, scratch_path

#: Largest measured size of a broadcast table.
BROADCAST_BYTES = 16 * 1024 * 1024
#: Bytes of text handled at once inside a task.
SLICE_CHARS = 500_000
#: Most rows of an Arrow batch: batches are cut by rows, and texts can be long.
BATCH_ROWS = 2_000


def text_or_empty(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The files outlive a lost executor, and later reads prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


Scratch = Callable[[DataFrame, str], DataFrame]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Store tables like ``stored`` that are deleted at the end of the block."""
    root = scratch_path(spark, "scratch")

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    try:
        yield keep
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a stored table: may it be broadcast?"""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes


def joinable(df: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """``df`` as one side of a join: broadcast when it, or the table ``sized`` that bounds it, is
    small as measured, else merged.

    Without a mark Spark goes by its own estimate, which is far too low after an explode and for
    files that compress well, and may put millions of rows into the driver.
    """
    return F.broadcast(df) if is_small(df if sized is None else sized) else df.hint("merge")


def semi_join_early(
    rows: DataFrame,
    keys: DataFrame,
    on: list[str],
    narrow: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``narrow(rows)`` for rows whose ``on`` columns occur in ``keys``.

    A small key table is broadcast and decides before ``narrow`` does its work.
    Beyond that size ``narrow`` runs first, so that no wide row is shuffled.
    ``narrow`` must keep the ``on`` columns.
    """
    if is_small(keys):
        return narrow(rows.join(F.broadcast(keys), on, "left_semi"))
    return narrow(rows).join(keys.hint("merge"), on, "left_semi")


def without(df: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` whose key expressions match no row of ``dropped``, nulls comparing equal.

    ``keys`` maps columns of ``dropped`` to expressions over ``df``.  Every
    column of ``df`` is kept, whatever its name.
    """
    mark = uuid.uuid4().hex
    names = {name: f"{name}_{mark}" for name in keys}
    left = df.select("*", *[expr.alias(names[name]) for name, expr in keys.items()])
    right = dropped.select(*[F.col(name).alias(names[name] + "r") for name in keys]).distinct()
    right = joinable(right)
    match = F.lit(True)
    for name in keys:
        match = match & F.col(names[name]).eqNullSafe(F.col(names[name] + "r"))
    return left.join(right, match, "left_anti").drop(*names.values())


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``SLICE_CHARS`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(before + SLICE_CHARS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class SpanMemory:
    """Values of text spans, computed once for each distinct span that a worker meets.

    ``learn`` maps a list of new spans to all their values in one array and the
    number of values of each.  Beyond ``limit`` spans the memory starts anew, which
    costs time only.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self._learn, self._limit = learn, limit
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[str, int] = {}
        self._values, self._counts = self._learn([])
        self._begin = np.zeros(0, np.int64)

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all spans of all texts in order, and where each text ends."""
        new = list(set(chain.from_iterable(texts)).difference(self._slot))
        if len(self._slot) + len(new) > self._limit:
            self._forget()
            new = list(set(chain.from_iterable(texts)))
        if new:
            values, counts = self._learn(new)
            self._slot.update(zip(new, range(len(self._slot), len(self._slot) + len(new))))
            self._begin = np.concatenate([self._begin, len(self._values) + np.cumsum(counts) - counts])
            self._counts = np.concatenate([self._counts, counts])
            self._values = np.concatenate([self._values, values])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        slots = np.fromiter(map(self._slot.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
        counts = self._counts[slots]
        ends = np.r_[0, np.cumsum(counts)]
        places = np.repeat(self._begin[slots] - ends[:-1], counts) + np.arange(ends[-1])
        return self._values[places], ends[np.cumsum(sizes)]


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short in this session, so that long texts fit a task's memory."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id`` (bigint) and ``text`` (null: empty), whatever else ``df`` holds."""
    require_columns(df, [id_col, text_col])
    short_batches(df.sparkSession)
    return df.select(col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
