"""Shards along a Hilbert curve, so that files can be skipped on several columns at once.

Every dimension is quantised at its approximate quantiles into ``2**BITS`` levels.
The cells of that grid (at most ``2**(BITS * dimensions)``) are counted and
numbered along the curve; the rows of the table follow the order of their cells,
and the sequence is cut into runs of equal row counts.

The exact position of a row comes from counts alone: rows of the cells before it,
rows of the earlier buckets of its cell, rank inside the bucket.  A cell of ``c``
rows has about ``sqrt(c)`` buckets, so a hot cell is spread over many tasks and no
window grows with the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.llm.common import is_small, stored, text_or_empty

BITS = 4
ROW_OVERHEAD = 16


def _codes(df: DataFrame, dims: list[str]) -> dict[str, Column]:
    """Order-keeping number of each dimension: numbers as they are, text by its first
    six characters after the prefix that all values share.  Null comes first."""
    kinds = dict(df.dtypes)
    texts = [name for name in dims if kinds[name] == "string"]
    ends = df.agg(
        F.lit(0), *[f(col(name)) for name in texts for f in (F.min, F.max)]
    ).first()
    codes = {}
    for name in dims:
        if name not in texts:
            codes[name] = F.coalesce(col(name).cast("double"), F.lit(float("-inf")))
            continue
        low, high = ends[1 + 2 * texts.index(name)] or "", ends[2 + 2 * texts.index(name)] or ""
        shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        head = F.hex(F.substring(col(name), shared + 1, 6).cast("binary"))
        code = F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
        codes[name] = F.coalesce(code, F.lit(-1.0))
    return codes


def _levels(df: DataFrame, names: list[str], bits: int) -> dict[str, Column]:
    """Level of each code column: how many of its quantile cuts lie below."""
    steps = [i / 2**bits for i in range(1, 2**bits)]
    cuts = df.agg(F.lit(0), *[F.percentile_approx(name, steps, 10_000) for name in names]).first()
    return {
        name: reduce(
            lambda a, b: a + b,
            [(F.col(name) > F.lit(cut)).cast("int") for cut in (cuts[i + 1] or steps)],
        )
        for i, name in enumerate(names)
    }


def hilbert_index(df: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """``df`` with the Hilbert index of the integer columns ``axes`` (0 to ``2**bits - 1``)."""
    first, last = axes[0], axes[-1]
    work = {axis: f"__{i}" for i, axis in enumerate(axes)}
    x = lambda axis: F.col(work[axis])
    df = df.withColumns({work[a]: F.col(a).cast("bigint") for a in axes})
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for axis in axes:  # reflect or swap the lower bits, as this bit says
            is_set = x(axis).bitwiseAND(F.lit(q)) != 0
            swap = x(first).bitwiseXOR(x(axis)).bitwiseAND(F.lit(q - 1))
            df = df.withColumns(
                {
                    work[first]: F.when(is_set, x(first).bitwiseXOR(F.lit(q - 1))).otherwise(
                        x(first).bitwiseXOR(swap)
                    ),
                }
                | (
                    {}
                    if axis == first
                    else {work[axis]: F.when(is_set, x(axis)).otherwise(x(axis).bitwiseXOR(swap))}
                )
            )
    for before, axis in zip(axes, axes[1:]):  # Gray code
        df = df.withColumn(work[axis], x(axis).bitwiseXOR(x(before)))
    turn = F.lit(0).cast("bigint")
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(x(last).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__turn", turn)
    index = F.lit(0).cast("bigint")
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            digit = F.shiftright(x(axis).bitwiseXOR(F.col("__turn")), bit).bitwiseAND(F.lit(1))
            index = index * 2 + digit
    return df.withColumn(name, index).drop("__turn", *work.values())


def hilbert_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("lang", "source"),
    shards: int = 40,
    bits: int = BITS,
) -> DataFrame:
    """One row per input row: ``id, size, text_crc32, curve, shard, slot``.

    ``size`` is the UTF-8 length of the text (null: 0) plus 16, and is the last
    dimension after ``dims``.  Shard sizes differ by at most one row; ``slot``
    counts from 0 inside the shard along the curve.  ``text_crc32`` of a null text
    is that of the empty text.

    Nulls of a dimension and of the id come first in their order.  Rows equal in
    every compared column are interchangeable, so any order of them gives the
    same table.  An empty table gives no rows; fewer rows than shards leave
    shards empty.
    """
    require_columns(df, [id_col, text_col, *dims])
    size = F.octet_length(text_or_empty(text_col)).cast("bigint") + ROW_OVERHEAD
    names = [f"c{i}" for i in range(len(dims) + 1)]
    codes = _codes(df, list(dims))
    rows = df.select(
        col(id_col).cast("bigint").alias("id"),
        size.alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
        *[codes[d].alias(n) for d, n in zip(dims, names)],
        size.cast("double").alias(names[-1]),
    )
    rows = stored(rows, "hilbert-rows")
    levels = _levels(rows, names, bits)
    rows = rows.withColumns(levels)

    cells = hilbert_index(rows.groupBy(*names).count(), names, bits, "curve")
    up_to = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(  # at most 2**(bits * dimensions) rows
        cells.withColumns(
            {
                "cell_start": F.coalesce(F.sum("count").over(up_to), F.lit(0)),
                "buckets": F.ceil(F.sqrt("count")).cast("bigint"),
            }
        ).select(*names, "curve", "cell_start", "buckets", "count"),
        "hilbert-cells",
    )
    total = cells.agg(F.sum("count")).first()[0] or 0

    placed = rows.join(F.broadcast(cells) if is_small(cells) else cells, names).withColumn(
        "bucket", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.col("buckets"))
    )
    earlier = Window.partitionBy("curve").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("curve", "bucket", "cell_start")
        .count()
        .select(
            "curve",
            "bucket",
            (F.col("cell_start") + F.coalesce(F.sum("count").over(earlier), F.lit(0))).alias("start"),
        )
    )
    inside = Window.partitionBy("curve", "bucket").orderBy("id", "text_crc32", "size")
    ranked = placed.withColumn("nth", F.row_number().over(inside)).join(starts, ["curve", "bucket"])
    at = ranked.withColumn("at", F.col("start") + F.col("nth") - 1)
    shard = F.expr(f"`at` * {shards} div {max(total, 1)}")
    return at.withColumn("shard", shard.cast("int")).select(
        "id",
        "size",
        "text_crc32",
        "curve",
        "shard",
        (F.col("at") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).alias("slot"),
    )


def write_shards(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("lang", "source"),
    shards: int = 40,
) -> DataFrame:
    """Write ``df`` as Parquet, one folder per shard in slot order; returns each shard's ranges.

    Ids must be unique and not null here.  The returned table has ``shard``, its
    rows and the least and greatest value of every dimension.
    """
    require_columns(df, [id_col])
    places = hilbert_shards(df, id_col, text_col, dims, shards).select(
        F.col("id").alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot")
    )
    laid = df.join(places, col(id_col).cast("bigint") == F.col("__id")).drop("__id")
    laid = laid.repartition(shards, "__shard").sortWithinPartitions("__shard", "__slot").drop("__slot")
    laid.write.partitionBy("__shard").parquet(path)
    written = df.sparkSession.read.parquet(path)
    return written.groupBy(F.col("__shard").alias("shard")).agg(
        F.count("*").alias("rows"),
        *[f(col(d)).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)],
    )


def read_pruned(df: DataFrame, ranges: DataFrame, equal: dict[str, object]) -> DataFrame:
    """Rows of a written table with ``equal`` values, opening only shards whose ranges hold them."""
    keep = F.lit(True)
    for name, value in equal.items():
        keep = keep & F.lit(value).between(F.col(f"{name}_min"), F.col(f"{name}_max"))
    shards = [row["shard"] for row in ranges.where(keep).select("shard").collect()]  # bounded: shards
    out = df.where(F.col("__shard").isin(shards)).drop("__shard")
    for name, value in equal.items():
        out = out.where(col(name) == F.lit(value))
    return out
