"""Distributed ranks and running totals over an ordered key.

A window without partitions would sort every row in one task.  Here rows are
spread by ranges of the key, as many as the row count asks for, and the number of
its range is stored with each row.  Range totals are accumulated (one row per
range), and only then does a window run inside each range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.session import broadcast_if_small, materialise, row_bytes

#: Rows of a range, about; fewer rows in all are one range.
SMALL_ROWS = 100_000
#: Bytes of keys that finding the bounds of ranges may bring to the driver, and the keys that
#: Spark draws there for each range (``spark.sql.execution.rangeExchange.sampleSizePerPartition``).
SAMPLE_BYTES = 64 * 1024 * 1024
_DRAWN = 100


def range_count(df: DataFrame, key: str, rows: int, small: int = SMALL_ROWS) -> int:
    """Ranges of about ``small`` rows, or fewer and larger ones where drawing keys for so many
    would bring over ``SAMPLE_BYTES`` to the driver.  Large ranges are sorted with spilling."""
    ranges = math.ceil(rows / small)
    if ranges <= 1:
        return 1
    size = df.agg(F.avg(row_bytes(df.select(col(key))))).first()[0] or 1
    setting = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    drawn = int(df.sparkSession.conf.get(setting, str(_DRAWN)))
    return min(ranges, max(1, int(SAMPLE_BYTES // (drawn * size))))


def running_before(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    rows: int,
    descending: bool = False,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Add, per name in ``sums``, the total over all rows ordered strictly before.

    ``df`` holds one row per key.  NULL keys come first when ascending.
    """
    order = F.desc_nulls_last(col(key)) if descending else F.asc_nulls_first(col(key))
    valued = df.withColumns({f"_v_{name}": expr for name, expr in sums.items()})
    ranges = range_count(df, key, rows, small)
    if ranges <= 1:
        valued = valued.withColumn("_bucket", F.lit(0))
    else:
        spread = valued.repartitionByRange(ranges, F.asc_nulls_first(col(key)))
        valued = materialise(spread.withColumn("_bucket", F.spark_partition_id()))
        side = F.desc("_bucket") if descending else F.asc("_bucket")
        earlier = Window.orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
        totals = valued.groupBy("_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        offsets = materialise(  # one row per range
            totals.select(
                "_bucket",
                *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
            )
        )
        valued = valued.join(broadcast_if_small(offsets), "_bucket")
    inside = (
        Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    added = {}
    for n in sums:
        before = F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))
        added[n] = before if ranges <= 1 else before + F.col(f"_o_{n}")
    return valued.withColumns(added).select(*[col(c) for c in df.columns], *sums)


def ordered_codes(values: DataFrame, key: str, rows: int, small: int = SMALL_ROWS) -> DataFrame:
    """Codes 0..n-1 in key order, NULL first, for a frame with one row per key."""
    coded = running_before(values, key, {"code": F.lit(1).cast("bigint")}, rows, small=small)
    return coded.withColumn("code", F.col("code").cast("bigint"))
