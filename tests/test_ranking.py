import math
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import ranking
from tablewright.operators.ranking import ordered_codes, running_before


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["double", "bigint", "string"])
def test_running_totals_over_buckets(spark, kind, descending):
    draw = random.Random(2)
    keys = [None, *draw.sample(range(-5_000, 5_000), 800)]
    if kind == "double":
        keys = [None if k is None else k / 7 for k in keys] + [math.inf, -math.inf, math.nan]
    if kind == "bigint":
        keys += [2**60 + i for i in range(50)]
    if kind == "string":
        keys = [None if k is None else f"ü{k}" * 3 for k in keys]
    data = [(k, draw.randrange(100)) for k in keys]
    df = spark.createDataFrame(data, f"k {kind}, n bigint").repartition(5)
    found = running_before(df, "k", {"above": F.col("n")}, len(data), descending, small=30)
    order = {
        "string": lambda k: (k is not None, (k or "").encode()),
    }.get(kind, lambda k: (k is not None, k is not None and math.isnan(k), 0 if k is None or math.isnan(k) else k))
    expected, total = {}, 0
    for k, n in sorted(data, key=lambda row: order(row[0]), reverse=descending):
        expected[str(k)] = total
        total += n
    assert {str(r["k"]): r["above"] for r in found.collect()} == expected


def test_keys_with_a_long_common_prefix(spark):
    keys = ["x" * 300 + f"{i:04}" for i in range(2_000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(4)
    codes = ordered_codes(df, "k", len(keys), small=100)
    assert [r["code"] for r in codes.orderBy("k").collect()] == list(range(len(keys)))


def test_drawn_keys_are_bounded_by_bytes(spark, monkeypatch):
    """Codes of long keys in many small ranges; fewer ranges where drawing keys for all would be too much."""
    values = spark.range(3000).select(F.concat(F.lit("path/" * 60), F.col("id").cast("string")).alias("v"))
    assert ranking.range_count(values, "v", 3000, 10) == 300
    assert ranking.range_count(values, "v", 3_000_000_000, 100) <= ranking.SAMPLE_BYTES // (100 * 300)
    monkeypatch.setattr(ranking, "SAMPLE_BYTES", 1_000_000)
    assert 1 < ranking.range_count(values, "v", 3000, 10) < 30
    coded = ranking.ordered_codes(values, "v", 3000, small=10).orderBy("code").collect()
    assert [(r["v"], r["code"]) for r in coded] == [(v, i) for i, v in enumerate(sorted(r["v"] for r in coded))]
    assert len(coded) == 3000
