import math
import random

import pytest

from tablewright.operators.order_stats import kth_values, quantile_values, quantiles


def values(spark, data, kind="double"):
    return spark.createDataFrame([(v,) for v in data], f"x {kind}")


def test_nearest_and_linear_of_four(spark):
    df = values(spark, [10.0, 20.0, 30.0, 40.0])
    assert quantile_values(df, ["x"], [0.25, 0.75]) == {"x": {0.25: 20.0, 0.75: 30.0}}
    linear = quantile_values(df, ["x"], [0.25, 0.5], "linear")["x"]
    assert linear == {0.25: 17.5, 0.5: 25.0}


def test_all_null_and_one_row(spark):
    df = spark.createDataFrame([(None, 3.0), (None, None)], "a double, b double")
    found = quantile_values(df, ["a", "b"], [0.25, 0.75])
    assert found == {"a": {0.25: None, 0.75: None}, "b": {0.25: 3.0, 0.75: 3.0}}


@pytest.mark.parametrize("shape", ["uniform", "heavy", "two_values", "sorted_ints", "tails"])
def test_narrowing_equals_sorting(spark, shape):
    draw = random.Random(5)
    n = 6_000
    data = {
        "uniform": [draw.random() for _ in range(n)],
        "heavy": [7.0 if draw.random() < 0.4 else draw.gauss(7, 5) for _ in range(n)],
        "two_values": [float(i % 2) for i in range(n)],
        "sorted_ints": [float(i) for i in range(n)],
        "tails": [draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300) for _ in range(n)],
    }[shape]
    df = values(spark, data).repartition(4)
    ordered = sorted(data)
    ranks = [0, 1, n // 4, n // 2 - 1, n // 2, 3 * n // 4, n - 1]
    found = kth_values(df, {"x": ranks}, {"x": n}, small=50)
    assert [found["x", r] for r in ranks] == [ordered[r] for r in ranks]


def test_large_integers_stay_exact(spark):
    base = 2**60
    data = [base + i for i in range(2_000)]
    df = values(spark, data, "bigint").repartition(3)
    found = kth_values(df, {"x": [999]}, {"x": 2_000}, small=20)
    assert found["x", 999] == base + 999


def test_nan_sorts_last(spark):
    data = [math.nan] * 500 + [float(i) for i in range(500)]
    found = kth_values(values(spark, data), {"x": [499, 500]}, {"x": 1_000}, small=20)
    assert found["x", 499] == 499.0 and math.isnan(found["x", 500])


def test_long_table(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0)], "a bigint, b double")
    rows = {(r["column"], r["q"]): r["value"] for r in quantiles(df, None, [0.5]).collect()}
    assert rows == {("a", 0.5): 2.0, ("b", 0.5): 4.0}
    approx = quantile_values(df, ["b"], [0.5], "approx")
    assert approx["b"][0.5] == 4.0


@pytest.mark.parametrize("kind", ["int", "float", "decimal(12,3)"])
def test_many_columns_through_stored_rounds(spark, kind):
    draw = random.Random(11)
    n = 20_000
    rows = [(draw.randrange(10**6), draw.randrange(50) if i % 3 else 7, None if i % 5 else i) for i in range(n)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").repartition(5)
    df = df.select(*[df[c].cast(kind).alias(c) for c in "abc"])
    ordered = {c: sorted(r[i] for r in rows if r[i] is not None) for i, c in enumerate("abc")}
    counts = {c: len(v) for c, v in ordered.items()}
    ranks = {c: [0, k // 4, k // 2, k - 1] for c, k in counts.items()}
    found = kth_values(df, ranks, counts, small=100, sketch_size=64)
    for c in "abc":
        assert [found[c, r] for r in ranks[c]] == [ordered[c][r] for r in ranks[c]]


def test_three_scans_whatever_the_ranks(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(300_000).selectExpr(
        "id a", "pmod(xxhash64(id), 1000003) b", "sin(id) c", "id % 3 d"
    ).write.parquet(path)
    df = spark.read.parquet(path)
    group = "order-statistics-jobs"
    spark.sparkContext.setJobGroup(group, group)
    found = quantile_values(df, list("abcd"), [0.1, 0.25, 0.5, 0.75, 0.9], small=10_000)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found["a"][0.5] == 150_000 and found["d"] == {0.1: 0, 0.25: 0, 0.5: 1, 0.75: 2, 0.9: 2}
    assert found["c"][0.25] == sorted(r.c for r in df.select("c").collect())[75_000]
    assert len(jobs) <= 9


def test_nothing_but_nan_and_infinities(spark):
    data = [math.nan] * 300 + [math.inf] * 300 + [-math.inf] * 300
    df = spark.createDataFrame([(v, math.nan) for v in data], "x double, y double").repartition(3)
    found = kth_values(df, {"x": [0, 299, 300, 599, 600], "y": [0, 899]}, {"x": 900, "y": 900}, small=10)
    assert [found["x", r] for r in (0, 299, 300, 599)] == [-math.inf] * 2 + [math.inf] * 2
    assert all(math.isnan(found[key]) for key in (("x", 600), ("y", 0), ("y", 899)))
