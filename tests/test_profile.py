import math
import random
import statistics

import pytest

from tablewright.operators import correlation, impute, outliers, profile, quality


def rows(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    data = [(1, "A"), (2, "B"), (3, "A"), (4, "C"), (5, "B")]
    return spark.createDataFrame(data, "numeric_int bigint, categorical string")


def test_distributions(mixed):
    number = profile.numeric_distributions(mixed).first()
    assert (number["count"], number["null_count"], number["unique"]) == (5, 0, 5)
    assert (number["mean"], number["median"], number["min"], number["max"]) == (3.0, 3.0, 1.0, 5.0)
    assert number["std"] == pytest.approx(2.5**0.5)
    text = profile.categorical_distributions(mixed).first()
    assert (text["column"], text["count"], text["unique"]) == ("categorical", 5, 3)


def test_top_values_order(mixed, spark):
    found = [(r["value"], r["count"]) for r in profile.top_values(mixed).collect()]
    assert found == [("A", 2), ("B", 2), ("C", 1)]
    nulls = spark.createDataFrame([(None,), (None,), ("x",)], "c string")
    assert profile.top_values(nulls, k=1).first()["value"] is None


def test_one_row_and_all_null(spark):
    df = spark.createDataFrame([(7.0, None)], "a double, b double")
    found = rows(profile.numeric_distributions(df), "column")
    assert found["a"]["std"] is None and found["a"]["median"] == 7.0
    assert found["b"]["count"] == 0 and found["b"]["unique"] == 1 and found["b"]["median"] is None
    report = rows(outliers.detect_outliers(df), "column")
    assert report["b"]["lower_bound"] is None and report["b"]["count"] == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, c string")
    for call in (
        profile.numeric_distributions,
        profile.categorical_distributions,
        outliers.detect_outliers,
        quality.quality_report,
    ):
        with pytest.raises(ValueError, match="no rows"):
            call(empty)
    assert profile.table_info(empty).first()["n_rows"] == 0


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("x",)], "c string")
    with pytest.raises(ValueError, match="no numeric column"):
        correlation.correlations(df)


def test_linear_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    found = {(r["col1"], r["col2"]): r["corr"] for r in correlation.correlations(df).collect()}
    assert found["x", "x"] == 1.0 and found["x", "y"] == pytest.approx(1.0)
    assert found["x", "y"] == found["y", "x"] and len(found) == 4


def test_correlation_agrees_with_the_engine(spark):
    draw = random.Random(1)
    data = []
    for _ in range(400):
        a = draw.gauss(1e6, 1)
        b = None if draw.random() < 0.2 else a + draw.gauss(0, 2)
        data.append((a, b, 5.0, None if draw.random() < 0.5 else draw.random()))
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(3)
    found = {(r[0], r[1]): r[2] for r in correlation.correlations(df).collect()}
    for a, b in (("a", "b"), ("a", "d"), ("b", "d")):
        value = df.where(f"{a} is not null and {b} is not null").corr(a, b)
        assert found[a, b] == found[b, a] == pytest.approx(value, abs=1e-9)
    assert found["a", "c"] is None and found["c", "c"] == 1.0 and len(found) == 16
    with pytest.raises(ValueError, match="method"):
        correlation.correlations(df, method="rank")


def test_correlation_does_not_depend_on_the_columns_around(spark):
    draw = random.Random(4)
    rows = []
    for i in range(3_000):
        x = draw.gauss(0, 1)
        far = x + (1e9 if i % 2 else -1e9)
        rows.append((far, (x + draw.gauss(0, 1)) if i % 2 else None, *[draw.random() for _ in range(5)]))
    df = spark.createDataFrame(rows, "far double, near double, a double, b double, c double, d double, e double")
    both = [r for r in rows if r[1] is not None]
    expected = statistics.correlation([r[0] - 1e9 for r in both], [r[1] for r in both])
    for n in (2, 4, 7):
        found = {(r[0], r[1]): r[2] for r in correlation.correlations(df, df.columns[:n]).collect()}
        assert found["far", "near"] == found["near", "far"] == pytest.approx(expected, abs=1e-6)


def test_correlation_with_nan(spark):
    nan = float("nan")
    rows = [(1.0, 2.0, None), (2.0, nan, 1.0), (3.0, None, 5.0), (4.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r[0], r[1]): r[2] for r in correlation.correlations(df).collect()}
    assert math.isnan(found["a", "b"]) and math.isnan(found["b", "c"]) and not math.isnan(found["a", "c"])


def test_feature_types(spark):
    data = [(i, i % 2, i % 5, "t", 5.0 if i else None) for i in range(30)]
    df = spark.createDataFrame(data, "id int, bit int, few bigint, text string, half double")
    found = {r[0]: r[1] for r in profile.feature_types(df, 20).collect()}
    assert found == {
        "id": "numerical",
        "bit": "binary",
        "few": "categorical",
        "text": "categorical",
        "half": "binary",
    }
    with pytest.raises(ValueError, match="positive"):
        profile.feature_types(df, 0)


def test_feature_types_count_nan_once(spark):
    df = spark.createDataFrame([(float("nan"),)] * 40 + [(1.0,)], "v double")
    assert profile.feature_types(df).first()["feature_type"] == "binary"


def test_quality(spark):
    data = [(1, "x", 5.0, 5.0, None), (1, "x", 5.0, 5.0, None), (2, "y", 5.0, None, None)]
    df = spark.createDataFrame(data, "a int, b string, same double, gap double, none string")
    assert [r[0] for r in quality.constant_columns(df).collect()] == ["same", "none"]
    assert {r["column"]: r["count"] for r in quality.missing_report(df).collect()} == {
        "gap": 1,
        "none": 3,
    }
    report = quality.quality_report(df).first()
    assert (report["total_rows"], report["total_columns"], report["duplicate_rows"]) == (3, 5, 1)
    assert report["issues"] == 2 + 2 + 1


def test_duplicates_with_a_hot_row(spark):
    data = [(1, None)] * 500 + [(i, "u") for i in range(300)] + [(3, "u")] * 2
    df = spark.createDataFrame(data, "a int, b string").repartition(5)
    found = quality.duplicate_rows(df).first()[0]
    assert found == len(data) - len(set(data))


def test_duplicates_of_both_zeros(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0,), (-0.0,), (nan,), (nan,), (1.0,)], "x double")
    assert quality.duplicate_rows(df).first()[0] == 2


def test_observed_rows(spark, mixed):
    watched, watch = quality.observed(mixed, "rows_seen")
    watched.collect()
    assert watch.get["rows"] == 5
    assert tuple(quality.step_report(mixed, mixed.limit(2)).first()) == (5, 2, 3)


def test_table_info_and_metadata(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id bigint, name string")
    info = profile.table_info(df).first()
    assert (info["n_rows"], info["n_columns"]) == (3, 2)
    assert info["memory_mb"] == pytest.approx((24 + 2) / 1048576)
    record = profile.table_metadata(df).first()
    assert record["shape"] == [3, 2] and record["columns"] == ["id", "name"]
    assert record["missing_counts"] == {"id": 0, "name": 1}
    assert record["dtypes"] == {"id": "bigint", "name": "string"}


def test_clean_counts_every_step_in_one_write(spark):
    rows = [(float(i), None if i % 4 == 0 else i) for i in range(100)] + [(1e9, 1), (1e9, 2)]
    df = spark.createDataFrame(rows, "a double, b int").repartition(3)
    steps = [
        ("drop", lambda d: impute.fit_fill(d, "drop").transform),
        ("outliers", lambda d: outliers.fit_outliers(d, ["a", "b"]).transform),
        ("narrow", lambda d: lambda e: e.select("a").where("a < 50")),
    ]
    result, report = quality.clean(df, steps)
    assert [tuple(r)[1:] for r in report.orderBy("position").collect()] == [
        ("drop", 102, 77, 25),
        ("outliers", 77, 75, 2),
        ("narrow", 75, 37, 38),
    ]
    assert result.columns == ["a"] and result.count() == 37


def test_step_log_of_empty_tables_and_later_columns(spark):
    log = quality.StepLog()
    df = log.watch(spark.createDataFrame([], "a int, b string"), "input")
    log.watch(df.where("a > 1"), "large").select("b").collect()
    assert log.counts() == [("input", 0), ("large", 0)]
    assert [tuple(r) for r in log.report(spark).collect()] == [(1, "large", 0, 0, 0)]
