import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions.expressions import key_hash
from tablewright.operators import encode, features, impute, outliers, scale, split


def test_one_hot_in_place(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3), ("C", 4)], "cat string, num bigint")
    out = encode.one_hot(df, ["cat"])
    assert out.columns == ["cat_A", "cat_B", "cat_C", "num"]
    assert [tuple(r) for r in out.orderBy("num").collect()] == [
        (1, 0, 0, 1),
        (0, 1, 0, 2),
        (1, 0, 0, 3),
        (0, 0, 1, 4),
    ]
    with pytest.raises(ValueError, match="over 2"):
        encode.one_hot(df, ["cat"], max_categories=2)
    with pytest.raises(ValueError, match="no column missing"):
        encode.one_hot(df, ["missing"])


def test_label_null_first_and_back(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "c string, i int")
    fitted = encode.LabelEncoding.fit(df, ["c"])
    coded = fitted.transform(df)
    assert {r["i"]: r["c"] for r in coded.collect()} == {1: 2, 2: 1, 3: 0}
    for fmt in ("json", "parquet"):
        path = str(tmp_path / fmt)
        fitted.save(path, fmt)
        back = encode.LabelEncoding.load(spark, path, fmt).inverse(coded, "c")
        assert {r["i"]: r["c"] for r in back.collect()} == {1: "b", 2: "a", 3: None}
    beyond = spark.createDataFrame([(9.0,)], "c double")
    assert fitted.inverse(beyond, "c").first()["c"] == "9"


def test_label_unseen(spark):
    fitted = encode.LabelEncoding.fit(spark.createDataFrame([("a",), ("b",)], "c string"), ["c"])
    new = spark.createDataFrame([("c",)], "c string")
    assert fitted.transform(new).first()["c"] is None
    assert fitted.transform(new, unseen="minus_one").first()["c"] == -1
    with pytest.raises(Exception, match="unseen value in c"):
        fitted.transform(new, unseen="error").collect()


@pytest.mark.parametrize("kind", ["string", "bigint", "double"])
def test_label_buckets_equal_one_window(spark, kind):
    values = [None] + [v * 3 - 700 for v in range(1_000)]
    cast = {"string": str, "bigint": int, "double": float}[kind]
    typed = [None if v is None else cast(v) for v in values]
    df = spark.createDataFrame([(v,) for v in typed for _ in range(2)], f"v {kind}").repartition(4)
    fitted = encode.LabelEncoding.fit(df, ["v"], small=20)
    found = {r["value"]: r["code"] for r in fitted.mapping.collect()}
    known = sorted(v for v in typed if v is not None)
    assert found[None] == 0 and len(found) == len(values)
    assert [found[str(v)] for v in known] == list(range(1, len(values)))


def test_label_of_both_zeros(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "x double")
    coded = encode.LabelEncoding.fit(df, ["x"]).transform(df, unseen="error")
    assert sorted(r["x"] for r in coded.collect()) == [0, 0, 1]


def test_label_shuffle_join_when_large(spark, monkeypatch):
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 10)
    df = spark.createDataFrame([("hot",)] * 50 + [(f"v{i}",) for i in range(20)], "c string")
    coded = encode.LabelEncoding.fit(df, ["c"]).transform(df, unseen="error")
    assert coded.where("c = 0").count() == 50 and coded.count() == 70


@pytest.fixture(scope="module")
def gaps(spark):
    data = [(1.0, 10, "a"), (None, 20, "a"), (3.0, None, "b"), (5.0, 40, "b"), (7.0, 20, None)]
    return spark.createDataFrame(data, "x double, n bigint, c string")


def test_fill_values(gaps):
    assert impute.fit_fill(gaps, "mean").values == {"x": 4.0, "n": 22.5}
    assert impute.fit_fill(gaps, "median").values == {"x": 4.0, "n": 20.0}
    assert impute.fit_fill(gaps, "mode").values == {"x": 1.0, "n": 20, "c": "a"}
    assert impute.impute(gaps, "drop").count() == 2
    zero = impute.impute(gaps, "zero")
    assert zero.where("x = 0").count() == 1 and zero.where("c is null").count() == 1
    assert dict(impute.impute(gaps, "mean").dtypes)["n"] == "double"
    assert dict(impute.impute(gaps, "mode").dtypes)["n"] == "bigint"
    with pytest.raises(ValueError, match="no such filling"):
        impute.impute(gaps, "guess")


def test_fill_is_reusable(gaps, spark):
    plan = impute.fit_fill(gaps, "mean")
    new = spark.createDataFrame([(None, None, None)], gaps.schema)
    assert tuple(plan.transform(new).first()) == (4.0, 22.5, None)


def test_all_null_mode_is_skipped(spark):
    df = spark.createDataFrame([(None, 1)], "a double, b int")
    plan = impute.fit_fill(df, "mode")
    assert plan.skipped == ["a"] and plan.values == {"b": 1}


def test_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, same double")
    standard = scale.fit_scale(df, ["x", "same"])
    assert standard.skipped == ["same"]
    assert [r["x"] for r in standard.transform(df).orderBy("x").collect()] == [-1.0, 0.0, 1.0]
    low = scale.scale(df, ["x", "same"], "minmax").orderBy("x").collect()
    assert [tuple(r) for r in low] == [(0.0, 5.0), (0.5, 5.0), (1.0, 5.0)]
    robust = scale.scale(df, ["x"], "robust").orderBy("x").collect()
    assert [r["x"] for r in robust] == [-1.0, 0.0, 1.0]
    with pytest.raises(ValueError, match="no such scaling"):
        scale.scale(df, ["x"], "other")


def test_outliers_sequential_and_joint(spark):
    data = [(float(i), float(i % 7)) for i in range(100)] + [(1e6, 3.0), (5.0, 1e6), (None, 1.0)]
    df = spark.createDataFrame(data, "a double, b double")
    for small in (10, 1_000):
        kept = outliers.remove_outliers(df, ["a", "b"], small=small)
        assert kept.count() == 100
        assert outliers.remove_outliers(df, ["a", "b"], mode="joint", small=small).count() == 100
    report = {r["column"]: r["count"] for r in outliers.detect_outliers(df).collect()}
    assert report == {"a": 1, "b": 1}


def test_split_sizes(spark):
    df = spark.range(10)
    train, test = split.train_test_split(df, 0.25, ["id"])
    assert (train.count(), test.count()) == (8, 2)
    for bad in (0.0, 1.0, -1):
        with pytest.raises(ValueError, match="above 0 and below 1"):
            split.train_test_split(df, bad, ["id"])
    with pytest.raises(ValueError, match="no rows"):
        split.train_test_split(df.where("id < 0"), 0.2, ["id"])


@pytest.mark.parametrize("small", [1, 50, 100_000])
def test_split_is_exact_and_complete_at_every_depth(spark, small):
    df = spark.range(3_000).selectExpr("id", "cast(id % 10 = 0 as int) as y")
    train, test = split.train_test_split(df, 0.3, ["id"], stratify="y", small=small)
    counts = {(r["y"]): r["count"] for r in test.groupBy("y").count().collect()}
    assert counts == {0: 810, 1: 90}
    assert train.select("id").union(test.select("id")).distinct().count() == 3_000
    again = split.train_test_split(df.repartition(7), 0.3, ["id"], stratify="y")[1]
    assert {r["id"] for r in again.collect()} == {r["id"] for r in test.collect()}
    other = split.train_test_split(df, 0.3, ["id"], seed=7)[1]
    assert {r["id"] for r in other.collect()} != {r["id"] for r in test.collect()}


def test_split_of_copies(spark, monkeypatch):
    monkeypatch.setattr(split, "_COPY_BLOCK", 7)
    data = [("same", None)] * 60 + [("other", i) for i in range(40)]
    df = spark.createDataFrame(data, "a string, b int").repartition(4)
    train, test = split.train_test_split(df, 0.35)
    assert (train.count(), test.count()) == (65, 35)
    together = sorted(map(str, train.union(test).collect()))
    assert together == sorted(map(str, df.collect()))


def test_split_by_a_key_that_is_not_unique(spark):
    data = [(i % 3, i) for i in range(100)]
    df = spark.createDataFrame(data, "k int, v int")
    train, test = split.train_test_split(df, 0.2, ["k"])
    assert (train.count(), test.count()) == (80, 20)
    assert train.union(test).distinct().count() == 100


def test_features(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "c string, y double")
    fitted = features.TargetEncoding.fit(df, "c", "y")
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    assert sorted(r["c"] for r in fitted.transform(new).collect()) == [2.0, 3.0]
    powers = features.polynomial(df.withColumn("z", df.y + 1), ["y", "z"], 2, True)
    assert powers.columns == ["c", "y", "z", "y*z"]


def test_one_hot_names_do_not_clash(spark):
    df = spark.createDataFrame([("null",), (None,), ("x",)], "s string")
    assert sorted(encode.one_hot(df, ["s"]).columns) == ["s_<null>", "s_null", "s_x"]
    df = spark.createDataFrame([("b_c", "c")], "a string, a_b string")
    with pytest.raises(ValueError, match="same column name"):
        encode.one_hot(df, ["a", "a_b"])


def test_ties_at_the_cut_have_no_limit(spark):
    rows = [(c, "same") for c in range(20) for _ in range(3)]
    df = spark.createDataFrame(rows, "c int, t string")
    train, test = split.train_test_split(df, 0.34, stratify="c", small=10)
    assert (train.count(), test.count()) == (40, 20)
    different = spark.createDataFrame([(1, i) for i in range(500)], "k int, v int")
    train, test = split.train_test_split(different, 0.25, ["k"], small=10)
    kept = sorted([r["v"] for r in train.collect()] + [r["v"] for r in test.collect()])
    assert kept == list(range(500)) and test.count() == 125


def test_digest_tells_keys_apart(spark):
    rows = [(None, "x"), ("x", None), ("a:b", "c"), ("a", "b:c"), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(key_hash([F.col("a"), F.col("b")], 1).alias("h")).distinct().count() == 6


@pytest.mark.parametrize("interpolation", ["nearest", "linear"])
def test_sequential_outliers_equal_a_search_per_column(spark, interpolation):
    draw = random.Random(3)
    rows = []
    for i in range(3_000):
        a = None if i % 11 == 0 else draw.gauss(0, 1) ** 3
        b = 5 if i % 3 else draw.randrange(-(10**12), 10**12)
        c = float("inf") if i % 400 == 0 else draw.choice([-1, 1]) * 10.0 ** draw.uniform(-5, 5)
        rows.append((a, b, c, i))
    df = spark.createDataFrame(rows, "a double, b bigint, `c.d` double, id int").repartition(4)
    step = df
    for c in ("a", "c.d", "b"):
        bound = outliers.iqr_bounds(step, [c], 1.0, interpolation)[c]
        step = step.where(step[f"`{c}`"].between(*bound))
    for small in (30, 100_000):
        kept = outliers.remove_outliers(
            df, ["a", "c.d", "b"], 1.0, interpolation=interpolation, small=small
        )
        assert {r.id for r in kept.select("id").collect()} == {r.id for r in step.collect()}
    assert 0 < kept.count() < 3_000


def test_sequential_outliers_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert outliers.remove_outliers(df, ["a", "b"]).count() == 0
    assert outliers.remove_outliers(df.where("a > 5"), ["a", "b"]).count() == 0
    assert outliers.remove_outliers(df, ["a", "a"]).count() == 2
