import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import heavy, impute, profile


def plain_top(values, k):
    return sorted(Counter(values).items(), key=lambda e: (-e[1], e[0] is not None, e[0]))[:k]


@pytest.fixture(scope="module")
def skewed(spark):
    # a third of all rows hold one value, a few values are frequent, the rest is distinct
    return spark.range(200_000, numPartitions=6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 < 3 THEN concat('warm', id % 7)"
        " WHEN id % 50 = 4 THEN NULL ELSE concat('cold', id) END AS a",
        "concat('only', id) AS b",
        "CASE WHEN id % 4 > 0 THEN id % 4 END AS `c.d`",
    )


def test_frequent_values_are_proven_and_exact(spark, skewed):
    found = heavy.proven_counts(skewed, skewed.columns, 5)
    assert set(found) == {"a", "c.d"}  # nothing stands out among values that are all distinct
    values = [r.a for r in skewed.select("a").collect()]
    best = found["a"].orderBy(F.desc("n"), F.asc_nulls_first("v")).limit(5).collect()
    assert [(r.v, r.n) for r in best] == plain_top(values, 5)
    assert {(r.v, r.n) for r in found["c.d"].collect()} == {(v, 50_000) for v in (None, 1, 2, 3)}


def test_few_rows_are_shuffled(spark, skewed):
    found = heavy.proven_counts(skewed.select("a"), ["a"], 5)["a"]
    assert found.count() <= heavy.SPARE * 5


def test_top_values_and_modes_with_and_without_proof(spark, skewed):
    top = profile.top_values(skewed, ["a", "b"], 4).collect()
    values = [r.a for r in skewed.select("a").collect()]
    assert [(r.value, r["count"]) for r in top if r.column == "a"] == plain_top(values, 4)
    smallest = sorted(f"only{i}" for i in range(200_000))[:4]
    assert [(r.value, r["count"]) for r in top if r.column == "b"] == [(v, 1) for v in smallest]
    assert impute.modes(skewed, skewed.columns) == {"a": "hot", "b": "only0", "c.d": 1}


def test_ties_at_the_cut_nulls_and_empty(spark):
    rows = [(v, None) for v in "ccaabbd"]
    df = spark.createDataFrame(rows, "x string, y string")
    top = profile.top_values(df, ["x", "y"], 2).collect()
    assert [tuple(r) for r in top] == [("x", "a", 2), ("x", "b", 2), ("y", None, 7)]
    assert impute.modes(df, ["x", "y"]) == {"x": "a"}
    assert heavy.proven_counts(df.where("x = 'z'"), ["x", "y"], 2) == {}
    assert profile.top_values(df.where("x = 'z'"), ["x"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_proof_never_names_wrong_values(spark, seed):
    draw = random.Random(seed)
    values = [int(draw.paretovariate(0.6)) % 10**6 for _ in range(60_000)]
    df = spark.createDataFrame([(v,) for v in values], "x bigint").repartition(5)
    for k in (1, 10, 40):
        top = profile.top_values(df, ["x"], k).collect()
        expected = sorted(Counter(values).items(), key=lambda e: (-e[1], e[0]))[:k]
        assert [(int(r.value), r["count"]) for r in top] == expected
