import pytest
from pyspark.sql import functions as F

from tablewright.operators import tuning


def test_rungs():
    assert tuning.rungs_of(16, 4) == [(16, 16), (4, 4), (1, 1)]
    assert tuning.rungs_of(5, 2) == [(5, 8), (3, 4), (2, 2), (1, 1)]
    assert tuning.rungs_of(1, 3) == [(1, 1)]
    with pytest.raises(ValueError):
        tuning.rungs_of(0, 2)


def test_samples_are_nested(spark):
    rows = spark.range(4000).withColumn("k", F.when(F.col("id") % 7 > 0, F.col("id")))
    keys = [{r["k"] for r in tuning.row_sample(rows, ["k"], d, 1).collect()} for d in (16, 4, 1)]
    assert keys[0] < keys[1] < keys[2]
    assert 100 < len(keys[0]) < 350 and 700 < len(keys[1]) < 1000


def test_race(spark):
    rows = spark.range(600).select(
        "id", (F.col("id") % 37).alias("x"), (F.col("id") % 11).alias("z"),
        ((F.col("id") % 37) * (F.col("id") % 11)).cast("double").alias("y"),
    )
    train, valid = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    grid = [{"depth": 1, "learning_rate": 0.01}, {"depth": 4, "learning_rate": 0.5}, {"depth": 1, "learning_rate": 0.02}]
    race = tuning.successive_halving(
        train, valid, "y", "regression", ["id"], grid, "rmse", False, rounds=8, keep_one_in=3
    )
    log = race.log.orderBy("rung", "trial").collect()
    assert [(r["rung"], r["trial"], r["rounds"], r["kept"]) for r in log] == [
        (0, 0, 2, False), (0, 1, 2, True), (0, 2, 2, False), (1, 1, 8, True),
    ]
    assert log[0]["rows"] < log[3]["rows"] == 400 and log[3]["value"] < log[1]["value"]
    assert race.options == grid[1]
    with pytest.raises(ValueError, match="iterations"):
        tuning.successive_halving(train, valid, "y", "regression", ["id"], [{"iterations": 3}], "rmse", False)
