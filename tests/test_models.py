import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import blend, boosting, metrics, models
from tablewright.operators.split import train_test_split
from tablewright.plans import model_queries
from tablewright.plans.automl import Recipe, automl_loop
from tablewright.sources import files, runs
from tablewright.sources import models as model_files


def scored(spark, pairs, schema="label int, prediction int"):
    return spark.createDataFrame(pairs, schema)


def test_hand_checked_classification(spark):
    # tp 2, fn 1, fp 1, tn 4
    pairs = [(1, 1)] * 2 + [(1, 0)] + [(0, 1)] + [(0, 0)] * 4
    row = metrics.classification_metrics(scored(spark, pairs)).first()
    assert row["accuracy"] == pytest.approx(6 / 8)
    assert row["f1"] == pytest.approx((3 * (4 / 6) + 5 * (8 / 10)) / 8)
    assert row["roc_auc"] == pytest.approx((2 / 3 + 4 / 5) / 2)
    report = {r["class"]: r for r in metrics.classification_report(scored(spark, pairs)).collect()}
    assert report["1"]["precision"] == pytest.approx(2 / 3) and report["1"]["support"] == 3
    assert report["macro avg"]["recall"] == pytest.approx((2 / 3 + 4 / 5) / 2)
    assert report["weighted avg"]["support"] == 8


def test_class_never_predicted(spark):
    row = metrics.classification_metrics(scored(spark, [(0, 0), (1, 0), (2, 3)])).first()
    assert row["f1"] == pytest.approx((2 / 3) / 3) and row["roc_auc"] is None
    one_class = metrics.classification_metrics(scored(spark, [(1, 1)])).first()
    assert one_class["accuracy"] == 1.0 and one_class["roc_auc"] is None


@pytest.mark.parametrize("small", [10, 100_000])
def test_auc_equals_pair_counting(spark, small):
    import random

    draw = random.Random(3)
    data = [(int(draw.random() < 0.3), round(draw.random(), 2)) for _ in range(600)]
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = scored(spark, data, "label int, prediction double").repartition(4)
    assert metrics.roc_auc(df, small=small).first()[0] == pytest.approx(expected)
    assert metrics.roc_auc(df.where("label = 1"), small=small).first()[0] is None


def test_regression(spark):
    df = scored(spark, [(1.0, 1.0), (2.0, 4.0)], "label double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert row["rmse"] == pytest.approx(2**0.5) and row["mae"] == 1.0
    assert row["r2"] == pytest.approx(1 - 4 / 0.5)
    flat = scored(spark, [(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert metrics.regression_metrics(flat).first()["r2"] is None


def test_threshold_only_for_floating(spark):
    floats = scored(spark, [(1, 0.9), (0, 0.5)], "label int, prediction double")
    assert metrics.evaluate(floats, "classification").first()["accuracy"] == 1.0
    several = scored(spark, [(2, 2), (0, 0), (1, 1)])
    assert metrics.evaluate(several, "classification").first()["accuracy"] == 1.0


@pytest.fixture(scope="module")
def points(spark):
    data = [(1.0, 2.0, 0), (2.0, 3.0, 0), (3.0, 1.0, 0), (8.0, 7.0, 1), (9.0, 8.0, 1)] * 20
    rows = [(i, a, b, y) for i, (a, b, y) in enumerate(data)]
    return spark.createDataFrame(rows, "id bigint, feature1 double, feature2 double, target int")


def test_train_saves_and_scores(spark, points, tmp_path):
    result = models.train(
        points, points, "target", "classification", ["id"], iterations=3, depth=2
    )
    assert result.test_metrics.first()["accuracy"] == 1.0
    ranked = models.train(
        points, points, "target", "classification", ["id"], iterations=2, use_probability=True
    )
    assert ranked.test_metrics.first()["roc_auc"] == 1.0
    assert result.predictions.columns == ["id", "prediction"]
    assert dict(result.predictions.dtypes)["prediction"] == "int"
    path = model_files.save_model(result.model, str(tmp_path))
    loaded = model_files.load_model(spark, path)
    again = loaded.score(points, ["id"])
    assert again.join(result.predictions, ["id", "prediction"]).count() == 100
    unlabelled = models.train(
        points, points.drop("target"), "target", "classification", ["id"], "gbt_c", n_estimators=2
    )
    assert unlabelled.test_metrics is None and unlabelled.predictions.count() == 100
    result.predictions.write.parquet(str(tmp_path / "predictions_gbt_a"))
    listed = files.catalog_run(
        spark, "r1", str(tmp_path), str(tmp_path / "predictions_gbt_a"), "# Results"
    )
    kinds = {r["kind"] for r in listed.collect()}
    assert kinds == {"final_predictions", "model", "predictions", "report"}


def test_text_classes_and_three_of_them(spark, points):
    named = points.withColumn(
        "target", F.when(F.col("feature1") < 3, "low").when(F.col("feature1") < 8, "mid").otherwise("top")
    )
    result = models.train(named, named, "target", "classification", ["id"], iterations=2, depth=2)
    assert result.test_metrics.first()["accuracy"] == 1.0
    assert {r[0] for r in result.predictions.select("prediction").distinct().collect()} == {
        "low",
        "mid",
        "top",
    }


def test_training_errors(points):
    assert models.tree_params("gbt_a", {"l2_leaf_reg": 3.0})["l2"] == 3.0
    with pytest.raises(ValueError, match="negative"):
        models.tree_params("gbt_b", {"reg_alpha": -1})
    with pytest.raises(ValueError, match="Unknown option"):
        models.tree_params("gbt_b", {"iterations": 3})
    with pytest.raises(ValueError, match="Unknown family"):
        models.tree_params("other", {})
    assert models.tree_params("gbt_c", {})["maxIter"] == 100
    text = points.withColumn("word", F.lit("x"))
    with pytest.raises(ValueError, match="word"):
        models.fit(text, "target", "classification")
    holes = points.withColumn("feature1", F.when(F.col("id") > 5, F.col("feature1")))
    with pytest.raises(Exception, match="(?i)null"):
        models.fit(holes, "target", "classification", exclude=["id"], iterations=1)


def test_blend_by_key_not_by_position(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0)], "id int, prediction double")
    b = spark.createDataFrame([(2, 40.0), (1, 30.0)], "id int, prediction double")
    found = {r["id"]: r["prediction"] for r in blend.blend([a, b], [1, 3], "id").collect()}
    assert found == {1: 25.0, 2: 35.0}
    short = a.where("id = 1")
    with pytest.raises(Exception, match="not once in every input: key 2"):
        blend.blend([a, short], [1, 1], "id").collect()
    twice = a.union(a.where("id = 1"))
    with pytest.raises(Exception, match="not once in every input: key 1"):
        blend.blend([twice, b], [1, 1], "id").collect()
    with pytest.raises(ValueError, match="sum to zero"):
        blend.blend([a, b], [0, 0], "id")


def test_search_finds_the_good_model(spark):
    truth = spark.range(200).selectExpr("cast(id as int) id", "cast(id % 2 as int) y")
    good = truth.selectExpr("id", "y * 0.8 + 0.1 as prediction")
    bad = truth.selectExpr("id", "1 - y * 0.9 as prediction")
    result = blend.search_blend([good, bad], truth, "y", "classification", "id", 50)
    assert result.metrics.first()["accuracy"] == 1.0
    assert result.weights[0] > 0.5 and sum(result.weights) == pytest.approx(1.0)
    assert result.trials.count() == 50
    again = blend.search_blend([good, bad], truth, "y", "classification", "id", 50)
    assert again.weights == result.weights


def test_search_regression_equals_direct_error(spark):
    truth = spark.range(100).selectExpr("cast(id as int) id", "cast(id as double) y")
    one = truth.selectExpr("id", "y + 3 as prediction")
    two = truth.selectExpr("id", "y * 0.5 as prediction")
    found = blend.search_blend([one, two], truth, "y", "regression", "id", 20)
    weights = blend.candidate_weights(2, 20)
    for row in found.trials.collect():
        w = weights[row["trial"]]
        direct = sum(((i + 3) * w[0] + i * 0.5 * w[1] - i) ** 2 for i in range(100)) / 100
        assert row["objective"] == pytest.approx(direct)


def test_several_classes_vote(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, y string")
    same = truth.selectExpr("id", "y as prediction")
    other = truth.selectExpr("id", "'a' as prediction")
    result = blend.search_blend([same, same, other], truth, "y", "classification", "id", 20)
    assert result.metrics.first()["accuracy"] == 1.0
    votes = spark.createDataFrame([("x", "y", "y")], "p0 string, p1 string, p2 string")
    pick = blend.weighted_vote([0.5, 0.3, 0.3], 3)
    assert votes.select(pick.alias("v")).first()["v"] == "y"
    tie = spark.createDataFrame([("y", "x")], "p0 string, p1 string")
    assert tie.select(blend.weighted_vote([0.5, 0.5], 2).alias("v")).first()["v"] == "x"


def test_loop_stops_when_good_enough(spark, points):
    mixed = points.withColumn("word", F.when(F.col("target") == 1, "yes").otherwise("no"))
    recipes = [
        Recipe("first", options={"iterations": 1, "depth": 1}),
        Recipe("second", "gbt_c", scale="minmax", options={"n_estimators": 1}),
    ]
    done = automl_loop(
        mixed, mixed.drop("target"), "target", "classification", ["id"], recipes
    )
    assert done.accepted and done.final_iteration == 1 and done.log.count() == 1
    assert done.predictions.count() == 100
    never = automl_loop(
        mixed, mixed, "target", "classification", ["id"], recipes, acceptance_threshold=1.1
    )
    assert not never.accepted and never.final_iteration == 2
    assert [r["iteration"] for r in never.log.collect()] == [1, 2]


def test_seven_inputs_must_each_hold_the_key(spark):
    def table(i, keys):
        return spark.createDataFrame([(k, float(i)) for k in keys], "id int, prediction double")

    # counts, sums, squares and maximum of the inputs of key 1 are those of a whole set
    held = [[2], [1, 1, 2], [1, 1, 2], [1, 2], [2], [2], [1, 1, 2]]
    with pytest.raises(Exception, match="not once in every input"):
        blend.align([table(i, keys) for i, keys in enumerate(held)], "id").collect()
    whole = blend.align([table(i, [1, 2]) for i in range(7)], "id").collect()
    assert sorted(r["id"] for r in whole) == [1, 2] and all(r["p6"] == 6.0 for r in whole)


def test_missing_predictions_are_misses_in_objective_and_metric(spark):
    rows = [(1, 0.9, 1), (2, 0.1, 0), (3, None, 1), (4, None, 0)]
    df = spark.createDataFrame(rows, "id int, prediction double, label int")
    found = blend.search_blend(
        [df.select("id", "prediction")], df.select("id", "label"), "label", "classification", "id", 3
    )
    assert min(r["objective"] for r in found.trials.collect()) == -0.5
    assert found.metrics.first()["accuracy"] == 0.5


def test_keys_are_checked_whatever_is_selected(spark):
    def table(keys):
        return spark.createDataFrame([(k, float(k)) for k in keys], "id int, prediction double")

    mixed = blend.blend([table([1, 2, 2]), table([1, 3])], [1, 1], "id")
    for some in (mixed, mixed.select("prediction"), mixed.groupBy().count()):
        with pytest.raises(Exception, match="not once in every input"):
            some.collect()
    good = [table([1, 2]), table([1, 2])]
    labels = spark.createDataFrame([(1, 1.0), (2, 2.5)], "id int, y double")
    short = ([table([1]), table([1, 2])], labels)
    with pytest.raises(Exception, match="not once in every input"):
        blend.search_blend(good, labels, "y", "regression", "id", 3, holdout=short).metrics.collect()


def test_missing_values_in_a_regression_blend(spark):
    rows = [(1, 1.0, 5.0, 1.0), (2, None, 4.0, 2.0), (3, 3.0, 1.0, 3.0), (4, 4.0, 8.0, 4.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    inputs = [df.select("id", df[c].alias("prediction")) for c in ("a", "b")]
    aligned = blend.align(inputs, "id", df.select("id", "y"), "y")
    found = blend.score_candidates(aligned, [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]], "regression", 2).collect()
    errors = [(16 + 4 + 16) * w * w / 3 for w in (0, 0.5, 1)]  # over rows 1, 3 and 4
    assert [r["objective"] for r in found] == pytest.approx(errors)
    nothing = df.select("id", F.lit(None).cast("double").alias("y"))
    with pytest.raises(ValueError, match="no row has a label"):
        blend.search_blend(inputs, nothing, "y", "regression", "id", 3)


def test_simplex_minimum_against_a_grid_and_its_conditions():
    draw = np.random.default_rng(3)
    for k in (1, 2, 3, 4, 8):
        for _ in range(30):
            errors = draw.normal(size=(draw.integers(2, 30), k)) + draw.normal(size=k)
            if k > 2:
                errors[:, 1] = errors[:, 0]  # the same model twice
            g = errors.T @ errors / len(errors)
            w = blend.simplex_minimum(g)
            slope, value = g @ w, w @ g @ w
            assert w.min() >= 0 and w.sum() == pytest.approx(1)
            assert slope.min() >= value - 1e-9  # no input would lower the error
            tries = draw.dirichlet(np.ones(k), 300)
            assert value <= np.einsum("ti,ij,tj->t", tries, g, tries).min() + 1e-12


def test_optimal_blend(spark):
    rows = [(i, float(i % 7), float(i % 5) + 0.5 * i, 0.3 * (i % 7) + 0.7 * (i % 5 + 0.5 * i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    inputs = [df.select("id", df[c].alias("prediction")) for c in ("a", "b")]
    found = blend.optimal_blend(inputs, df.select("id", "y"), "y", "id")
    assert found.weights == pytest.approx([0.3, 0.7]) and found.metrics.first()["rmse"] == pytest.approx(0, abs=1e-9)


def numbers(spark, n=400):
    draw = np.random.default_rng(1)
    x = draw.uniform(0, 10, (n, 3)).round(2)
    y = 3 * (x[:, 0] > 4) - 2 * (x[:, 1] > 7) + 0.1 * x[:, 2]
    rows = [(i, *map(float, x[i]), float(y[i]), int(y[i] > 1), int(min(2, max(0, y[i] + 1)))) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, two int, three int")


def test_leaf_values_follow_from_penalised_sums(spark):
    """Every leaf of every round, from the leaf of each row and the margins before the round."""
    df = numbers(spark)
    rows = df.orderBy("id").toPandas()
    x = rows[["a", "b", "c"]].to_numpy()
    for target, task, l1, l2 in (("y", "regression", 3.0, 2.0), ("two", "classification", 1.5, 4.0), ("three", "classification", 0.5, 1.0)):
        others = [c for c in ("id", "y", "two", "three") if c != target]
        model = models.fit(df, target, task, "gbt_b", others, num_iterations=4, max_depth=3, reg_alpha=l1, reg_lambda=l2).booster
        margins, label = np.tile(np.array(model.start), (len(x), 1)), rows[target].to_numpy(float)
        width = len(model.start)
        for at in range(0, len(model.trees), width):
            if task == "regression":
                g, h = margins - label[:, None], np.ones_like(margins)
            elif target == "two":
                p = 1 / (1 + np.exp(-margins))
                g, h = p - label[:, None], p * (1 - p)
            else:
                p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
                g, h = p - (label[:, None] == np.arange(3)), p * (1 - p)
            for c, tree in enumerate(model.trees[at : at + width]):
                leaf = tree.leaves(x)
                for k in np.unique(leaf):
                    G, H = g[leaf == k, c].sum(), h[leaf == k, c].sum()
                    wanted = -0.1 * np.sign(G) * max(abs(G) - l1, 0) / (H + l2)
                    assert tree.values[k] == pytest.approx([wanted if i == c else 0 for i in range(width)], abs=1e-9)
                margins = margins + np.array(tree.values)[leaf]
        assert model.margins(x) == pytest.approx(margins)


def test_penalties_shrink_and_models_are_saved(spark, tmp_path):
    df = numbers(spark)
    spread = []
    for l2 in (0.01, 1_000.0):
        result = models.train(df, df, "y", "regression", ["id"], "gbt_a", exclude=["id", "two", "three"], iterations=10, depth=3, l2_leaf_reg=l2)
        spread.append(result.predictions.agg(F.stddev("prediction")).first()[0])
    assert spread[1] < 0.3 * spread[0]
    joint = models.train(df, df, "three", "classification", ["id"], exclude=["id", "y", "two"], iterations=20, depth=3)
    assert joint.test_metrics.first()["accuracy"] > 0.95
    shares = joint.model.booster.transform(df.select("a", "b", "c")).select(F.aggregate("_probability", F.lit(0.0), lambda s, p: s + p).alias("s"))
    assert shares.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-9
    loaded = model_files.load_model(spark, model_files.save_model(joint.model, str(tmp_path)))
    assert loaded.score(df, ["id"]).exceptAll(joint.predictions).count() == 0
    gaps = df.withColumn("a", F.when(F.col("id") > 3, F.col("a")))
    with pytest.raises(Exception, match="impute first"):
        loaded.score(gaps, ["id"]).collect()


def test_parse_tree():
    text = "If (feature 1 <= 2.5)\n Predict: 1.0\nElse (feature 1 > 2.5)\n If (feature 0 <= -1.0E-3)\n  Predict: 2\n Else (x)\n  Predict: 3"
    tree = boosting.parse_tree(text, [[1.0], [2.0], [3.0]])
    assert tree.leaves(np.array([[0, 2.5], [0, 3], [-1, 3]])).tolist() == [0, 2, 1]


def test_a_run_is_visible_only_when_it_is_whole(spark, tmp_path, monkeypatch):
    df = numbers(spark, 60)
    place = str(tmp_path / "runs")
    how = dict(family="gbt_c", exclude=["id", "y", "three"], n_estimators=2, max_depth=2)
    run_id, result = runs.train_run(df, df, "two", "classification", ["id"], place, **how)
    scored = runs.read_run(spark, place, run_id, "scored").collect()
    truth = {r["id"]: r["two"] for r in df.collect()}
    assert {r["id"]: r["two"] for r in scored} == truth
    summary = {(r["part"], r["metric"]): r["value"] for r in runs.read_run(spark, place, run_id, "summary").collect()}
    assert summary["test", "accuracy"] == pytest.approx(sum(r["prediction"] == r["two"] for r in scored) / 60)
    again = runs.read_run_model(spark, place, run_id).score(df, ["id"])
    assert again.exceptAll(result.predictions).count() == 0
    monkeypatch.setattr(runs, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        runs.write_run(result, df, df, ["id"], place)
    assert [m["run_id"] for m in runs.list_runs(spark, place)] == [run_id]
    broken = next(p.name for p in (tmp_path / "runs").iterdir() if p.name != run_id)
    with pytest.raises(ValueError, match="no finished run"):
        runs.read_run(spark, place, broken, "scored")
    monkeypatch.undo()
    blind = runs.write_run(result, df, df.drop("two"), ["id"], place)
    with pytest.raises(ValueError, match="no table scored"):
        runs.read_run(spark, place, blind, "scored")
    assert runs.read_run(spark, place, blind, "predictions").count() == 60


def test_equal_rows_are_learnt_from_as_one(spark):
    """A tall table of few different rows gives the model of its rows, and trains on the few."""
    few = numbers(spark, 60)
    tall = few.crossJoin(spark.range(1, 40).withColumnRenamed("id", "copy")).where("copy <= 1 + id % 30")
    tall = tall.withColumn("id", F.col("id") * 100 + F.col("copy")).drop("copy").repartition(5)
    x = few.orderBy("id").select("a", "b", "c").toPandas().to_numpy()
    counts = 1 + np.arange(60) % 30
    for target, task in (("y", "regression"), ("two", "classification"), ("three", "classification")):
        ready = tall.withColumn("_label", F.col(target).cast("double"))
        single = models.collapsed(ready, ["a", "b", "c"], task)
        assert single.count() == 60 and single.agg(F.sum("_weight")).first()[0] == tall.count() == counts.sum()
        others = [c for c in ("id", "y", "two", "three") if c != target]
        model = models.fit(tall, target, task, "gbt_a", others, ["id"], iterations=2, depth=2, l2_leaf_reg=1.0).booster
        label = few.orderBy("id").toPandas()[target].to_numpy(float)
        margins = np.tile(np.array(model.start), (60, 1))
        for at in range(0, len(model.trees), len(model.start)):
            if task == "regression":
                g, h = margins - label[:, None], np.ones_like(margins)
            elif target == "two":
                p = 1 / (1 + np.exp(-margins))
                g, h = p - label[:, None], p * (1 - p)
            else:
                p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
                g, h = p - (label[:, None] == np.arange(3)), p * (1 - p)
            for c, tree in enumerate(model.trees[at : at + len(model.start)]):
                leaf = tree.leaves(x)
                for k in np.unique(leaf):
                    n = counts * (leaf == k)
                    assert tree.values[k][c] == pytest.approx(-0.1 * (n * g[:, c]).sum() / ((n * h[:, c]).sum() + 1), abs=1e-9)
                margins = margins + np.array(tree.values)[leaf]


def test_collapsing_keeps_leaf_sizes_and_null_labels(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 15, 1.0).otherwise(2.0).alias("x"), (F.col("id") < 15).cast("double").alias("y"))
    model = models.fit(rows, "y", "regression", "gbt_b", ["id"], ["id"], num_iterations=1)  # leaves of 20 rows
    assert model.score(rows, ["id"]).select("prediction").distinct().count() == 1
    model = models.fit(rows.where("id < 35").unionByName(rows.where("id < 5")), "y", "regression", "gbt_b", ["id"], ["id"], num_iterations=1)
    assert model.score(rows, ["id"]).select("prediction").distinct().count() == 2
    holes = rows.withColumn("y", F.when(F.col("id") != 3, F.col("y")))
    with pytest.raises(Exception, match="(?i)null"):
        models.fit(holes, "y", "regression", "gbt_a", ["id"], ["id"], iterations=1)


def test_training_reads_texts_and_digests_once(spark):
    """The counts of texts, and rows with their split digest, are read from what was written once."""
    folder = "/root/testdata/sf0.001"
    counted = model_queries._documents(spark, folder)
    assert not any("documents" in f for f in counted.inputFiles())
    plain = train_test_split(counted, 0.3, ["doc_id"])
    stored = train_test_split(counted, 0.3, ["doc_id"], store=True)
    for one, two in zip(plain, stored):
        assert one.count() == two.count() and one.exceptAll(two).count() == 0
    assert not set(stored[0].inputFiles()) & set(counted.inputFiles())
