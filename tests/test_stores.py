import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import rollup
from tablewright.sources import experience, files, predictions, tables


def test_list_files(spark, tmp_path):
    (tmp_path / "apples.csv").write_text("kind,weight\nred,12\n")
    (tmp_path / "pears.csv").write_text("kind\n")
    (tmp_path / "notes.md").write_text("nothing")
    (tmp_path / "older").mkdir()
    (tmp_path / "older" / "plums.csv").write_text("k\n")
    found = files.list_files(spark, str(tmp_path)).orderBy("name").collect()
    assert [r["name"] for r in found] == ["apples.csv", "pears.csv"]
    assert found[0]["size_bytes"] == 19 and found[0]["extension"] == ".csv"
    assert found[0]["parent"].endswith(str(tmp_path))
    assert files.list_files(spark, str(tmp_path), recursive=True).count() == 3


def test_catalogue_of_a_run_below_a_misleading_folder(spark, tmp_path):
    run = tmp_path / "model_x" / "run"
    for name in ("model_1/part", "predictions_1/part", "notes.txt", "sub/model_2"):
        (run / name).parent.mkdir(parents=True, exist_ok=True)
        (run / name).write_text("x")
    rows = files.catalog_run(spark, "r", str(run), str(run / "predictions_1"), "done").collect()
    kinds = sorted((r["kind"], r["path"].rsplit("/run/", 1)[-1]) for r in rows)
    assert kinds == [
        ("final_predictions", "predictions_1/part"),
        ("model", "model_1/part"),
        ("predictions", "predictions_1/part"),
        ("report", ""),
    ]


def test_csv_keeps_text(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, ""), (4, None), (5, " pad "), (6, "a\\b\"\",\r\nc")]
    df = spark.createDataFrame(rows, "id int, t string")
    path = tables.write_table(df, str(tmp_path / "t.csv"))
    for back in (
        tables.read_table(spark, path),
        tables.read_table(spark, path, schema=df.schema),
        tables.read_csv(spark, path),
    ):
        assert sorted(map(tuple, back.collect())) == rows and dict(back.dtypes)["id"] == "int"
    bad = tmp_path / "bad.csv"
    bad.write_text("v\n1\n2,x\nword\n")
    with pytest.raises(Exception, match="MALFORMED"):
        tables.read_table(spark, str(bad), schema="v int").collect()


def test_hits_have_a_similarity(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None), ("e", [1.0, 1.0])],
        "entry_id string, embedding array<float>",
    )
    assert [r["entry_id"] for r in experience.similar(df, [1.0, 0.0]).collect()] == ["a", "e"]


def test_read_and_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "i int, x double, c string")
    path = tables.write_table(df, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [
        (1, 2.5, "a"),
        (2, None, "b"),
    ]
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        tables.as_dataframe(spark, str(tmp_path / "none.parquet"))
    assert tables.as_dataframe(spark, pd.DataFrame({"i": [1, 2]})).count() == 2
    assert tables.as_dataframe(spark, df) is df


def test_types_from_the_first_rows(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("n\n" + "\n".join(["1"] * 20 + ["x"]) + "\n")
    assert dict(tables.read_csv(spark, str(path), 100).dtypes) == {"n": "string"}
    early = tables.read_csv(spark, str(path), 5)
    assert dict(early.dtypes) == {"n": "int"}
    with pytest.raises(Exception, match="MALFORMED"):
        early.collect()
    with pytest.raises(ValueError, match="infer_rows"):
        tables.read_csv(spark, str(path), 0)


def test_preview(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "x bigint")
    assert [r["x"] for r in tables.preview(df, 3, ["x"]).collect()] == [1, 2, 3]
    assert tables.preview(df, 50).count() == 5
    with pytest.raises(ValueError, match="positive"):
        tables.preview(df, 0)


def test_prediction_tables(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.createDataFrame([(1, 0), (2, 1)], "row_id int, prediction int")
    run = predictions.write_predictions(one, path, "gbt_a")
    predictions.write_predictions(one, path, "gbt_b")
    assert predictions.read_predictions(spark, path).count() == 4
    assert predictions.read_predictions(spark, path, run, "gbt_a").count() == 2
    with pytest.raises(ValueError, match="not a prediction table"):
        predictions.extract_predictions(one.drop("prediction"))


def entries(spark, rows):
    return spark.createDataFrame(
        rows,
        "document string, embedding array<float>, task_type string, iteration int, score double, "
        "rubric_scores map<string,double>, feedback string, accepted boolean",
    )


def test_store(spark, tmp_path):
    store = experience.ExperienceStore(spark, str(tmp_path / "store"))
    actor, critic = store.retrieve([1.0, 0.0], "classification")
    assert actor.count() == 0 and critic.count() == 0
    store.append(
        entries(
            spark,
            [
                ("near", [1.0, 0.1], "classification", 1, 0.9, {"results": 0.9}, "good", True),
                ("far", [-1.0, 0.0], "classification", 2, 0.2, {}, "bad", None),
                ("other", [1.0, 0.0], "regression", 1, 0.5, {}, "fine", False),
            ],
        )
    )
    actor, critic = store.retrieve([1.0, 0.0], "classification", 1)
    assert tuple(actor.first()) == (1, True, "near", "good")
    assert tuple(critic.first()) == (1, 0.9, "near", "good")
    assert store.retrieve([1.0, 0.0], "classification", 5)[0].count() == 2
    assert store.entries().select("entry_id").distinct().count() == 3
    store.clear()
    assert store.entries().count() == 0
    with pytest.raises(ValueError, match="k must be"):
        experience.similar(store.entries(), [1.0], 0)


def test_evaluations_without_stored_score_or_with_broken_json(spark):
    good = '{"score": 0.4, "rubric_scores": {}, "feedback": "ok"}'
    data = [(good, None, None), (good, 0.7, True), ("not json", 0.1, True), ('{"score": 1}', 0.1, True)]
    df = spark.createDataFrame(
        data, "critic_evaluation string, critic_score double, accepted boolean"
    )
    parsed = experience.parse_evaluations(df).select("score", "was_accepted", "feedback").collect()
    assert sorted(map(tuple, parsed)) == [(0.4, False, "ok"), (0.7, True, "ok")]


def test_report_and_rubric(spark):
    df = spark.createDataFrame(
        [("a", "b", "c", "d", {"x": 0.5, "y": 1.0}), ("a", "b", "c", None, {})],
        "p string, q string, r string, s string, m map<string,double>",
    )
    text = experience.report_text(*[F.col(c) for c in "pqrs"])
    out = df.select(text.alias("t"), experience.rubric_score(F.col("m"), F.lit(0.3)).alias("v"))
    first, second = out.collect()
    assert first["t"] == "# Data Analysis\na\n\n# Preprocessing\nb\n\n# Model Training\nc\n\n# Results\nd"
    assert second["t"].endswith("# Results\n")
    assert (first["v"], second["v"]) == (0.75, 0.3)


def test_token_cost(spark):
    usage = spark.createDataFrame(
        [
            ("acme/large", 2000, 300),
            ("homegrown", 70, 20),
            ("other/small", 40, 60),
            ("acme/large", None, None),
            ("x/y/z", 30, 0),
            (None, 10, 10),
        ],
        "model string, input_tokens int, output_tokens int",
    )
    prices = spark.createDataFrame(
        [("acme", "large", 2.0, 20.0), ("x", "y/z", 50.0, 1.0)],
        "provider string, name string, input_price double, output_price double",
    )
    costs = [(r["model"], r["total_tokens"], r["total_cost"]) for r in rollup.token_cost(usage, prices).collect()]
    assert ("acme/large", 2300, pytest.approx(0.01)) in costs
    assert ("homegrown", 90, 0.0) in costs and ("other/small", 100, 0.0) in costs
    assert ("acme/large", 0, 0.0) in costs and ("x/y/z", 30, pytest.approx(0.0015)) in costs
    assert (None, 20, 0.0) in costs


def test_bench_roll_up(spark):
    data = [
        ("iris", "success", None, 0.9, 0.8, 100, 60, 1.0, 0.5, 10.0),
        ("wine", "success", None, 0.7, 0.6, 300, 100, 3.0, 1.5, 30.0),
        ("lost", "error", "no data", 0.0, 0.0, 0, 0, 0.0, 0.0, 1.0),
    ]
    results = spark.createDataFrame(
        data,
        "task_name string, status string, error_message string, accuracy double, f1_score double, "
        "total_tokens bigint, actor_total_tokens bigint, total_cost double, "
        "actor_total_cost double, runtime_seconds double",
    )
    row = rollup.bench_summary(results).first()
    assert (row["completed"], row["failed"]) == (2, 1)
    assert row["mean_accuracy"] == pytest.approx(0.8) and row["min_accuracy"] == 0.7
    assert row["total_tokens"] == 400 and row["avg_cost"] == 2.0 and row["max_runtime"] == 30.0
    assert rollup.bench_summary(results, ["iris"]).first()["completed"] == 1
    with pytest.raises(ValueError, match="none of these tasks"):
        rollup.bench_summary(results, ["unknown"])
    assert [tuple(r) for r in rollup.failed_tasks(results).collect()] == [("lost", "no data")]


def test_iterations(spark):
    log = spark.createDataFrame(
        [(1, 1, 0.4), (1, 2, 0.8), (1, 3, 0.9), (2, 1, 0.5), (2, 2, 0.3)],
        "run_id int, iteration int, score double",
    )
    done = {r["run_id"]: r for r in rollup.iteration_outcome(log).collect()}
    assert done[1]["final_iteration"] == 2 and done[1]["accepted"]
    history = sorted((r["run_id"], r["score"]) for r in rollup.score_history(log).collect())
    assert history == [(1, 0.4), (1, 0.8), (2, 0.3), (2, 0.5)]
    assert not done[2]["accepted"] and done[2]["final_score"] == 0.3
    best = {r["run_id"]: r["best_iteration"] for r in rollup.best_iteration(log).collect()}
    assert best == {1: 3, 2: 1}


def test_dataset_facts(spark):
    df = spark.createDataFrame([(1, 2, "a"), (3, 4, "b"), (5, 6, "a")], "x int, y int, t string")
    assert tuple(rollup.dataset_facts(df, "t").first()) == (3, 2, 2)
