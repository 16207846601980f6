"""Registered queries: metrics, models, blends and the training loop."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import one_row
from tablewright.operators import blend as blending
from tablewright.operators import metrics, models, tuning
from tablewright.operators.encode import LabelEncoding
from tablewright.operators.split import train_test_split
from tablewright.plans.automl import Recipe, automl_loop
from tablewright.plans.registry import query, rounded, table
from tablewright.session import materialise, scratch_path
from tablewright.sources import files, runs
from tablewright.sources import models as model_files
from tablewright.sources import predictions as prediction_files

# ---- metrics ---------------------------------------------------------------

_BINARY = "scored AS (SELECT doc_id, quality AS label, toxic AS prediction FROM labels)"
_FLAGS = """scored AS (SELECT l_returnflag AS label,
  CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity < 30 THEN 'N' WHEN l_quantity < 45 THEN 'R'
       ELSE 'X' END AS prediction FROM lineitem)"""
_CONTINUOUS = """scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  l_extendedprice / 2 + CASE WHEN l_returnflag = 'R' THEN 9000 ELSE 0 END AS prediction
  FROM lineitem)"""
_REGRESSION = """scored AS (SELECT l_extendedprice AS label, l_quantity * 2000 AS prediction
  FROM lineitem)"""
_CLASSES = """cells AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2),
classes AS (SELECT class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
  SELECT label AS class, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, n AS support,
    0 AS predicted FROM cells
  UNION ALL SELECT prediction, 0, 0, n FROM cells) GROUP BY class),
measured AS (SELECT class, tp, support,
  CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END::DOUBLE AS f1
  FROM classes)"""


def binary(spark, folder) -> DataFrame:
    return table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )


def flags(spark, folder) -> DataFrame:
    quantity = F.col("l_quantity")
    guess = (
        F.when(quantity < 10, "A").when(quantity < 30, "N").when(quantity < 45, "R").otherwise("X")
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("label"), guess.alias("prediction")
    )


def continuous(spark, folder) -> DataFrame:
    hit = F.col("l_returnflag") == "R"
    return table(spark, folder, "lineitem").select(
        hit.cast("int").alias("label"),
        (F.col("l_extendedprice") / 2 + F.when(hit, 9000).otherwise(0)).alias("prediction"),
    )


def regression(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction")
    )


@query(
    f"""WITH {_FLAGS} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6)::DOUBLE
    AS accuracy, count(CASE WHEN label = prediction THEN 1 END) AS correct, count(*) AS total
    FROM scored"""
)
def accuracy(spark, folder):
    return rounded(metrics.accuracy(flags(spark, folder)))


@query(
    f"WITH {_FLAGS}, {_CLASSES} SELECT round(sum(f1 * support) / sum(support), 6)::DOUBLE AS f1 "
    "FROM measured"
)
def weighted_f1(spark, folder):
    return rounded(metrics.weighted_f1(flags(spark, folder)))


@query(
    f"WITH {_BINARY}, {_CLASSES} SELECT round(CASE WHEN count(*) = 2 AND min(support) > 0 "
    "THEN avg(recall) END, 6)::DOUBLE AS roc_auc FROM measured"
)
def roc_auc_hard_labels(spark, folder):
    return rounded(metrics.hard_roc_auc(binary(spark, folder)))


_AUC = """per_score AS (SELECT prediction AS s, count(CASE WHEN label = 1 THEN 1 END) AS p,
  count(CASE WHEN label = 0 THEN 1 END) AS q FROM scored GROUP BY 1),
ranked AS (SELECT *, coalesce(sum(p) OVER (ORDER BY s DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM per_score)
SELECT round(sum(q * (above + p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)), 6)::DOUBLE AS roc_auc
FROM ranked"""


@query(f"WITH {_CONTINUOUS}, {_AUC}")
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(continuous(spark, folder)))


@query(
    f"""WITH {_REGRESSION} SELECT round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse,
    round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 6) AS r2,
    round(avg(abs(label - prediction)), 6) AS mae FROM scored"""
)
def regression_metrics(spark, folder):
    return rounded(metrics.regression_metrics(regression(spark, folder)))


@query(f"WITH {_REGRESSION} SELECT round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse FROM scored")
def rmse(spark, folder):
    return rounded(metrics.rmse(regression(spark, folder)))


@query(
    f"""WITH {_REGRESSION} SELECT
    round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 6) AS r2 FROM scored"""
)
def r2(spark, folder):
    return rounded(metrics.r2(regression(spark, folder)))


@query(f"WITH {_REGRESSION} SELECT round(avg(abs(label - prediction)), 6) AS mae FROM scored")
def mae(spark, folder):
    return rounded(metrics.mae(regression(spark, folder)))


@query(
    f"""WITH {_FLAGS}, {_CLASSES}
    SELECT 'class' AS kind, class, round(precision, 6)::DOUBLE AS precision,
      round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support::BIGINT AS support
    FROM measured
    UNION ALL SELECT 'macro avg', 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
      round(avg(f1), 6), sum(support)::BIGINT FROM measured
    UNION ALL SELECT 'weighted avg', 'weighted avg',
      round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM measured"""
)
def classification_report(spark, folder):
    return rounded(metrics.classification_report(flags(spark, folder)))


@query(
    f"""WITH {_BINARY}, {_CLASSES} SELECT round(sum(tp) / sum(support), 6)::DOUBLE AS accuracy,
    round(sum(f1 * support) / sum(support), 6)::DOUBLE AS f1,
    round(sum(precision * support) / sum(support), 6)::DOUBLE AS precision,
    round(sum(recall * support) / sum(support), 6)::DOUBLE AS recall,
    round(CASE WHEN count(*) = 2 AND min(support) > 0 THEN avg(recall) END, 6)::DOUBLE AS roc_auc
    FROM measured"""
)
def classification_metrics(spark, folder):
    return rounded(metrics.classification_metrics(binary(spark, folder)))


@query(
    """SELECT doc_id, quality::VARCHAR AS label, toxic::VARCHAR AS prediction FROM labels"""
)
def harmonise_labels(spark, folder):
    return metrics.harmonise_labels(binary(spark, folder))


@query(
    """SELECT event_id, CASE WHEN value / 20 > 0.5 THEN 1 ELSE 0 END AS prediction FROM events"""
)
def threshold(spark, folder):
    events = table(spark, folder, "events")
    scored = events.select("event_id", (F.col("value") / 20).alias("prediction"))
    return metrics.thresholded(scored)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def split_features(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    )
    return models.split_xy(orders, "o_orderstatus")[0]


# ---- blends ----------------------------------------------------------------

_BLEND = """aligned AS (SELECT o_orderkey AS id, o_totalprice AS label,
  o_totalprice * 0.9::DOUBLE + o_custkey AS p0, o_totalprice + (o_orderkey % 1000) * 20 AS p1,
  150000.0::DOUBLE AS p2, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS big,
  (o_totalprice % 1000) / 1000 AS s0, o_totalprice / 500000 AS s1 FROM orders)"""


def _blend_inputs(spark, folder) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("id"),
        price.alias("label"),
        (price * 0.9 + F.col("o_custkey")).alias("p0"),
        (price + (key % 1000) * 20).alias("p1"),
        F.lit(150000.0).alias("p2"),
        (price > 250000).cast("int").alias("big"),
        ((price % 1000) / 1000).alias("s0"),
        (price / 500000).alias("s1"),
    )


def _prediction(inputs: DataFrame, name: str) -> DataFrame:
    return inputs.select("id", F.col(name).alias("prediction"))


@query(
    f"""WITH {_BLEND} SELECT id, round(p0 * 0.5::DOUBLE + p1 * 0.3::DOUBLE + p2 * 0.2::DOUBLE, 4)
    AS prediction FROM aligned"""
)
def blend(spark, folder):
    inputs = _blend_inputs(spark, folder)
    parts = [_prediction(inputs, c) for c in ("p0", "p1", "p2")]
    return rounded(blending.blend(parts, [5, 3, 2], "id"), 4)


@query(
    "SELECT o_orderkey AS id, round(o_totalprice + 3.0::DOUBLE * o_custkey, 4) "
    "AS prediction FROM orders"
)
def blend_seven(spark, folder):
    # seven inputs: price + 0 .. 6 times the customer, equal weights
    orders = table(spark, folder, "orders")
    parts = [
        orders.select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_totalprice") + i * F.col("o_custkey")).alias("prediction"),
        )
        for i in range(7)
    ]
    return rounded(blending.blend(parts, [1.0] * 7, "id"), 4)


_TRIALS = 100


def _candidates(k: int) -> str:
    rows = ", ".join(
        f"({t}, " + ", ".join(f"'{w!r}'::DOUBLE" for w in weights) + ")"
        for t, weights in enumerate(blending.candidate_weights(k, _TRIALS))
    )
    names = ", ".join(f"w{i}" for i in range(k))
    return f"candidates(trial, {names}) AS (VALUES {rows})"


def _search(spark, folder, task_type: str):
    inputs = _blend_inputs(spark, folder)
    if task_type == "regression":
        names, target = ("p0", "p1", "p2"), "label"
    else:
        names, target = ("s0", "s1"), "big"
    parts = [_prediction(inputs, c) for c in names]
    labels = inputs.select("id", F.col(target).alias("truth"))
    return blending.search_blend(parts, labels, "truth", task_type, "id", _TRIALS)


_REGRESSION_TRIALS = f"""WITH {_BLEND}, {_candidates(3)}, scored AS (SELECT trial, w0, w1, w2,
  avg((p0 * w0 + p1 * w1 + p2 * w2 - label) ** 2) AS objective
  FROM aligned, candidates GROUP BY ALL)"""
_CLASS_TRIALS = f"""WITH {_BLEND}, {_candidates(2)}, scored AS (SELECT trial, w0, w1,
  -avg(CASE WHEN (s0 * w0 + s1 * w1 > 0.5) = (big = 1) THEN 1.0::DOUBLE ELSE 0.0 END) AS objective
  FROM aligned, candidates GROUP BY ALL)"""


@query(f"{_REGRESSION_TRIALS} SELECT trial::INTEGER AS trial, round(objective, 0) AS objective FROM scored")
def search_blend_regression(spark, folder):
    return rounded(_search(spark, folder, "regression").trials, 0)


@query(f"{_CLASS_TRIALS} SELECT trial::INTEGER AS trial, round(objective, 6) AS objective FROM scored")
def search_blend_classification(spark, folder):
    return rounded(_search(spark, folder, "classification").trials)


@query(
    f"""{_CLASS_TRIALS}, best AS (SELECT w0, w1 FROM scored ORDER BY objective, trial LIMIT 1)
    SELECT id, round(s0 * w0 + s1 * w1, 6) AS prediction FROM aligned, best"""
)
def blended_predictions(spark, folder):
    return rounded(_search(spark, folder, "classification").predictions)


@query(
    f"""{_REGRESSION_TRIALS}, best AS (SELECT w0, w1, w2 FROM scored ORDER BY objective, trial LIMIT 1),
    mixed AS (SELECT label, p0 * w0 + p1 * w1 + p2 * w2 AS prediction FROM aligned, best)
    SELECT round(sqrt(avg((label - prediction) ** 2)), 4) AS rmse,
    round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 4) AS r2,
    round(avg(abs(label - prediction)), 4) AS mae FROM mixed"""
)
def blend_metrics(spark, folder):
    return rounded(_search(spark, folder, "regression").metrics, 4)


@query(
    """WITH voters AS (SELECT l_orderkey, l_linenumber, l_returnflag AS a, l_linestatus AS b,
      CASE WHEN l_quantity > 25 THEN 'N' ELSE 'O' END AS c FROM lineitem),
    sides AS (SELECT *, CASE WHEN a = b THEN 0.7::DOUBLE ELSE 0.4 END + CASE WHEN a = c THEN 0.35::DOUBLE ELSE 0 END AS sa,
      0.3::DOUBLE + CASE WHEN a = b THEN 0.4 ELSE 0 END + CASE WHEN b = c THEN 0.35 ELSE 0 END AS sb,
      0.35::DOUBLE + CASE WHEN a = c THEN 0.4 ELSE 0 END + CASE WHEN b = c THEN 0.3 ELSE 0 END AS sc FROM voters)
    SELECT CASE WHEN sa >= sb AND sa >= sc THEN a WHEN sb >= sc THEN b ELSE c END AS vote,
      count(*) AS n FROM sides GROUP BY 1"""
)
def blend_vote(spark, folder):
    votes = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("p0"),
        F.col("l_linestatus").alias("p1"),
        F.when(F.col("l_quantity") > 25, "N").otherwise("O").alias("p2"),
    )
    winner = blending.weighted_vote([0.4, 0.3, 0.35], 3)
    return votes.select(winner.alias("vote")).groupBy("vote").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_BLEND}, measured AS (
      SELECT 'p0' AS model, sqrt(avg((label - p0) ** 2)) AS rmse FROM aligned UNION ALL
      SELECT 'p1', sqrt(avg((label - p1) ** 2)) FROM aligned UNION ALL
      SELECT 'p2', sqrt(avg((label - p2) ** 2)) FROM aligned)
    SELECT model, round(rmse, 4) AS rmse FROM measured ORDER BY rmse, model LIMIT 1"""
)
def select_best(spark, folder):
    inputs = _blend_inputs(spark, folder)
    measured = [
        metrics.rmse(inputs, "label", name).select(F.lit(name).alias("model"), "rmse")
        for name in ("p0", "p1", "p2")
    ]
    together = measured[0].unionByName(measured[1]).unionByName(measured[2])
    return rounded(models.select_best(together, "model", "rmse", larger_is_better=False), 4)


# ---- prediction tables -----------------------------------------------------


@query("SELECT event_id, value AS prediction, 'plain' AS model FROM events")
def prediction_round_trip(spark, folder):
    path = scratch_path(spark, "predictions")
    events = table(spark, folder, "events")
    kept = events.select("event_id", F.col("value").alias("prediction"))
    run = prediction_files.write_predictions(kept, path, "plain")
    prediction_files.write_predictions(kept.withColumn("prediction", -F.col("prediction")), path, "minus")
    back = prediction_files.read_predictions(spark, path, run_id=run, model="plain")
    return back.select("event_id", "prediction", "model")


# ---- models ----------------------------------------------------------------


def _documents(spark, folder, labelled: bool = True) -> DataFrame:
    """Documents with a few counts of their text, language as a code, and their label;
    those without a label too if asked.  Written once, for training reads them many times
    and would count the texts anew each time."""
    text = F.col("text")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    documents = table(spark, folder, "documents").join(labels, "doc_id", "inner" if labelled else "left")
    counted = documents.select(
        "doc_id",
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" ")))).alias("n_spaces"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n")))).alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^\p{Punct}]", "")).alias("n_marks"),
        "quality",
    )
    counted = materialise(counted)
    return materialise(LabelEncoding.fit(counted, ["lang"]).transform(counted))


def _trained(spark, folder, family: str, **options):
    train, test = train_test_split(_documents(spark, folder), 0.3, ["doc_id"])
    return models.train(train, test, "quality", "classification", ["doc_id"], family, **options)


def _ranked_sql(source: str, key: str) -> str:
    """Rows of a source with their place in the order of the split, test part last."""
    digest = f"md5('42:' || length({key}::VARCHAR) || '=' || {key})"
    return (
        f"SELECT *, row_number() OVER (ORDER BY {digest}) AS rn, count(*) OVER () AS n FROM ({source})"
    )


_SPLIT_DOCS = f"WITH d AS ({_ranked_sql('SELECT * FROM documents JOIN labels USING (doc_id)', 'doc_id')})"
_IN_TEST = "rn > n - floor(n * 0.3::DOUBLE)"


def first_leaf(booster, df: DataFrame):
    """Leaf of the first tree that a row falls into, as built-in expressions."""
    tree = booster.trees[0]

    def at(node: int):
        if tree.feature[node] < 0:
            return F.lit(tree.leaf[node])
        goes = F.col(booster.features[tree.feature[node]]) <= tree.threshold[node]
        return F.when(goes, at(tree.left[node])).otherwise(at(tree.right[node]))

    return at(0)


def _checked(metrics, scored: DataFrame, n: str) -> DataFrame:
    """One row: rows scored, whether the reported accuracy is that of the predictions,
    and whether it reaches that of always answering with the largest class."""
    hit = F.avg((F.col("prediction") == F.col("quality")).cast("double"))
    most = F.greatest(F.avg(F.col("quality").cast("double")), 1 - F.avg(F.col("quality").cast("double")))
    counted = scored.agg(F.count(F.lit(1)).alias(n), hit.alias("own"), most.alias("most"))
    return one_row([counted, metrics.select("accuracy")]).select(
        n,
        (F.abs(F.col("own") - F.col("accuracy")) < 1e-9).alias("metric_agrees"),
        (F.col("accuracy") >= F.col("most") - 1e-9).alias("beats_majority"),
    )


@query(f"{_SPLIT_DOCS} SELECT doc_id, TRUE AS known_class FROM d WHERE {_IN_TEST}")
def train_gbt_a(spark, folder):
    result = _trained(spark, folder, "gbt_a", iterations=10, depth=4, subsample=0.9)
    return result.predictions.select("doc_id", F.col("prediction").isin(0, 1).alias("known_class"))


@query(
    f"{_SPLIT_DOCS} SELECT count(*) AS n_test, TRUE AS metric_agrees, TRUE AS beats_majority "
    f"FROM d WHERE {_IN_TEST}"
)
def train_gbt_b(spark, folder):
    result = _trained(spark, folder, "gbt_b", num_iterations=10, max_depth=4)
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return _checked(result.test_metrics, result.predictions.join(labels, "doc_id"), "n_test")


@query(
    f"{_SPLIT_DOCS} SELECT count(*) AS n_train, TRUE AS metric_agrees, TRUE AS beats_majority "
    f"FROM d WHERE NOT ({_IN_TEST})"
)
def train_gbt_c(spark, folder):
    train, test = train_test_split(_documents(spark, folder), 0.3, ["doc_id"])
    result = models.train(
        train, test, "quality", "classification", ["doc_id"], "gbt_c",
        n_estimators=10, max_depth=4, colsample_bytree=0.8,
    )
    return _checked(result.train_metrics, result.model.score(train, ["doc_id"], ["quality"]), "n_train")


@query(
    f"{_SPLIT_DOCS} SELECT count(*) AS n_test, TRUE AS metric_agrees, TRUE AS beats_majority, "
    f"TRUE AS leaves_agree FROM d WHERE {_IN_TEST}"
)
def train_penalised(spark, folder):
    """100 rounds with L1 and L2 penalties; the leaves of the first tree recomputed from their rows."""
    l1, l2, rate = 0.5, 2.0, 0.1
    train, test = train_test_split(_documents(spark, folder), 0.3, ["doc_id"])
    result = models.train(
        train, test, "quality", "classification", ["doc_id"], "gbt_b",
        max_depth=3, reg_alpha=l1, reg_lambda=l2, learning_rate=rate,
    )
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    booster = result.model.booster
    # before the first round all rows have the same margin
    share = 1 / (1 + math.exp(-booster.start[0]))
    leaf = first_leaf(booster, train)
    pull = F.sum(F.lit(share) - F.col("quality"))
    value = -rate * F.signum(pull) * F.greatest(F.abs(pull) - l1, F.lit(0.0)) / (F.count(F.lit(1)) * share * (1 - share) + l2)
    held = F.get(F.array(*[F.lit(v[0]) for v in booster.trees[0].values]), F.col("leaf"))
    agree = train.select(leaf.alias("leaf"), "quality").groupBy("leaf").agg(value.alias("own"))
    agree = agree.agg(F.bool_and(F.abs(F.col("own") - held) < 1e-9).alias("leaves_agree"))
    checked = _checked(result.test_metrics, result.predictions.join(labels, "doc_id"), "n_test")
    return one_row([checked, agree])


@query(f"{_SPLIT_DOCS} SELECT doc_id, quality, TRUE AS summary_agrees FROM d WHERE {_IN_TEST}")
def train_run(spark, folder):
    """Predictions with truth of a written run, and whether its summary is that of these rows."""
    train, test = train_test_split(_documents(spark, folder), 0.3, ["doc_id"])
    place = scratch_path(spark, "runs")
    run_id, _ = runs.train_run(
        train, test, "quality", "classification", ["doc_id"], place, family="gbt_a", iterations=20, depth=4
    )
    scored = runs.read_run(spark, place, run_id, "scored")
    told = runs.read_run(spark, place, run_id, "summary").where("part = 'test' AND metric = 'accuracy'")
    own = scored.agg(F.avg((F.col("prediction") == F.col("quality")).cast("double")).alias("own"))
    agrees = abs(own.first()["own"] - told.first()["value"]) < 1e-9
    return scored.select("doc_id", "quality", F.lit(agrees).alias("summary_agrees"))


def _numbers(spark, folder, *names: str) -> DataFrame:
    key = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("string")
    )
    return table(spark, folder, "lineitem").select(
        key.alias("row_id"), "l_quantity", "l_discount", "l_tax", "l_linenumber", *names
    )


@query(
    "SELECT l_returnflag, floor(count(*) * 0.3::DOUBLE)::BIGINT AS n, TRUE AS known_class "
    "FROM lineitem GROUP BY 1"
)
def train_multiclass(spark, folder):
    numbers = _numbers(spark, folder, "l_returnflag")
    train, test = train_test_split(numbers, 0.3, ["row_id"], stratify="l_returnflag", store=True)
    result = models.train(
        train, test, "l_returnflag", "classification", ["row_id"], "gbt_a", iterations=20, depth=3
    )
    scored = result.model.score(test, ["row_id"], ["l_returnflag"])
    return scored.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction").isin("A", "N", "R")).alias("known_class")
    )


_ROW_ID = (
    "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS row_id FROM lineitem"
)


@query(
    f"WITH d AS ({_ranked_sql(_ROW_ID, 'row_id')}) SELECT row_id, TRUE AS is_number FROM d WHERE {_IN_TEST}"
)
def train_regression(spark, folder):
    numbers = _numbers(spark, folder, "l_extendedprice")
    train, test = train_test_split(numbers, 0.3, ["row_id"], store=True)
    unlabelled = test.drop("l_extendedprice")  # production mode: nothing to measure
    result = models.train(
        train, unlabelled, "l_extendedprice", "regression", ["row_id"], "gbt_b",
        num_iterations=5, max_depth=4,
    )
    number = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    return result.predictions.select("row_id", number.alias("is_number"))


@query("SELECT doc_id, TRUE AS same FROM documents")
def model_round_trip(spark, folder):
    """The saved model scores every document as the live one does."""
    result = _trained(spark, folder, "gbt_a", iterations=3, depth=3)
    path = model_files.save_model(result.model, scratch_path(spark, "models"))
    loaded = model_files.load_model(spark, path)
    everything = _documents(spark, folder, labelled=False)
    one, two = (m.score(everything, ["doc_id"], probability=True) for m in (result.model, loaded))
    two = two.select("doc_id", F.col("prediction").alias("p"), F.col("probability").alias("q"))
    same = F.col("prediction").eqNullSafe(F.col("p")) & F.col("probability").eqNullSafe(F.col("q"))
    return one.join(two, "doc_id").select("doc_id", same.alias("same"))


_NULLS = """aligned AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS label,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * 0.9::DOUBLE + o_custkey END AS p0,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice + (o_orderkey % 1000) * 20 END AS p1 FROM orders)"""


def _blend_inputs_with_nulls(spark, folder) -> DataFrame:
    key = F.col("id")
    return _blend_inputs(spark, folder).select(
        "id",
        F.when(key % 11 != 0, F.col("label")).alias("truth"),
        F.when(key % 7 != 0, F.col("p0")).alias("p0"),
        F.when(key % 5 != 0, F.col("p1")).alias("p1"),
    )


@query(
    f"""WITH {_NULLS} SELECT w.trial::INTEGER AS trial,
    round(avg((w.w0 * (p0 - label) + w.w1 * (p1 - label)) ** 2) / 1e6, 4) AS objective,
    count(*) AS known FROM aligned, (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.5, 0.5), (2, 0.2, 0.8)) AS w(trial, w0, w1)
    WHERE label IS NOT NULL AND p0 IS NOT NULL AND p1 IS NOT NULL GROUP BY 1"""
)
def blend_nulls(spark, folder):
    """Every candidate is judged on the rows that all inputs and the label have."""
    inputs = _blend_inputs_with_nulls(spark, folder)
    aligned = blending.align(
        [_prediction(inputs, p) for p in ("p0", "p1")], "id", inputs.select("id", "truth"), "truth"
    )
    scores = blending.score_candidates(aligned, [[1.0, 0.0], [0.5, 0.5], [0.2, 0.8]], "regression", 2)
    known = blending.error_products(aligned, 2)[1]
    return scores.select("trial", F.round(F.col("objective") / 1e6, 4).alias("objective"), F.lit(known).alias("known"))


@query(
    f"""WITH {_NULLS}, g AS (SELECT avg((p0 - label) ** 2) AS a, avg((p1 - label) ** 2) AS b,
      avg((p0 - label) * (p1 - label)) AS c FROM aligned WHERE label IS NOT NULL AND p0 IS NOT NULL AND p1 IS NOT NULL),
    best AS (SELECT *, greatest(0, least(1, (b - c) / (a + b - 2 * c))) AS w FROM g)
    SELECT round(w, 6) AS weight, round(sqrt(w * w * a + 2 * w * (1 - w) * c + (1 - w) * (1 - w) * b), 4) AS rmse FROM best"""
)
def blend_optimum(spark, folder):
    """Weight of the first of two inputs at the least squared error, and that error."""
    inputs = _blend_inputs_with_nulls(spark, folder)
    found = blending.optimal_blend(
        [_prediction(inputs, p) for p in ("p0", "p1")], inputs.select("id", "truth"), "truth", "id"
    )
    error = F.sqrt(F.col("objective"))
    return found.trials.select(F.round(F.lit(found.weights[0]), 6).alias("weight"), F.round(error, 4).alias("rmse"))


@query()
def run_catalog(spark, folder):
    folder_out = scratch_path(spark, "run")
    result = _trained(spark, folder, "gbt_a", iterations=2, depth=2)
    model_files.save_model(result.model, folder_out)
    result.predictions.write.parquet(f"{folder_out}/predictions_gbt_a")
    return files.catalog_run(
        spark, "run", folder_out, f"{folder_out}/predictions_gbt_a", "# Results\nfinished"
    )


_FOLD = "('0x' || substr(md5('42:' || length(o_orderkey::VARCHAR) || '=' || o_orderkey), 1, 8))::BIGINT % 5"


@query(f"SELECT o_orderkey, ({_FOLD})::INTEGER AS fold FROM orders")
def cross_validation_folds(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return models.cross_validation_folds(orders, ["o_orderkey"], 5)


@query()
def cross_validate(spark, folder):
    return models.cross_validate(
        _documents(spark, folder), "quality", "classification", ["doc_id"], 2, "gbt_a",
        iterations=3, depth=3,
    )


@query()
def tune(spark, folder):
    train, valid = train_test_split(_documents(spark, folder), 0.3, ["doc_id"])
    grid = [{"iterations": 2, "depth": 2}, {"iterations": 3, "depth": 3}]
    return models.tune(train, valid, "quality", "classification", ["doc_id"], grid)


_KEY = "length(doc_id::VARCHAR) || '=' || doc_id"
_RACE_SQL = f"""
WITH learnt AS (
  SELECT ('0x' || substr(md5('43:' || {_KEY}), 1, 8))::BIGINT AS place
  FROM documents JOIN labels USING (doc_id)
  WHERE ('0x' || substr(md5('42:' || {_KEY}), 1, 8))::BIGINT % 5 <> 0),
rungs (rung, trials, divisor, rounds, kept) AS (VALUES (0, 16, 16, 2, 4), (1, 4, 4, 8, 1), (2, 1, 1, 32, 1))
SELECT rung, trials, (SELECT count(*) FROM learnt WHERE place < 4294967296 // divisor) AS rows, rounds, kept,
  TRUE AS best_kept
FROM rungs"""


@query(_RACE_SQL)
def tune_race(spark, folder):
    """A race of 16 option sets over 32 rounds; ``best_kept``: no trial that left a rung was better than one that stayed."""
    folded = models.cross_validation_folds(_documents(spark, folder), ["doc_id"], 5)
    train, valid = (folded.where(c).drop("fold") for c in ("fold <> 0", "fold = 0"))
    grid = [
        {"depth": depth, "learning_rate": rate, "subsample": share}
        for depth in (2, 3, 4, 5) for rate in (0.1, 0.3) for share in (0.7, 1.0)
    ]
    log = tuning.successive_halving(
        train, valid, "quality", "classification", ["doc_id"], grid, "accuracy", rounds=32
    ).log
    of_rung = Window.partitionBy("rung").orderBy(F.desc_nulls_last("value"), "trial")
    ranked = log.withColumn("place", F.row_number().over(of_rung))
    return ranked.groupBy("rung").agg(
        F.count("trial").alias("trials"),
        F.max("rows").alias("rows"),
        F.max("rounds").alias("rounds"),
        F.count_if("kept").alias("kept"),
        F.bool_and(F.col("kept") == (F.col("place") <= F.when(F.col("rung") == 0, 4).otherwise(1))).alias("best_kept"),
    )


@query()
def automl_run(spark, folder):
    train, test = train_test_split(_documents(spark, folder), 0.3, ["doc_id"])
    recipes = [
        Recipe("plain", "gbt_a", options={"iterations": 2, "depth": 2}),
        Recipe("scaled", "gbt_b", scale="standard", options={"num_iterations": 5, "max_depth": 4}),
    ]
    result = automl_loop(
        train, test, "quality", "classification", ["doc_id"], recipes,
        max_iterations=2, acceptance_threshold=0.99,
    )
    return result.log
