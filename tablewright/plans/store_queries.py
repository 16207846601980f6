"""Registered queries: experience store, evaluation logs, cost and benchmark roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import rollup
from tablewright.plans.registry import query, rounded, table
from tablewright.session import materialise, scratch_path
from tablewright.sources import experience, vector_cells

# ---- experience store ------------------------------------------------------

_COSINE = """probe AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
scored AS (SELECT vec_id, label,
  list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS similarity FROM embeddings, probe)"""


def _probe(spark, folder) -> list[float]:
    return table(spark, folder, "embeddings").where("vec_id = 0").first()["embedding"]


@query(
    f"""WITH {_COSINE} SELECT vec_id, label, round(similarity, 6) AS similarity FROM scored
    WHERE label = 3 ORDER BY scored.similarity DESC, vec_id LIMIT 5"""
)
def similar(spark, folder):
    vectors = table(spark, folder, "embeddings")
    hits = experience.similar(
        vectors, _probe(spark, folder), 5, F.col("label") == 3, key="vec_id"
    )
    return rounded(hits.select("vec_id", "label", "similarity"))


@query(
    """WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id,
      list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS exact
      FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS rank
      FROM pairs)
    SELECT query_id, rank, vec_id, round(exact, 6) AS similarity FROM ranked WHERE rank <= 5"""
)
def similar_batch(spark, folder):
    vectors = table(spark, folder, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    dimension = len(_probe(spark, folder))
    cells = vector_cells.VectorCells.build(vectors, dimension, key="vec_id")
    return rounded(cells.similar_batch(queries, 5))


# Entries made from events: two of seven lack the stored score, every eleventh
# evaluation is broken JSON.
_ENTRIES = """entries AS (SELECT event_id AS iteration, event_type AS document,
  CASE WHEN event_id % 7 < 2 THEN NULL ELSE value END AS critic_score,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN TRUE ELSE FALSE END AS accepted,
  event_id % 11 <> 0 AS readable, user_id AS inner_score, 'see ' || event_type AS feedback
  FROM events)"""


def entries(spark, folder) -> DataFrame:
    key = F.col("event_id")
    good = F.to_json(
        F.struct(
            F.col("user_id").cast("double").alias("score"),
            F.create_map(F.lit("results"), F.col("value")).alias("rubric_scores"),
            F.concat(F.lit("see "), F.col("event_type")).alias("feedback"),
        )
    )
    return table(spark, folder, "events").select(
        key.alias("iteration"),
        F.col("event_type").alias("document"),
        F.when(key % 7 >= 2, F.col("value")).alias("critic_score"),
        F.when(key % 3 == 1, True).when(key % 3 == 2, False).alias("accepted"),
        F.when(key % 11 != 0, good).otherwise(F.concat(F.lit("{broken "), good)).alias(
            "critic_evaluation"
        ),
    )


@query(
    f"""WITH {_ENTRIES} SELECT iteration, coalesce(critic_score, inner_score::DOUBLE) AS score,
    coalesce(accepted, FALSE) AS was_accepted, feedback FROM entries WHERE readable"""
)
def parse_evaluations(spark, folder):
    parsed = experience.parse_evaluations(entries(spark, folder))
    return parsed.select("iteration", "score", "was_accepted", "feedback")


@query(
    f"""WITH {_ENTRIES} SELECT iteration, coalesce(accepted, FALSE) AS accepted,
    document AS actions_summary, feedback AS feedback_received FROM entries WHERE readable"""
)
def actor_view(spark, folder):
    return experience.actor_view(experience.parse_evaluations(entries(spark, folder)))


@query(
    f"""WITH {_ENTRIES} SELECT iteration, coalesce(critic_score, inner_score::DOUBLE) AS score,
    document AS actions_observed, feedback AS feedback_given FROM entries WHERE readable"""
)
def critic_view(spark, folder):
    return experience.critic_view(experience.parse_evaluations(entries(spark, folder)))


@query(
    f"""WITH {_COSINE}, hits AS (SELECT * FROM scored WHERE label % 2 = 0
      ORDER BY similarity DESC, vec_id LIMIT 5)
    SELECT vec_id::INTEGER AS iteration, round(label / 10, 6)::DOUBLE AS score,
    'entry ' || vec_id AS actions_observed, 'label ' || label AS feedback_given FROM hits"""
)
def experience_store(spark, folder):
    store = experience.ExperienceStore(spark, scratch_path(spark, "experience"))
    label = F.col("label")
    store.append(
        table(spark, folder, "embeddings").select(
            F.concat(F.lit("entry "), F.col("vec_id").cast("string")).alias("document"),
            "embedding",
            F.when(label % 2 == 0, "classification").otherwise("regression").alias("task_type"),
            F.col("vec_id").alias("iteration"),
            (label / 10).alias("score"),
            F.create_map(F.lit("results"), (label / 10).cast("double")).alias("rubric_scores"),
            F.concat(F.lit("label "), label.cast("string")).alias("feedback"),
        )
    )
    return rounded(store.retrieve(_probe(spark, folder), "classification", 5)[1])


@query("SELECT 'before' AS moment, count(*) AS n FROM embeddings UNION ALL SELECT 'after', 0")
def experience_clear(spark, folder):
    store = experience.ExperienceStore(spark, scratch_path(spark, "experience"))
    vectors = table(spark, folder, "embeddings")
    store.append(
        vectors.select(
            F.col("vec_id").cast("string").alias("document"),
            "embedding",
            F.lit("regression").alias("task_type"),
            F.lit(1).alias("iteration"),
            F.lit(0.5).alias("score"),
            F.create_map(F.lit("results"), F.lit(0.5)).alias("rubric_scores"),
            F.lit("none").alias("feedback"),
        )
    )
    counted = F.count(F.lit(1)).alias("n")
    before = materialise(store.entries().agg(F.lit("before").alias("moment"), counted))
    store.clear()
    return before.unionByName(store.entries().agg(F.lit("after").alias("moment"), counted))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round((l_discount + l_tax + l_quantity / 50) / 3, 6) AS score FROM lineitem"""
)
def rubric_score(spark, folder):
    rubric = F.create_map(
        F.lit("data_analysis"), F.col("l_discount"),
        F.lit("preprocessing"), F.col("l_tax"),
        F.lit("results"), F.col("l_quantity") / 50,
    )
    return rounded(
        table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            experience.rubric_score(rubric, F.lit(0.0)).alias("score"),
        )
    )


@query(
    r"""SELECT event_id, '# Data Analysis' || chr(10) || event_type || chr(10) || chr(10) ||
    '# Preprocessing' || chr(10) || props || chr(10) || chr(10) ||
    '# Model Training' || chr(10) || chr(10) || chr(10) ||
    '# Results' || chr(10) || user_id AS report FROM events"""
)
def report_text(spark, folder):
    text = experience.report_text(
        F.col("event_type"), F.col("props"), F.lit(None).cast("string"), F.col("user_id").cast("string")
    )
    return table(spark, folder, "events").select("event_id", text.alias("report"))


# ---- iteration logs --------------------------------------------------------

_LOG = """log AS (SELECT conv_id AS run_id, turn AS iteration,
  (length(text) % 101) / 100.0::DOUBLE AS score FROM conversations)"""


def iteration_log(spark, folder) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("iteration"),
        ((F.length("text") % 101) / F.lit(100.0)).alias("score"),
    )


_ENDS = f"""WITH {_LOG}, ends AS (SELECT run_id AS run,
  min(CASE WHEN score >= 0.75 THEN iteration END) AS first_ok, max(iteration) AS last
  FROM log GROUP BY run_id)"""


@query(
    f"""{_ENDS} SELECT run_id, iteration AS final_iteration, first_ok IS NOT NULL AS accepted,
    score AS final_score FROM log JOIN ends ON run_id = run AND iteration = coalesce(first_ok, last)"""
)
def iteration_outcome(spark, folder):
    return rollup.iteration_outcome(iteration_log(spark, folder))


@query(
    f"""{_ENDS} SELECT run_id, iteration, score, score >= 0.75 AS accepted
    FROM log JOIN ends ON run_id = run AND iteration <= coalesce(first_ok, last)"""
)
def score_history(spark, folder):
    return rollup.score_history(iteration_log(spark, folder))


@query(
    f"""WITH {_LOG}, ranked AS (SELECT *, row_number() OVER
      (PARTITION BY run_id ORDER BY score DESC, iteration) AS rn FROM log)
    SELECT run_id, iteration AS best_iteration, score AS best_score FROM ranked WHERE rn = 1"""
)
def best_iteration(spark, folder):
    return rollup.best_iteration(iteration_log(spark, folder))


# ---- cost ------------------------------------------------------------------

# Prices per million tokens in a made-up catalogue.
_PRICES = (
    ("north", "small", 0.5, 1.5),
    ("north", "large/v2", 5.0, 15.0),
    ("south", "small", 0.25, 1.0),
)
_PRICE_SQL = "prices(provider, name, pin, pout) AS (VALUES " + ", ".join(
    f"('{p}', '{n}', {a}::DOUBLE, {b}::DOUBLE)" for p, n, a, b in _PRICES
) + ")"
_USAGE = """usage AS (SELECT conv_id, turn, role,
  CASE conv_id % 5 WHEN 0 THEN 'north/small' WHEN 1 THEN 'north/large/v2' WHEN 2 THEN 'south/small'
    WHEN 3 THEN 'unknown/small' ELSE 'malformed' END AS model,
  CASE WHEN role = 'user' THEN length(text) END AS input_tokens,
  CASE WHEN role <> 'user' THEN length(text) END AS output_tokens FROM conversations)"""
_COST = f"""{_USAGE}, {_PRICE_SQL}, costs AS (SELECT conv_id, turn, role, model,
  coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens,
  coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS total_tokens,
  coalesce(coalesce(input_tokens, 0) * pin / 1000000, 0)::DOUBLE AS input_cost,
  coalesce(coalesce(output_tokens, 0) * pout / 1000000, 0)::DOUBLE AS output_cost
  FROM usage LEFT JOIN prices ON model = provider || '/' || name)"""


def usage(spark, folder) -> DataFrame:
    kind = F.col("conv_id") % 5
    model = (
        F.when(kind == 0, "north/small")
        .when(kind == 1, "north/large/v2")
        .when(kind == 2, "south/small")
        .when(kind == 3, "unknown/small")
        .otherwise("malformed")
    )
    size = F.length("text")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", model.alias("model"),
        F.when(F.col("role") == "user", size).alias("input_tokens"),
        F.when(F.col("role") != "user", size).alias("output_tokens"),
    )


def _costs(spark, folder) -> DataFrame:
    prices = spark.createDataFrame(
        list(_PRICES), "provider string, name string, input_price double, output_price double"
    )
    return rollup.token_cost(usage(spark, folder), prices)


@query(
    f"""WITH {_COST} SELECT conv_id, turn, role, model, input_tokens::BIGINT AS input_tokens,
    output_tokens::BIGINT AS output_tokens, total_tokens::BIGINT AS total_tokens,
    round(input_cost, 9) AS input_cost, round(output_cost, 9) AS output_cost,
    round(input_cost + output_cost, 9) AS total_cost FROM costs"""
)
def token_cost(spark, folder):
    return rounded(_costs(spark, folder), 9)


@query(
    f"""WITH {_COST} SELECT model, sum(input_tokens)::BIGINT AS input_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens,
    round(sum(input_cost), 6) AS input_cost, round(sum(output_cost), 6) AS output_cost,
    round(sum(input_cost + output_cost), 6) AS total_cost FROM costs GROUP BY model"""
)
def token_totals(spark, folder):
    return rounded(rollup.token_totals(_costs(spark, folder), ["model"]))


# ---- benchmark results -----------------------------------------------------

# Every order stands for one task of a benchmark run.
_RESULTS = """results AS (SELECT 'task ' || o_orderpriority AS task_name,
  CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'failed ' || o_orderkey END AS error_message,
  (o_custkey % 1000) / 1000.0::DOUBLE AS accuracy, (o_orderkey % 1000) / 1000.0::DOUBLE AS f1_score,
  o_custkey AS total_tokens, o_custkey % 100 AS actor_total_tokens,
  o_totalprice / 1000 AS total_cost, o_totalprice / 2000 AS actor_total_cost,
  (o_orderkey % 3600)::DOUBLE AS runtime_seconds, o_orderkey FROM orders)"""


def results(spark, folder) -> DataFrame:
    failed = F.col("o_orderstatus") == "P"
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("task "), "o_orderpriority").alias("task_name"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed, F.concat(F.lit("failed "), key.cast("string"))).alias("error_message"),
        ((cust % 1000) / F.lit(1000.0)).alias("accuracy"),
        ((key % 1000) / F.lit(1000.0)).alias("f1_score"),
        cust.alias("total_tokens"),
        (cust % 100).alias("actor_total_tokens"),
        (price / 1000).alias("total_cost"),
        (price / 2000).alias("actor_total_cost"),
        (key % 3600).cast("double").alias("runtime_seconds"),
        "o_orderkey",
    )


_SUMMARY = """SELECT count(*) FILTER (status = 'success') AS completed,
  count(*) FILTER (status = 'error') AS failed,
  round(avg(accuracy) FILTER (status = 'success'), 6) AS mean_accuracy,
  round(avg(f1_score) FILTER (status = 'success'), 6) AS mean_f1,
  min(accuracy) FILTER (status = 'success') AS min_accuracy,
  max(accuracy) FILTER (status = 'success') AS max_accuracy,
  (sum(total_tokens) FILTER (status = 'success'))::BIGINT AS total_tokens,
  (sum(actor_total_tokens) FILTER (status = 'success'))::BIGINT AS actor_tokens,
  round(avg(total_tokens) FILTER (status = 'success'), 4) AS avg_tokens,
  round(sum(total_cost) FILTER (status = 'success'), 2) AS total_cost,
  round(sum(actor_total_cost) FILTER (status = 'success'), 2) AS actor_cost,
  round(avg(total_cost) FILTER (status = 'success'), 4) AS avg_cost,
  min(total_cost) FILTER (status = 'success') AS min_cost,
  max(total_cost) FILTER (status = 'success') AS max_cost,
  sum(runtime_seconds) FILTER (status = 'success') AS total_runtime,
  round(avg(runtime_seconds) FILTER (status = 'success'), 4) AS avg_runtime,
  min(runtime_seconds) FILTER (status = 'success') AS min_runtime,
  max(runtime_seconds) FILTER (status = 'success') AS max_runtime FROM results"""


def _rounded_summary(df: DataFrame) -> DataFrame:
    digits = {
        "mean_accuracy": 6, "mean_f1": 6, "avg_tokens": 4, "total_cost": 2, "actor_cost": 2,
        "avg_cost": 4, "avg_runtime": 4,
    }
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"WITH {_RESULTS} {_SUMMARY}")
def bench_summary(spark, folder):
    return _rounded_summary(rollup.bench_summary(results(spark, folder)))


@query(f"WITH {_RESULTS} {_SUMMARY} WHERE task_name IN ('task 1-URGENT', 'task 5-LOW')")
def bench_summary_of_tasks(spark, folder):
    chosen = ["task 1-URGENT", "task 5-LOW"]
    return _rounded_summary(rollup.bench_summary(results(spark, folder), chosen))


@query(
    f"""WITH {_RESULTS} SELECT task_name, accuracy, f1_score, total_cost, runtime_seconds
    FROM results WHERE status = 'success'"""
)
def bench_tasks(spark, folder):
    return rollup.bench_tasks(results(spark, folder))


@query(f"WITH {_RESULTS} SELECT task_name, error_message FROM results WHERE status = 'error'")
def failed_tasks(spark, folder):
    return rollup.failed_tasks(results(spark, folder))


@query(
    """SELECT count(*) AS n_samples, 10::BIGINT AS n_features,
    count(DISTINCT l_returnflag) AS n_classes FROM lineitem"""
)
def dataset_facts(spark, folder):
    return rollup.dataset_facts(table(spark, folder, "lineitem"), "l_returnflag")
