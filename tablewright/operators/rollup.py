"""Cost and benchmark roll-ups, and the outcome of iterated runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.session import broadcast_if_small

PER_TOKENS = 1_000_000


def token_cost(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Add token totals and prices to a usage table.

    ``usage`` holds ``model`` as ``provider/name`` (split at the first slash),
    ``input_tokens`` and ``output_tokens``; ``prices`` holds ``provider``,
    ``name``, ``input_price`` and ``output_price`` per million tokens.  Missing
    tokens count as 0; an unknown or malformed model costs 0.  A model priced
    twice is an error.
    """
    require_columns(usage, [model, "input_tokens", "output_tokens"])
    require_columns(prices, ["provider", "name", "input_price", "output_price"])
    slash = F.instr(col(model), "/")
    provider = F.when(slash > 0, F.substring_index(col(model), "/", 1))
    name = F.when(slash > 0, col(model).substr(slash + 1, F.length(col(model))))
    table = prices.select(
        F.col("provider").alias("_provider"),
        F.col("name").alias("_name"),
        F.col("input_price").cast("double").alias("_in"),
        F.col("output_price").cast("double").alias("_out"),
    )
    repeated = table.groupBy("_provider", "_name").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("prices hold a model more than once")
    split = usage.withColumns({"_p": provider, "_n": name})
    joined = split.join(
        broadcast_if_small(table), (F.col("_p") == F.col("_provider")) & (F.col("_n") == F.col("_name")), "left"
    )
    tokens_in = F.coalesce(col("input_tokens"), F.lit(0)).cast("bigint")
    tokens_out = F.coalesce(col("output_tokens"), F.lit(0)).cast("bigint")
    kept = [col(c) for c in usage.columns if c not in ("input_tokens", "output_tokens")]
    priced = joined.select(
        *kept,
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        (tokens_in + tokens_out).alias("total_tokens"),
        F.coalesce(tokens_in * F.col("_in") / PER_TOKENS, F.lit(0.0)).alias("input_cost"),
        F.coalesce(tokens_out * F.col("_out") / PER_TOKENS, F.lit(0.0)).alias("output_cost"),
    )
    return priced.withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))


def token_totals(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = ("input_tokens", "output_tokens", "total_tokens", "input_cost", "output_cost", "total_cost")
    return costs.groupBy(*[col(c) for c in by]).agg(*[F.sum(c).alias(c) for c in names])


def chosen_tasks(results: DataFrame, tasks: Sequence[str] | None) -> DataFrame:
    """Results of the named tasks; an error when none matches."""
    if not tasks:
        return results
    chosen = results.where(F.col("task_name").isin(list(tasks)))
    if chosen.isEmpty():
        raise ValueError(f"none of these tasks has a result: {list(tasks)}")
    return chosen


def bench_summary(results: DataFrame, tasks: Sequence[str] | None = None) -> DataFrame:
    """One row over all task results: counts, and statistics of the successful ones."""
    results = chosen_tasks(results, tasks)
    ok = F.col("status") == "success"

    def of(name: str):
        return F.when(ok, col(name))

    return results.agg(
        F.count(F.when(ok, 1)).alias("completed"),
        F.count(F.when(F.col("status") == "error", 1)).alias("failed"),
        F.avg(of("accuracy")).alias("mean_accuracy"),
        F.avg(of("f1_score")).alias("mean_f1"),
        F.min(of("accuracy")).alias("min_accuracy"),
        F.max(of("accuracy")).alias("max_accuracy"),
        F.sum(of("total_tokens")).alias("total_tokens"),
        F.sum(of("actor_total_tokens")).alias("actor_tokens"),
        F.avg(of("total_tokens")).alias("avg_tokens"),
        F.sum(of("total_cost")).alias("total_cost"),
        F.sum(of("actor_total_cost")).alias("actor_cost"),
        F.avg(of("total_cost")).alias("avg_cost"),
        F.min(of("total_cost")).alias("min_cost"),
        F.max(of("total_cost")).alias("max_cost"),
        F.sum(of("runtime_seconds")).alias("total_runtime"),
        F.avg(of("runtime_seconds")).alias("avg_runtime"),
        F.min(of("runtime_seconds")).alias("min_runtime"),
        F.max(of("runtime_seconds")).alias("max_runtime"),
    )


def bench_tasks(results: DataFrame) -> DataFrame:
    """Per-task table of the successful tasks."""
    return results.where(F.col("status") == "success").select(
        "task_name", "accuracy", "f1_score", "total_cost", "runtime_seconds"
    )


def failed_tasks(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "error").select("task_name", "error_message")


def dataset_facts(df: DataFrame, target: str) -> DataFrame:
    """One row: samples, features (all columns but the target) and classes."""
    require_columns(df, [target])
    per_class = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("_n"))
    return per_class.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_samples"),
        F.lit(len(df.columns) - 1).cast("bigint").alias("n_features"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def iteration_outcome(
    log: DataFrame, threshold: float = 0.75, by: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Per run: the iteration it ends with, its score, and whether it was accepted.

    A run ends at its first score at or above ``threshold``, else at its last
    iteration.  Only the two candidate steps of a run are kept while grouping.
    """
    require_columns(log, [*by, "iteration", "score"])
    step = F.struct("iteration", "score")
    first = F.min(F.when(F.col("score") >= threshold, step))
    grouped = log.groupBy(*[col(c) for c in by]).agg(
        first.alias("_first"), F.max(step).alias("_last")
    )
    final = F.coalesce("_first", "_last")
    return grouped.select(
        *[col(c) for c in by],
        final["iteration"].alias("final_iteration"),
        F.col("_first").isNotNull().alias("accepted"),
        final["score"].alias("final_score"),
    )


def score_history(
    log: DataFrame, threshold: float = 0.75, by: Sequence[str] = ("run_id",)
) -> DataFrame:
    """The steps of every run up to the one it ends with, one row each."""
    keys = list(by)
    ends = iteration_outcome(log, threshold, by).select(*[col(c) for c in keys], "final_iteration")
    steps = log.join(ends, keys).where(F.col("iteration") <= F.col("final_iteration"))
    return steps.select(
        *[col(c) for c in keys],
        "iteration",
        "score",
        (F.col("score") >= threshold).alias("accepted"),
    )


def best_iteration(log: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per run the iteration with the highest score, the earliest among equals."""
    require_columns(log, [*by, "iteration", "score"])
    best = F.max(F.struct(F.col("score"), (-F.col("iteration")).alias("i")))
    return log.groupBy(*[col(c) for c in by]).agg(best.alias("_b")).select(
        *[col(c) for c in by],
        (-F.col("_b.i")).alias("best_iteration"),
        F.col("_b.score").alias("best_score"),
    )
