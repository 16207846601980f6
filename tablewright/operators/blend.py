"""Weighted blends of several models' predictions."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_rows, col, require_columns, union_all
from tablewright.operators.metrics import evaluate
from tablewright.session import materialise

_VOTES_PER_JOB = 10


def normalised(weights: Sequence[float]) -> list[float]:
    total = sum(weights)
    if total == 0:
        raise ValueError("weights sum to zero")
    return [w / total for w in weights]


def candidate_weights(k: int, n_trials: int = 100, seed: int = 42) -> list[list[float]]:
    """Repeatable candidates: ``n_trials`` draws from the unit cube, normalised."""
    draw = random.Random(seed)
    found = []
    while len(found) < n_trials:
        weights = [draw.random() for _ in range(k)]
        if sum(weights) > 0:
            found.append(normalised(weights))
    return found


def align(
    predictions: Sequence[DataFrame], key: str, labels: DataFrame | None = None, target: str = ""
) -> DataFrame:
    """One row per key with ``p0..pk-1`` (and ``label``): one shuffle for all inputs.

    Every key must occur exactly once in every input; otherwise the query fails
    when it runs, naming the key.
    """
    frames = []
    for i, frame in enumerate(predictions):
        require_columns(frame, [key, "prediction"])
        frames.append(
            frame.select(
                col(key).alias(key), F.lit(i).alias("_src"), col("prediction").alias(f"p{i}")
            )
        )
    names = [f"p{i}" for i in range(len(predictions))]
    if labels is not None:
        require_columns(labels, [key, target])
        frames.append(
            labels.select(
                col(key).alias(key), F.lit(len(frames)).alias("_src"), col(target).alias("label")
            )
        )
        names.append("label")
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    n = len(frames)
    # as many rows as inputs, and every input among them
    present = [F.count(F.when(F.col("_src") == i, 1)).alias(f"_c{i}") for i in range(n)]
    # keys are unique per input, so combining before the shuffle would only cost
    together = (
        merged.repartition(col(key))
        .groupBy(col(key))
        .agg(*present, *[F.max(c).alias(c) for c in names])
    )
    complete = F.lit(True)
    for i in range(n):
        complete = complete & (F.col(f"_c{i}") == 1)
    message = F.concat(F.lit("not once in every input: key "), col(key).cast("string"))
    # a filter, since every column depends on it; in a column it would go where that column goes
    checked = F.when(complete, True).otherwise(F.raise_error(message).cast("boolean"))
    return together.where(checked).select(col(key), *names)


def weighted_sum(weights: Sequence[float], k: int) -> Column:
    total = F.col("p0").cast("double") * F.lit(weights[0])
    for i in range(1, k):
        total = total + F.col(f"p{i}").cast("double") * F.lit(weights[i])
    return total


def weighted_vote(weights: Sequence[float], k: int) -> Column:
    """The class with the largest total weight; ties go to the smaller class."""
    options = []
    for i in range(k):
        support = F.lit(0.0)
        for j in range(k):
            support = support + F.when(F.col(f"p{j}") == F.col(f"p{i}"), F.lit(weights[j])).otherwise(0.0)
        options.append(F.struct(support.alias("s"), F.col(f"p{i}").alias("p")))
    strongest = F.array_max(F.array(*[o["s"] for o in options]))
    winners = F.filter(F.array(*options), lambda o: o["s"] == strongest)
    return F.array_min(F.transform(winners, lambda o: o["p"]))


def blend(predictions: Sequence[DataFrame], weights: Sequence[float], key: str) -> DataFrame:
    """``(key, prediction)``: weighted mean of the predictions, weights scaled to sum 1."""
    if len(weights) != len(predictions):
        raise ValueError("one weight per prediction table is needed")
    return align(predictions, key).select(
        col(key), weighted_sum(normalised(weights), len(predictions)).alias("prediction")
    )


@dataclass
class BlendResult:
    trials: DataFrame
    weights: list[float]
    predictions: DataFrame
    metrics: DataFrame


def _zero_one(aligned: DataFrame) -> bool:
    """True when the label column holds nothing but 0 and 1."""
    outside = ~F.col("label").cast("double").isin(0.0, 1.0)
    numeric = dict(aligned.dtypes)["label"] != "string"
    return numeric and aligned.where(outside).isEmpty()


def error_products(aligned: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Mean products of the errors of every two inputs, and the rows that they come from.

    These are the rows with a label and all predictions, the same ones for every product;
    a table without any is an error.
    """
    y = F.col("label").cast("double")
    # errors in place of values: weights sum to 1, so the blend's error is
    # the weighted error, and no large terms cancel
    e = [F.col(f"p{i}").cast("double") - y for i in range(k)]
    known = y.isNotNull()
    for error in e:
        known = known & error.isNotNull()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    means = [F.avg(e[i] * e[j]).alias(f"g{i}_{j}") for i, j in pairs]
    row = aligned.where(known).agg(F.count(F.lit(1)).alias("n"), *means).first()
    if not row["n"]:
        raise ValueError("no row has a label and a prediction of every input")
    products = np.zeros((k, k))
    for i, j in pairs:
        products[i, j] = products[j, i] = row[f"g{i}_{j}"]
    return products, row["n"]


def simplex_minimum(products: np.ndarray) -> np.ndarray:
    """Weights of at least 0 and sum 1 that make ``w @ products @ w`` smallest, by active sets.

    ``products`` is symmetric and has no negative eigenvalue.  From the best single input,
    the input whose error falls fastest joins, and inputs whose weight
    reaches 0 leave, until no input is left that would lower the error.
    """
    k = len(products)
    scale = max(float(np.abs(products).max()), 1e-300)
    g = products / scale
    held = [int(np.argmin(np.diag(g)))]
    weights = np.zeros(k)
    weights[held] = 1.0
    for _ in range(50 * k):
        slope = g @ weights
        value = weights @ slope
        free = [i for i in range(k) if i not in held]
        best = min(free, key=lambda i: slope[i], default=None)
        if best is None or slope[best] >= value - 1e-12:
            break
        held.append(best)
        while True:
            size = len(held)
            system = np.zeros((size + 1, size + 1))
            system[:size, :size] = g[np.ix_(held, held)]
            system[:size, size] = system[size, :size] = 1.0
            goal = np.linalg.lstsq(system, np.r_[np.zeros(size), 1.0], rcond=1e-12)[0][:size]
            now = weights[held]
            falling = goal < now
            ways = np.where(falling & (goal < 0), now / np.where(falling, now - goal, 1.0), 1.0)
            way = min(1.0, float(ways.min()))
            moved = np.maximum(now + way * (goal - now), 0.0)
            weights[:] = 0.0
            weights[held] = moved / moved.sum()
            if way >= 1.0:
                break
            held = [i for i, w, t in zip(held, moved, ways) if t > way]
            if not held:
                held = [int(np.argmax(weights))]
                break
    return weights


def optimal_blend(
    predictions: Sequence[DataFrame], labels: DataFrame, target: str, key: str
) -> BlendResult:
    """The weights of least squared error of all, found from one scan, as trial 0.

    Rows without a label or without one of the predictions count for nothing.
    """
    k = len(predictions)
    aligned = materialise(align(predictions, key, labels, target))
    products, _ = error_products(aligned, k)
    weights = simplex_minimum(products)
    trials = aligned.sparkSession.createDataFrame(
        [(0, float(weights @ products @ weights))], "trial int, objective double"
    )
    mixed = weighted_sum(weights.tolist(), k)
    metrics = evaluate(aligned.select("label", mixed.alias("prediction")), "regression")
    return BlendResult(trials, weights.tolist(), aligned.select(col(key), mixed.alias("prediction")), metrics)


def score_candidates(
    aligned: DataFrame,
    candidates: Sequence[Sequence[float]],
    task_type: str,
    k: int,
    vote: bool = False,
) -> DataFrame:
    """``(trial, objective)`` for every candidate; smaller is better.

    Regression needs the means of products once: the squared error of any
    weights follows from them.  Rows without a label or without one of the
    predictions have no blend and count for no candidate.  Classification counts hits; hard labels are first
    collapsed to their distinct combinations.
    """
    spark = aligned.sparkSession
    if task_type == "regression":
        products, _ = error_products(aligned, k)
        tried = np.array(candidates, dtype=float).reshape(-1, k)
        objective = np.einsum("ti,ij,tj->t", tried, products, tried)
        scored = list(enumerate(objective.tolist()))
        return spark.createDataFrame(scored, "trial int, objective double")
    dtypes = dict(aligned.dtypes)
    hard = all(dtypes[f"p{i}"] not in ("float", "double") for i in range(k))
    names = [*[f"p{i}" for i in range(k)], "label"]
    if hard:
        rows = aligned.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    else:
        rows = aligned.select(*names, F.lit(1).cast("bigint").alias("_n"))
    if vote:
        return union_all(
            [
                _vote_hits(rows, candidates, range(start, min(start + _VOTES_PER_JOB, len(candidates))), k)
                for start in range(0, len(candidates), _VOTES_PER_JOB)
            ]
        )
    return _threshold_hits(rows, candidates, k)


def _vote_hits(rows: DataFrame, candidates, block: range, k: int) -> DataFrame:
    """Share of right votes per candidate of the block, in one pass."""
    weight = F.col("_n")
    hits = [
        F.sum(
            F.when(weighted_vote(candidates[t], k) == F.col("label"), weight).otherwise(0)
        ).alias(f"h{t}")
        for t in block
    ]
    return as_rows(
        rows.agg(F.sum(weight).alias("n"), *hits),
        [
            {"trial": F.lit(t), "objective": -F.try_divide(F.col(f"h{t}"), F.col("n"))}
            for t in block
        ],
    )


def _threshold_hits(rows: DataFrame, candidates, k: int) -> DataFrame:
    """Share of rows on the right side of one half, for all candidates in one pass.

    A hundred conditional sums would leave compiled code, so tasks count with
    arrays, candidates across and rows down, and emit one row per candidate.
    """
    weights = np.array(candidates, dtype=float).reshape(-1, k)
    missing = F.lit(False)
    for i in range(k):
        missing = missing | F.col(f"p{i}").isNull()
    plain = rows.select(
        *[F.col(f"p{i}").cast("double").alias(f"p{i}") for i in range(k)],
        # 1 or 0; a NULL label is neither, so that no prediction hits it
        F.coalesce((F.col("label").cast("double") == 1).cast("int"), F.lit(-1)).alias("positive"),
        F.when(missing, 1).otherwise(0).alias("missing"),
        "_n",
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(len(weights), dtype=np.int64)
        total = 0
        for batch in batches:
            *values, positive, missing, n = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            mixed = np.multiply.outer(weights[:, 0], values[0])
            for i in range(1, k):
                mixed = mixed + np.multiply.outer(weights[:, i], values[i])
            # a NULL prediction is a miss, as in the metrics
            hits += ((mixed > 0.5) == positive) @ np.where(missing, 0, n)
            total += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(weights)), pa.int32()),
                pa.array(hits),
                pa.array([total] * len(weights), pa.int64()),
            ],
            names=["trial", "hits", "n"],
        )

    counted = plain.mapInArrow(partial, "trial int, hits bigint, n bigint")
    return counted.groupBy("trial").agg(
        (-F.try_divide(F.sum("hits"), F.sum("n"))).alias("objective")
    )


def search_blend(
    predictions: Sequence[DataFrame],
    labels: DataFrame,
    target: str,
    task_type: str,
    key: str,
    n_trials: int = 100,
    seed: int = 42,
    candidates: Sequence[Sequence[float]] | None = None,
    holdout: tuple[Sequence[DataFrame], DataFrame] | None = None,
) -> BlendResult:
    """Best of ``n_trials`` weight vectors, the blend with it, and its metrics.

    Two 0/1 classes are blended as numbers and cut at one half; other classes
    vote.  Metrics use the labels of the search, or a ``holdout`` of
    ``(predictions, labels)``.
    """
    if task_type not in ("classification", "regression"):
        raise ValueError(f"Unknown task_type: {task_type}")
    k = len(predictions)
    aligned = materialise(align(predictions, key, labels, target))  # read by every step below
    tried = [list(w) for w in candidates or candidate_weights(k, n_trials, seed)]
    vote = task_type == "classification" and not _zero_one(aligned)
    scores = score_candidates(aligned, tried, task_type, k, vote).collect()  # one row per trial
    trials = aligned.sparkSession.createDataFrame(scores, "trial int, objective double")
    best = min(scores, key=lambda row: (row["objective"], row["trial"]))["trial"]
    weights = tried[best]
    mixed = weighted_vote(weights, k) if vote else weighted_sum(weights, k)
    blended = aligned.select(col(key), mixed.alias("prediction"))
    measured = aligned if holdout is None else align(holdout[0], key, holdout[1], target)
    metrics = evaluate(
        measured.select("label", mixed.alias("prediction")), task_type, zero_one=not vote
    )
    return BlendResult(trials, weights, blended, metrics)
