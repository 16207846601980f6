"""Iterated training: try one pipeline after another until one scores well enough."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import categorical_columns, numeric_columns, require_columns
from tablewright.operators.encode import LabelEncoding
from tablewright.operators.impute import fit_fill
from tablewright.operators.models import TrainResult, train
from tablewright.operators.outliers import remove_outliers
from tablewright.operators.scale import fit_scale
from tablewright.operators.split import train_test_split

LOG = (
    "iteration int, name string, family string, score double, "
    "rubric_scores map<string,double>, accepted boolean"
)


@dataclass(frozen=True)
class Recipe:
    """One pipeline: cleaning, scaling and the model with its options."""

    name: str
    family: str = "gbt_a"
    impute: str = "median"
    scale: str | None = None
    outlier_columns: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class LoopResult:
    log: DataFrame
    predictions: DataFrame
    accepted: bool
    final_iteration: int


def _prepared(
    recipe: Recipe, fit_on: DataFrame, others: Sequence[DataFrame], target: str, keys: Sequence[str]
) -> list[DataFrame]:
    """All frames through the recipe, with everything fitted on ``fit_on`` alone."""
    features = [c for c in fit_on.columns if c != target and c not in keys]
    part = fit_on.select(*features)
    text = [c for c in categorical_columns(part) if dict(part.dtypes)[c] != "boolean"]
    frames = [fit_on, *others]
    if recipe.outlier_columns:
        frames[0] = remove_outliers(frames[0], list(recipe.outlier_columns))
    if text:
        encoding = LabelEncoding.fit(frames[0], text)
        frames = [encoding.transform(f, text, unseen="minus_one") for f in frames]
    numbers = [c for c in numeric_columns(frames[0]) if c in features]
    if recipe.impute == "drop":
        # only training rows may go; every other row needs a prediction
        frames[0] = frames[0].na.drop("any")
    fill = fit_fill(frames[0], "median" if recipe.impute == "drop" else recipe.impute, numbers)
    frames = [fill.transform(f) for f in frames]
    if recipe.scale:
        plan = fit_scale(frames[0], numbers, recipe.scale)
        frames = [plan.transform(f) for f in frames]
    return frames


def rubric(metrics: DataFrame, task_type: str) -> dict[str, float]:
    """Scores in [0, 1] from the metrics of a validation table."""
    row = metrics.first()
    names = ("accuracy", "f1") if task_type == "classification" else ("r2",)
    return {n: min(1.0, max(0.0, row[n])) for n in names if row[n] is not None}


def automl_loop(
    train_df: DataFrame,
    test_df: DataFrame,
    target: str,
    task_type: str,
    key_cols: Sequence[str],
    recipes: Sequence[Recipe],
    max_iterations: int = 5,
    acceptance_threshold: float = 0.75,
    valid_size: float = 0.2,
    seed: int = 42,
) -> LoopResult:
    """Fit the recipes in turn, each judged on held-out training rows.

    The score is the mean of the rubric.  The loop ends with the first score at
    or above the threshold, else with the last recipe allowed, and that model
    scores ``test_df``.
    """
    if not recipes:
        raise ValueError("at least one recipe is needed")
    require_columns(train_df, [target, *key_cols])
    spark = train_df.sparkSession
    fitting, held = train_test_split(train_df, valid_size, key_cols, seed)
    rows = []
    result: TrainResult | None = None
    scored = None
    accepted = False
    iteration = 0
    for iteration, recipe in enumerate(recipes[:max_iterations], 1):
        fit_part, valid_part, score_part = _prepared(
            recipe, fitting, [held, test_df], target, key_cols
        )
        result = train(
            fit_part,
            valid_part,
            target,
            task_type,
            key_cols,
            recipe.family,
            seed=seed,
            **recipe.options,
        )
        scores = rubric(result.test_metrics, task_type)
        score = sum(scores.values()) / len(scores) if scores else 0.0
        accepted = score >= acceptance_threshold
        rows.append((iteration, recipe.name, recipe.family, score, scores, accepted))
        scored = result.model.score(score_part, key_cols)
        if accepted:
            break
    log = spark.createDataFrame(rows, LOG).orderBy(F.col("iteration"))
    return LoopResult(log, scored, accepted, iteration)
