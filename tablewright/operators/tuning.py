"""Search among many option sets by successive halving."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.functions.expressions import key_hash
from tablewright.operators.metrics import evaluate
from tablewright.operators.models import FAMILIES, TabularModel, fit
from tablewright.session import materialise

_DIGEST_RANGE = 1 << 32
LOG_SCHEMA = "rung int, trial int, options string, rows bigint, rounds int, value double, kept boolean"


@dataclass
class Race:
    """The model of the winning options, learnt from all rows, and what happened on the way.

    ``log`` has a row for each trial of each rung: the number of rows and boosting
    rounds it learnt from, its metric, and whether it went on (in the last rung: won).
    """

    model: TabularModel
    options: dict[str, Any]
    log: DataFrame


def rungs_of(trials: int, keep_one_in: int) -> list[tuple[int, int]]:
    """``(trials, divisor)`` of each rung: it learns from one in ``divisor`` rows, for as small a part of the rounds."""
    if trials < 1 or keep_one_in < 2:
        raise ValueError("a race needs a trial, and keep_one_in must be at least 2")
    left = [trials]
    while left[-1] > 1:
        left.append(-(-left[-1] // keep_one_in))
    return [(count, keep_one_in ** (len(left) - 1 - rung)) for rung, count in enumerate(left)]


def row_sample(df: DataFrame, key_cols: Sequence[str], divisor: int, seed: int) -> DataFrame:
    """Rows whose key's digest is in the first ``1 / divisor`` of its range; smaller samples lie inside larger ones."""
    if divisor == 1:
        return df
    digest = key_hash([col(c) for c in require_columns(df, key_cols)], seed)
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < _DIGEST_RANGE // divisor)


def successive_halving(
    train_df: DataFrame,
    valid_df: DataFrame,
    target: str,
    task_type: str,
    key_cols: Sequence[str],
    grid: Sequence[dict[str, Any]],
    metric: str,
    larger_is_better: bool = True,
    family: str = "gbt_a",
    rounds: int = 100,
    keep_one_in: int = 4,
    at_once: int = 4,
    seed: int = 42,
) -> Race:
    """The best option set of ``grid``, by a race in rungs.

    Every rung learns from ``keep_one_in`` times the rows and rounds of the one before, the
    last one from all rows for ``rounds`` rounds, and hands on the best ``1 / keep_one_in``
    of its trials by ``metric`` on all of ``valid_df``.  All rungs cost about the same, so
    the race costs as much as a few full trainings, whatever the size of the grid.

    Equal metrics go to the earlier trial; a metric that does not exist (NULL, NaN) ranks
    last.  Options must not set the number of rounds.  Rows that share a key are in
    a sample together; null keys are a key like any other.  A first rung without two
    classes fails as ``fit`` does: take a smaller ``keep_one_in`` or a shorter grid.
    The rows of a rung are written once and shared by its trials, ``at_once`` of which run at a time.
    """
    if family not in FAMILIES:
        raise ValueError(f"Unknown family: {family}")
    counted = FAMILIES[family].rounds
    if any(counted in options for options in grid):
        raise ValueError(f"{counted} is set by the race, not by the grid")
    require_columns(valid_df, [target, *key_cols])
    plan = rungs_of(len(grid), keep_one_in)
    spark = train_df.sparkSession
    whole, held = materialise(train_df), materialise(valid_df)
    alive = list(range(len(grid)))
    log: list[tuple] = []
    best: TabularModel | None = None
    for rung, (count, divisor) in enumerate(plan):
        rows = whole if divisor == 1 else materialise(row_sample(whole, key_cols, divisor, seed + 1))
        size, turns = rows.count(), max(1, rounds // divisor)

        def attempt(trial: int, rows: DataFrame = rows, turns: int = turns) -> tuple[TabularModel, float | None]:
            options = {**grid[trial], counted: turns}
            model = fit(rows, target, task_type, family, key_cols, key_cols, seed, **options)
            scored = model.score(held, key_cols, [target])
            found = evaluate(scored, task_type, target, "prediction", zero_one=model.zero_one).first()[metric]
            return model, None if found is None or math.isnan(found) else float(found)

        with ThreadPoolExecutor(max(1, min(at_once, count))) as pool:
            results = dict(zip(alive, pool.map(inheritable_thread_target(spark)(attempt), alive)))
        values = {trial: value for trial, (_, value) in results.items()}
        sign = -1 if larger_is_better else 1
        ranked = sorted(alive, key=lambda t: (values[t] is None, sign * (values[t] or 0.0), t))
        going = set(ranked[: plan[rung + 1][0] if rung + 1 < len(plan) else 1])
        log += [(rung, t, repr(sorted(grid[t].items())), size, turns, values[t], t in going) for t in alive]
        alive = sorted(going)
        best = results[ranked[0]][0]
    return Race(best, grid[alive[0]], spark.createDataFrame(log, LOG_SCHEMA))
