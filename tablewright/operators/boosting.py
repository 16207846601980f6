"""Newton boosting with penalties on leaf values, for numbers, two classes, and several classes jointly.

Each round grows a tree with ``pyspark.ml`` on the Newton steps of the rows, weighted
by curvature; with several classes one for each of them, all from the same softmax
shares.  One aggregation then adds up gradients and curvatures by tree and leaf, for
all classes at once, and a leaf's value is its soft-thresholded gradient over its
curvature: ``-rate * sign(G) * max(|G| - l1, 0) / (H + l2)``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import Rounds, materialise

#: Trees of one round grown at the same time.
_AT_ONCE = 4
_LEAST_CURVATURE = 1e-6
_NODE = re.compile(r"If \(feature (\d+) <= (\S+)\)|Predict: (\S+)")


@dataclass(frozen=True)
class Tree:
    """Nodes in preorder: the feature (-1 in a leaf), its threshold, the children; values of the leaves."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    leaf: list[int]
    values: list[list[float]]

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Number of the leaf that each row falls into."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(rows), np.int64)
        while (inner := feature[at] >= 0).any():
            node = at[inner]
            goes = rows[np.flatnonzero(inner), feature[node]] <= threshold[node]
            at[inner] = np.where(goes, left[node], right[node])
        return np.array(self.leaf)[at]


def parse_tree(text: str, values: Sequence[Sequence[float]]) -> Tree:
    """A tree from its printed form, with values for its leaves from left to right."""
    feature, threshold, left, right, leaf = [], [], [], [], []
    found = iter(_NODE.findall(text))

    def node() -> int:
        name, cut, answer = next(found)
        at = len(feature)
        feature.append(-1 if answer else int(name))
        threshold.append(0.0 if answer else float(cut))
        left.append(-1)
        right.append(-1)
        leaf.append(sum(f == -1 for f in feature) - 1 if answer else -1)
        if not answer:
            left[at] = node()
            right[at] = node()
        return at

    node()
    return Tree(feature, threshold, left, right, leaf, [list(map(float, v)) for v in values])


@dataclass(frozen=True)
class NewtonModel:
    """Margins: where they start, and what each tree adds."""

    features: list[str]
    classes: int  # 0 for numbers
    start: list[float]
    trees: list[Tree]

    def margins(self, rows: np.ndarray) -> np.ndarray:
        found = np.tile(np.array(self.start), (len(rows), 1))
        for tree in self.trees:
            found += np.array(tree.values)[tree.leaves(rows)]
        return found

    def outputs(self, rows: np.ndarray) -> np.ndarray:
        """The number itself, or the probabilities of the classes, one row each."""
        if not np.isfinite(rows).all():
            raise ValueError("a feature is null, NaN or infinite: impute first")
        found = self.margins(rows)
        if not self.classes:
            return found
        if found.shape[1] == 1:
            found = np.hstack([np.zeros_like(found), found])
        found = np.exp(found - found.max(axis=1, keepdims=True))
        return found / found.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_prediction`` (class number, or a number) and ``_probability`` (an array)."""

        @F.arrow_udf("array<double>")
        def output(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.flatten()]  # NULL becomes NaN
                found = self.outputs(np.column_stack(columns).astype(float))
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

        inputs = F.struct(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])
        scored = df.withColumn("_probability", output(inputs))
        if not self.classes:
            return scored.withColumn("_prediction", F.get("_probability", 0))
        place = F.array_position("_probability", F.array_max("_probability")) - 1
        return scored.withColumn("_prediction", place.cast("double"))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of_json(cls, text: str) -> NewtonModel:
        held = json.loads(text)
        return cls(**{**held, "trees": [Tree(**tree) for tree in held["trees"]]})


def leaf_value(gradient: float, curvature: float, l1: float, l2: float, rate: float) -> float:
    pull = math.copysign(max(abs(gradient) - l1, 0.0), gradient)
    return -rate * pull / (curvature + l2) if pull else 0.0


def _steps(classes: int) -> tuple[list[Column], list[Column]]:
    """Gradient and curvature of the loss by each margin, from ``_margin`` and ``_label``."""
    margin = lambda c: F.get("_margin", c)
    label = F.col("_label")
    if classes == 0:
        return [margin(0) - label], [F.lit(1.0)]
    if classes == 2:
        share = 1 / (1 + F.exp(-margin(0)))
        return [share - label], [F.greatest(share * (1 - share), F.lit(_LEAST_CURVATURE))]
    top = F.array_max("_margin")
    total = reduce(add, [F.exp(margin(c) - top) for c in range(classes)])
    shares = [F.exp(margin(c) - top) / total for c in range(classes)]
    gradients = [share - (label == c).cast("double") for c, share in enumerate(shares)]
    return gradients, [F.greatest(share * (1 - share), F.lit(_LEAST_CURVATURE)) for share in shares]


def _start(rows: DataFrame, classes: int) -> list[float]:
    if classes == 0:
        return [rows.agg(F.sum(F.col("_label") * F.col("_weight")) / F.sum("_weight")).first()[0]]
    counted = rows.groupBy("_label").agg(F.sum("_weight").alias("n"))
    counts = {int(r["_label"]): r["n"] for r in counted.collect()}
    if classes == 2:
        return [math.log(counts[1] / counts[0])]
    total = sum(counts.values())
    return [math.log(counts[c] / total) for c in range(classes)]


def fit_newton(
    ready: DataFrame,
    features: Sequence[str],
    classes: int,
    params: dict[str, Any],
    l1: float = 0.0,
    l2: float = 0.0,
) -> NewtonModel:
    """Boost on ``features``, ``_label`` (a number; with ``classes``, the class number as a double) and
    ``_weight`` (how many rows the row stands for).

    ``params`` are those of ``pyspark.ml`` boosting: ``maxIter``, ``stepSize``, ``seed``, the shape of the
    trees, ``subsamplingRate`` and ``featureSubsetStrategy``.
    """
    if l1 < 0 or l2 < 0:
        raise ValueError("penalties must not be negative")
    shape = {k: v for k, v in params.items() if k not in ("maxIter", "stepSize", "seed")}
    shape.setdefault("featureSubsetStrategy", "all")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    rows = materialise(assembler.transform(ready).select("_features", "_label", "_weight"))
    start = _start(rows, classes)
    gradients, curvatures = _steps(classes)
    width = len(start)
    trees: list[Tree] = []
    rounds = Rounds(ready.sparkSession)

    def stepped(state: DataFrame) -> DataFrame:
        """The margins written with the gradients that they give: every tree reads them, more than once."""
        found = state.select(
            "*",
            *[g.alias(f"_g{c}") for c, g in enumerate(gradients)],
            *[h.alias(f"_h{c}") for c, h in enumerate(curvatures)],
        )
        steps = {f"_step{c}": -F.col(f"_g{c}") / F.col(f"_h{c}") for c in range(width)}
        return found.withColumns({**steps, **{f"_weight{c}": F.col("_weight") * F.col(f"_h{c}") for c in range(width)}})

    state = rounds.write(stepped(rows.withColumn("_margin", F.array(*[F.lit(float(m)) for m in start]))))
    for turn in range(params["maxIter"]):

        def grow(c: int, rows: DataFrame = state, turn: int = turn) -> RandomForestRegressionModel:
            grower = RandomForestRegressor(
                featuresCol="_features", labelCol=f"_step{c}", weightCol=f"_weight{c}", predictionCol=f"_grown{c}",
                leafCol=f"_leaves{c}", numTrees=1, bootstrap=False, **{**shape, "seed": params["seed"] + turn},
            )
            return grower.fit(rows)

        if width == 1:
            grown = [grow(0)]
        else:
            with ThreadPoolExecutor(min(width, _AT_ONCE)) as pool:
                grown = list(pool.map(inheritable_thread_target(ready.sparkSession)(grow), range(width)))
        placed = state
        for model in grown:
            placed = model.transform(placed)
        leaf = [F.get(vector_to_array(f"_leaves{c}"), 0).cast("int").alias(f"_leaf{c}") for c in range(width)]
        placed = placed.select(*state.columns, *leaf)
        parts = [
            F.struct(
                F.lit(c).alias("tree"),
                F.col(f"_leaf{c}").alias("leaf"),
                (F.col("_weight") * F.col(f"_g{c}")).alias("g"),
                F.col(f"_weight{c}").alias("h"),
            )
            for c in range(width)
        ]
        sums = placed.select(F.inline(F.array(*parts))).groupBy("tree", "leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found = {(r["tree"], r["leaf"]): (r["g"], r["h"]) for r in sums.collect()}  # one row per leaf
        moved = []
        for c, model in enumerate(grown):
            text = model.trees[0].toDebugString
            values = [leaf_value(*found.get((c, k), (0.0, 1.0)), l1, l2, params["stepSize"]) for k in range(text.count("Predict:"))]
            trees.append(parse_tree(text, [[v if i == c else 0.0 for i in range(width)] for v in values]))
            moved.append(F.get("_margin", c) + F.get(F.array(*map(F.lit, values)), F.col(f"_leaf{c}")))
        if turn + 1 < params["maxIter"]:
            state = rounds.write(stepped(placed.select("_features", "_label", "_weight", F.array(*moved).alias("_margin"))))
    rounds.close()
    return NewtonModel(list(features), classes, start, trees)
