"""Boosted-tree training and scoring on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    NUMERIC_TYPES,
    as_rows,
    col,
    one_row,
    require_columns,
    union_all,
)
from tablewright.functions.expressions import key_hash
from tablewright.operators.boosting import NewtonModel, fit_newton
from tablewright.operators.metrics import evaluate, roc_auc
from tablewright.session import checkpoint_dir, materialise

TASKS = ("classification", "regression")


@dataclass(frozen=True)
class Family:
    """Option names of one boosted-tree profile and its default tree shape."""

    rounds: str
    depth: str
    columns: str
    l1: str | None
    l2: str
    shape: dict[str, Any]


# The option names of the three profiles.  All learn 100 rounds at
# rate 0.1 with seed 42 unless told otherwise.
FAMILIES = {
    "gbt_a": Family(
        "iterations",
        "depth",
        "colsample_bylevel",
        None,
        "l2_leaf_reg",
        {"maxDepth": 6, "maxBins": 255, "minInstancesPerNode": 1},
    ),
    "gbt_b": Family(
        "num_iterations",
        "max_depth",
        "colsample_bytree",
        "reg_alpha",
        "reg_lambda",
        {"maxDepth": 5, "maxBins": 255, "minInstancesPerNode": 20},
    ),
    "gbt_c": Family(
        "n_estimators",
        "max_depth",
        "colsample_bytree",
        "reg_alpha",
        "reg_lambda",
        {"maxDepth": 6, "maxBins": 256, "minInstancesPerNode": 1},
    ),
}


def tree_params(family: str, options: dict[str, Any], seed: int = 42) -> dict[str, Any]:
    """Estimator parameters for a profile, ``l1`` and ``l2`` among them where a penalty is asked for."""
    if family not in FAMILIES:
        raise ValueError(f"Unknown family: {family}")
    profile = FAMILIES[family]
    params = {"maxIter": 100, "stepSize": 0.1, "seed": seed, **profile.shape}
    for name, value in options.items():
        if value is None:
            continue
        if name == profile.rounds:
            params["maxIter"] = int(value)
        elif name == "learning_rate":
            params["stepSize"] = float(value)
        elif name == profile.depth:
            params["maxDepth"] = int(value)
        elif name == "subsample":
            params["subsamplingRate"] = float(value)
        elif name == profile.columns:
            params["featureSubsetStrategy"] = str(float(value)) if value < 1 else "all"
        elif name in (profile.l1, profile.l2):
            if value < 0:
                raise ValueError(f"{name} must not be negative")
            if value:
                params["l1" if name == profile.l1 else "l2"] = float(value)
        else:
            raise ValueError(f"Unknown option for {family}: {name}")
    return params


@dataclass
class TabularModel:
    """A fitted pipeline, or penalised or joint trees, with what is needed to score a table."""

    pipeline: PipelineModel | None
    family: str
    task_type: str
    target: str
    features: list[str]
    classes: list[Any] = field(default_factory=list)
    booster: NewtonModel | None = None

    @property
    def zero_one(self) -> bool:
        return set(self.classes) == {0, 1}

    def score(
        self,
        df: DataFrame,
        key_cols: Sequence[str],
        keep: Sequence[str] = (),
        probability: bool = False,
    ) -> DataFrame:
        """``key_cols``, ``keep`` and ``prediction`` (the class itself, or a number).

        ``probability`` adds that of the larger class of a two-class model.
        """
        require_columns(df, [*self.features, *key_cols, *keep])
        names = list(dict.fromkeys([*key_cols, *keep]))
        wanted = list(dict.fromkeys([*names, *self.features]))
        rows = df.select(*[col(c) for c in wanted])
        scored = self.booster.transform(rows) if self.booster else self.pipeline.transform(rows)
        value = F.col("_prediction")
        if self.task_type == "classification":
            labels = F.array(*[F.lit(c) for c in self.classes])
            value = F.element_at(labels, value.cast("int") + 1)
        output = [*[col(c) for c in names], value.alias("prediction")]
        if probability:
            if len(self.classes) != 2:
                raise ValueError("probability needs a two-class model")
            both = F.col("_probability") if self.booster else vector_to_array("_probability")
            output.append(F.get(both, 1).alias("probability"))
        return scored.select(*output)


@dataclass
class TrainResult:
    model: TabularModel
    train_metrics: DataFrame
    test_metrics: DataFrame | None
    predictions: DataFrame


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features and target."""
    require_columns(df, [target])
    return df.drop(target), df.select(col(target))


def target_classes(df: DataFrame, target: str) -> list[Any]:
    found = df.select(col(target).alias("v")).distinct().collect()  # a model for each
    values = [row["v"] for row in found]
    if None in values:
        raise ValueError(f"Target {target} holds nulls")
    return sorted(values)


def _collapses(params: dict[str, Any], task_type: str, newton: bool) -> bool:
    """Whether equal rows can be learnt from as one row with a weight.

    Not where rows are drawn one by one, and not where leaves need a number of rows
    that weights do not show (those of a Newton step for classes are curvatures).
    """
    if params.get("subsamplingRate", 1.0) < 1:
        return False
    return params["minInstancesPerNode"] <= 1 or not (newton and task_type == "classification")


def collapsed(ready: DataFrame, features: Sequence[str], task_type: str) -> DataFrame:
    """One row per set of equal features: ``features``, ``_label`` and the number of rows as ``_weight``.

    Classes stay apart.  Of numbers the mean is kept: squared errors around it are the
    same for every tree, so sums, splits and leaf values stay as they are (up to the
    rounding of sums).  A NULL label stays NULL.  Counted before the shuffle, so that
    many equal rows do not meet in one task; placed and sorted by value.
    """
    names = [col(f) for f in features]
    rows = F.count(F.lit(1))
    if task_type == "classification":
        names.append(F.col("_label"))
        counted = ready.groupBy(*names).agg(rows.cast("double").alias("_weight"))
    else:
        mean = F.when(F.count("_label") == rows, F.avg("_label"))
        counted = ready.groupBy(*names).agg(mean.alias("_label"), rows.cast("double").alias("_weight"))
    # placed by a hash of its own, so that small tables become few partitions and large ones many
    return materialise(counted.repartition(F.xxhash64(*names)).sortWithinPartitions(*names))


def fit(
    train_df: DataFrame,
    target: str,
    task_type: str,
    family: str = "gbt_a",
    exclude: Sequence[str] = (),
    key_cols: Sequence[str] = (),
    seed: int = 42,
    **options: Any,
) -> TabularModel:
    """Fit one model.  Every column but the target is a feature unless excluded.

    Rows with equal features are learnt from as one weighted row (``collapsed``) where
    that changes nothing.  Other rows are placed by key first with ``key_cols``, so the
    same data gives the same model however its files are cut.  Nulls are an error: impute first.
    Penalties on leaf values, and more than two classes, are learnt by Newton
    boosting (``boosting``), the classes jointly; all else by ``pyspark.ml``.
    """
    if task_type not in TASKS:
        raise ValueError(f"Unknown task_type: {task_type}")
    require_columns(train_df, [target, *key_cols])
    skipped = {target, *exclude}
    dtypes = dict(train_df.dtypes)
    features = [c for c in train_df.columns if c not in skipped]
    text = [c for c in features if dtypes[c] not in (*NUMERIC_TYPES, "boolean")]
    if text:
        raise ValueError(f"Encode or exclude non-numeric columns first: {text}")
    if not features:
        raise ValueError("No feature columns")
    params = tree_params(family, options, seed)
    ready = train_df.select(*[col(c) for c in dict.fromkeys([*key_cols, *features, target])])
    classes: list[Any] = []
    if task_type == "classification":
        classes = target_classes(train_df, target)
        if len(classes) < 2:
            raise ValueError(f"Target {target} needs at least two classes")
        index: Column = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target)) - 1
    else:
        index = col(target)
    ready = ready.withColumn("_label", index.cast("double"))
    checkpoint_dir(train_df.sparkSession)  # tree growing cuts its lineage there
    penalties = {k: params.pop(k) for k in ("l1", "l2") if k in params}
    newton = bool(penalties) or len(classes) > 2
    fewest = params["minInstancesPerNode"]
    if _collapses(params, task_type, newton):
        ready = collapsed(ready, features, task_type)
        if fewest > 1:  # rows are weights now; half a row less, for sums are rounded
            share = (fewest - 0.5) / (ready.agg(F.sum("_weight")).first()[0] or 1)
            params |= {"minInstancesPerNode": 1, "minWeightFractionPerNode": min(share, 0.4999999)}
    else:
        ready = ready.withColumn("_weight", F.lit(1.0))
        if key_cols:
            keys = [col(k) for k in key_cols]
            parts = int(train_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            ready = ready.repartition(parts, *keys).sortWithinPartitions(*keys)
    if newton:
        booster = fit_newton(ready, features, len(classes), params, **penalties)
        return TabularModel(None, family, task_type, target, features, classes, booster)
    names = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction", "weightCol": "_weight"}
    if classes:
        estimator = GBTClassifier(cacheNodeIds=True, **names, **params)
        estimator = estimator.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    else:
        estimator = GBTRegressor(cacheNodeIds=True, **names, **params)
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error")
    pipeline = Pipeline(stages=[assembler, estimator]).fit(ready)
    return TabularModel(pipeline, family, task_type, target, features, classes)


def train(
    train_df: DataFrame,
    test_df: DataFrame,
    target: str,
    task_type: str,
    key_cols: Sequence[str],
    family: str = "gbt_a",
    exclude: Sequence[str] | None = None,
    seed: int = 42,
    use_probability: bool = False,
    **options: Any,
) -> TrainResult:
    """Fit, measure on train, score test, and measure there too when it has the target.

    The AUC is that of the predicted classes, or with ``use_probability`` that of
    the probability of the larger class.
    """
    skipped = list(key_cols) if exclude is None else list(exclude)
    model = fit(train_df, target, task_type, family, skipped, key_cols, seed, **options)

    ranked = use_probability and len(model.classes) == 2

    def measured(df: DataFrame) -> DataFrame:
        scored = model.score(df, key_cols, [target], probability=ranked)
        found = evaluate(scored, task_type, target, "prediction", zero_one=model.zero_one)
        if not ranked:
            return found
        positive = (col(target) == F.lit(model.classes[1])).cast("int")
        auc = roc_auc(scored.select(positive.alias("label"), "probability"), score="probability")
        return one_row([found.drop("roc_auc"), auc])

    test_metrics = measured(test_df) if target in test_df.columns else None
    return TrainResult(model, measured(train_df), test_metrics, model.score(test_df, key_cols))


def metrics_long(metrics: DataFrame, **labels: str) -> DataFrame:
    """A one-row metrics frame as ``(labels..., metric, value)``."""
    names = [F.lit(v).alias(k) for k, v in labels.items()]
    rows = [
        {"metric": F.lit(c), "value": F.col(c).cast("double")} for c in metrics.columns
    ]
    return as_rows(metrics, rows).select(*names, "metric", "value")


def select_best(
    candidates: DataFrame, name: str, metric: str, larger_is_better: bool = True
) -> DataFrame:
    """The candidate row with the best metric; ties go to the smaller name."""
    require_columns(candidates, [name, metric])
    score = col(metric) if larger_is_better else -col(metric)
    return (
        candidates.where(col(metric).isNotNull())
        .orderBy(score.desc(), col(name).asc())
        .limit(1)
    )


def cross_validation_folds(df: DataFrame, key_cols: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1 from a hash of the key: narrow, stable under any partitioning."""
    if k < 2:
        raise ValueError(f"k must be at least 2, got {k}")
    digest = key_hash([col(c) for c in require_columns(df, key_cols)], seed)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (number % k).cast("int"))


def cross_validate(
    df: DataFrame,
    target: str,
    task_type: str,
    key_cols: Sequence[str],
    k: int = 5,
    family: str = "gbt_a",
    seed: int = 42,
    **options: Any,
) -> DataFrame:
    """``(fold, metric, value)`` with one model per fold."""
    folded = cross_validation_folds(df, key_cols, k, seed)
    parts = []
    for fold in range(k):
        rest = folded.where(F.col("fold") != fold).drop("fold")
        held = folded.where(F.col("fold") == fold).drop("fold")
        result = train(
            rest, held, target, task_type, key_cols, family, seed=seed, **options
        )
        parts.append(metrics_long(result.test_metrics, fold=str(fold)))
    return union_all(parts)


def tune(
    train_df: DataFrame,
    valid_df: DataFrame,
    target: str,
    task_type: str,
    key_cols: Sequence[str],
    grid: Sequence[dict[str, Any]],
    family: str = "gbt_a",
    seed: int = 42,
) -> DataFrame:
    """``(trial, options, metric, value)`` for every option set in ``grid``."""
    parts = []
    for trial, options in enumerate(grid):
        result = train(
            train_df, valid_df, target, task_type, key_cols, family, seed=seed, **options
        )
        parts.append(
            metrics_long(result.test_metrics, trial=str(trial), options=repr(sorted(options.items())))
        )
    return union_all(parts)
