"""Model metrics over ``(label, prediction)`` columns.

Classification metrics all come from the confusion counts: one grouped count
that collapses before its shuffle, after which only class pairs remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, one_row, require_columns
from tablewright.functions.expressions import threshold
from tablewright.operators.ranking import SMALL_ROWS, running_before
from tablewright.session import materialise


def harmonise_labels(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Both columns as text, so that 1 and "1" compare equal."""
    require_columns(df, [label, prediction])
    return df.withColumns(
        {label: col(label).cast("string"), prediction: col(prediction).cast("string")}
    )


def thresholded(df: DataFrame, prediction: str = "prediction", cut: float = 0.5) -> DataFrame:
    """Floating predictions become 0/1; integer and text predictions stay."""
    dtype = dict(df.dtypes)[require_columns(df, [prediction])[0]]
    return df.withColumn(prediction, threshold(col(prediction), dtype, cut))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` per pair of classes."""
    require_columns(df, [label, prediction])
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _per_class(cells: DataFrame) -> DataFrame:
    """``(class, tp, support, predicted)`` from confusion counts."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    hit.alias("tp"),
                    n.alias("support"),
                    zero.alias("predicted"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    zero.alias("tp"),
                    zero.alias("support"),
                    n.alias("predicted"),
                ),
            )
        )
    )
    return sides.groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _with_scores(classes: DataFrame) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return classes.withColumns(
        {
            "precision": _ratio(tp, predicted),
            "recall": _ratio(tp, support),
            "f1": _ratio(2 * tp, support + predicted),
        }
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy with the number of correct and of all rows."""
    require_columns(df, [label, prediction])
    correct = F.count(F.when(col(label) == col(prediction), 1))
    total = F.count(F.lit(1))
    return df.agg(
        F.try_divide(correct, total).alias("accuracy"),
        correct.alias("correct"),
        total.alias("total"),
    )


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: F1 per class weighted by its support, 0 where undefined."""
    classes = _with_scores(_per_class(confusion(df, label, prediction)))
    return classes.agg(
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1")
    )


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages."""
    classes = _with_scores(_per_class(confusion(df, label, prediction)))
    scores = ("precision", "recall", "f1")
    weight = F.col("support")

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * weight), F.sum(weight))

    # one pass: each class row also joins the two averages
    kinds = classes.withColumn("class", F.col("class").cast("string")).withColumn(
        "kind", F.explode(F.array(F.lit("class"), F.lit("macro avg"), F.lit("weighted avg")))
    )
    name = F.when(F.col("kind") == "class", F.col("class")).otherwise(F.col("kind"))
    grouped = kinds.groupBy("kind", name.alias("class")).agg(
        *[
            F.when(F.first("kind") == "weighted avg", weighted(c)).otherwise(F.avg(c)).alias(c)
            for c in scores
        ],
        F.sum("support").alias("support"),
    )
    return grouped.select("kind", "class", *scores, "support")


def _hard_auc() -> Column:
    """AUC of hard labels: with two classes it is the mean of their recalls."""
    binary = (F.count(F.lit(1)) == 2) & (F.min("support") > 0)
    return F.when(binary, F.avg("recall"))


def hard_roc_auc(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: AUC of predicted classes, NULL unless there are exactly two classes."""
    classes = _with_scores(_per_class(confusion(df, label, prediction)))
    return classes.agg(_hard_auc().alias("roc_auc"))


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "prediction", small: int = SMALL_ROWS
) -> DataFrame:
    """AUC of numeric scores for 0/1 labels, ties counting half; NULL for a single class.

    Rows are first summed per distinct score; the positives above each score
    come from a bucketed running total, not from a global sort.
    """
    require_columns(df, [label, score])
    positive = col(label).cast("double") > 0
    per_score = materialise(
        df.groupBy(col(score).cast("double").alias("score")).agg(
            F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("q")
        )
    )
    ranked = running_before(
        per_score, "score", {"above": F.col("p")}, per_score.count(), descending=True, small=small
    )
    wins = F.sum(F.col("q") * (F.col("above") + F.col("p") / 2))
    pairs = F.sum("p").cast("double") * F.sum("q")
    return ranked.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: RMSE, R2 and MAE in one pass; R2 is NULL for a constant label."""
    require_columns(df, [label, prediction])
    y, p = col(label).cast("double"), col(prediction).cast("double")
    error = y - p
    known = error.isNotNull()
    residual = F.sum(error * error)
    spread = F.var_pop(F.when(known, y)) * F.count(error)
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(residual, spread)).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
    )


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("rmse")


def r2(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("r2")


def mae(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("mae")


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: accuracy, weighted F1, averaged precision and recall, hard-label AUC."""
    classes = _with_scores(_per_class(confusion(df, label, prediction)))
    weight = F.col("support")
    return classes.agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[
            F.try_divide(F.sum(F.col(c) * weight), F.sum(weight)).alias(c)
            for c in ("f1", "precision", "recall")
        ],
        _hard_auc().alias("roc_auc"),
    )


def evaluate(
    df: DataFrame,
    task_type: str,
    label: str = "label",
    prediction: str = "prediction",
    zero_one: bool = True,
) -> DataFrame:
    """Metrics of a task.

    Floating predictions of 0/1 classes are cut at one half, except for the AUC,
    which ranks them as they are.
    """
    if task_type == "classification":
        if not zero_one or dict(df.dtypes)[prediction] not in ("float", "double"):
            return classification_metrics(df, label, prediction)
        hard = classification_metrics(thresholded(df, prediction), label, prediction)
        return one_row([hard.drop("roc_auc"), roc_auc(df, label, prediction)])
    if task_type == "regression":
        return regression_metrics(df, label, prediction)
    raise ValueError(f"Unknown task_type: {task_type}")
