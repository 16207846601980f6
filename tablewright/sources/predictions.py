"""Prediction tables: ``(run_id, model, key..., prediction)``, one folder per run and model."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import require_columns


def new_run_id() -> str:
    """Sorts by time: microseconds since 1970 in hex, then random digits."""
    return f"{time.time_ns() // 1_000:014x}-{uuid.uuid4().hex[:12]}"


def _with_predictions(df: DataFrame) -> DataFrame:
    if "prediction" not in df.columns:
        raise ValueError(f"not a prediction table: it has only {', '.join(df.columns)}")
    return df


def write_predictions(
    predictions: DataFrame, path: str, model: str, run_id: str | None = None
) -> str:
    """Append one model's predictions; returns the run id."""
    require_columns(predictions, ["prediction"])
    run_id = run_id or new_run_id()
    labelled = predictions.withColumns({"run_id": F.lit(run_id), "model": F.lit(model)})
    labelled.write.mode("append").partitionBy("run_id", "model").parquet(path)
    return run_id


def read_predictions(
    spark: SparkSession, path: str, run_id: str | None = None, model: str | None = None
) -> DataFrame:
    """Read predictions, of one run and model if given (only those folders are read)."""
    df = _with_predictions(spark.read.parquet(path))
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    if model is not None:
        df = df.where(F.col("model") == model)
    return df


def extract_predictions(df: DataFrame) -> DataFrame:
    return _with_predictions(df).select("prediction")
