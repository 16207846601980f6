"""Training runs: model, predictions, predictions with truth and metrics, made visible at once.

Everything of a run is written below a folder of its own.  A manifest, put in place by
a rename when all the rest is there, makes the run visible; a run that broke off has no
manifest, and readers pass over it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablewright.functions.columns import union_all
from tablewright.operators.models import TabularModel, TrainResult, metrics_long, train
from tablewright.sources.models import load_model, save_model
from tablewright.sources.predictions import new_run_id

_MANIFEST = "manifest.json"


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _commit(spark: SparkSession, folder: str, manifest: dict[str, Any]) -> None:
    files, part = _files(spark, f"{folder}/_{_MANIFEST}")
    out = files.create(part, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not files.rename(part, _files(spark, f"{folder}/{_MANIFEST}")[1]):
        raise OSError(f"cannot put the manifest of {folder} in place")


def write_run(
    result: TrainResult,
    train_rows: DataFrame,
    test_rows: DataFrame,
    key_cols: Sequence[str],
    directory: str,
) -> str:
    """Write all that a training gave; returns the run id.

    ``scored`` (predictions with truth) and the metrics of the test are there only
    where ``test_rows`` holds the target.
    """
    spark = train_rows.sparkSession
    run_id, target = new_run_id(), result.model.target
    folder = f"{directory}/{run_id}"
    parts = {"model": save_model(result.model, f"{folder}/model")[len(folder) + 1 :]}
    metrics = [metrics_long(result.train_metrics, part="train")]
    tables = {"predictions": result.predictions}
    if target in test_rows.columns:
        tables["scored"] = result.model.score(test_rows, key_cols, [target])
        metrics.append(metrics_long(result.test_metrics, part="test"))
    tables["summary"] = union_all(metrics)
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
        parts[name] = name
    about = {"target": target, "task_type": result.model.task_type, "family": result.model.family}
    _commit(spark, folder, {"run_id": run_id, **about, "keys": list(key_cols), "parts": parts})
    return run_id


def train_run(
    train_df: DataFrame,
    test_df: DataFrame,
    target: str,
    task_type: str,
    key_cols: Sequence[str],
    directory: str,
    **options: Any,
) -> tuple[str, TrainResult]:
    """Train (see ``models.train``), write the run and return its id with the result."""
    result = train(train_df, test_df, target, task_type, key_cols, **options)
    return write_run(result, train_df, test_df, key_cols, directory), result


def list_runs(spark: SparkSession, directory: str) -> list[dict[str, Any]]:
    """Manifests of the finished runs of a directory, oldest first."""
    files, pattern = _files(spark, f"{directory}/*/{_MANIFEST}")
    found = sorted(str(status.getPath()) for status in files.globStatus(pattern) or [])
    return [json.loads(row["value"]) for path in found for row in spark.read.text(path).collect()]


def _manifest(spark: SparkSession, directory: str, run_id: str) -> dict[str, Any]:
    files, place = _files(spark, f"{directory}/{run_id}/{_MANIFEST}")
    if not files.exists(place):
        raise ValueError(f"no finished run {run_id}")
    return json.loads(spark.read.text(str(place)).first()["value"])


def read_run(spark: SparkSession, directory: str, run_id: str, part: str) -> DataFrame:
    """``predictions``, ``scored`` or ``summary`` of a finished run."""
    parts = _manifest(spark, directory, run_id)["parts"]
    if part == "model" or part not in parts:
        raise ValueError(f"run {run_id} has no table {part}")
    return spark.read.parquet(f"{directory}/{run_id}/{parts[part]}")


def read_run_model(spark: SparkSession, directory: str, run_id: str) -> TabularModel:
    return load_model(spark, f"{directory}/{run_id}/{_manifest(spark, directory, run_id)['parts']['model']}")
