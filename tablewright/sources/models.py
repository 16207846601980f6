"""Saving and loading fitted models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tablewright.operators.boosting import NewtonModel
from tablewright.operators.models import TabularModel
from tablewright.sources.predictions import new_run_id


def model_path(directory: str, family: str) -> str:
    """Unique path for a model of this family."""
    return f"{directory}/model_{family}_{new_run_id()}"


def save_model(model: TabularModel, directory: str) -> str:
    spark = SparkSession.getActiveSession()
    path = model_path(directory, model.family)
    if model.booster:
        trees = spark.createDataFrame([(model.booster.to_json(),)], "value string")
        trees.coalesce(1).write.text(f"{path}/booster")
    else:
        model.pipeline.write().overwrite().save(f"{path}/pipeline")
    about = {
        "boosted_here": model.booster is not None,
        "family": model.family,
        "task_type": model.task_type,
        "target": model.target,
        "features": model.features,
        "classes": model.classes,
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(
        f"{path}/about"
    )
    return path


def load_model(spark: SparkSession, path: str) -> TabularModel:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if about.pop("boosted_here", False):
        trees = spark.read.text(f"{path}/booster").first()["value"]
        return TabularModel(None, **about, booster=NewtonModel.of_json(trees))
    return TabularModel(PipelineModel.load(f"{path}/pipeline"), **about)
