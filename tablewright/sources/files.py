"""File listings and the catalogue of a run's artefacts, read through Spark's file source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import union_all


def list_files(
    spark: SparkSession, directory: str, pattern: str = "*.csv", recursive: bool = False
) -> DataFrame:
    """Matching files with name, extension, parent, sizes and modification time.

    Only file status is read, never content.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(directory)
        .select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        name.alias("name"),
        F.regexp_extract(name, r".(\.[^.]+)$", 1).alias("extension"),
        F.regexp_replace("path", "/[^/]*$", "").alias("parent"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / 1024, 2).alias("size_kb"),
        F.round(F.col("length") / 1024 / 1024, 2).alias("size_mb"),
        F.col("modificationTime").alias("modified"),
    )


def catalog_run(
    spark: SparkSession, run_id: str, directory: str, final_predictions: str, report: str = ""
) -> DataFrame:
    """``(run_id, kind, path, bytes, text)``: final predictions, models, predictions, report.

    Models are the ``model_*`` files and folders at the top of ``directory``,
    predictions the ``predictions_*`` ones.
    """

    def listed(kind: str, path: str) -> DataFrame:
        files = list_files(spark, path, "*", recursive=True)
        return files.select(
            F.lit(kind).alias("kind"),
            "path",
            F.col("size_bytes").alias("bytes"),
            F.lit(None).cast("string").alias("text"),
        )

    frames = [listed("final_predictions", final_predictions)]
    root = spark._jvm.org.apache.hadoop.fs.Path(directory)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = files.makeQualified(root).toUri().getPath().rstrip("/")
    below = F.element_at(F.split("path", re.escape(base) + "/", 2), -1)
    inside = list_files(spark, directory, "*", recursive=True)
    for kind, prefix in (("model", "model_"), ("predictions", "predictions_")):
        part = inside.where(below.startswith(prefix))
        frames.append(
            part.select(
                F.lit(kind).alias("kind"),
                "path",
                F.col("size_bytes").alias("bytes"),
                F.lit(None).cast("string").alias("text"),
            )
        )
    if report.strip():
        row = spark.createDataFrame(
            [("report", "", len(report.encode()), report)],
            "kind string, path string, bytes bigint, text string",
        )
        frames.append(row)
    return union_all(frames).select(F.lit(run_id).alias("run_id"), "kind", "path", "bytes", "text")
