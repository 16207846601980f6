"""Experience store: past solution reports with their scores, found again by similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import materialise
from tablewright.functions.columns import require_columns
from tablewright.functions.expressions import mean_of_map, norm

# Record layouts.
EVALUATION = "score double, rubric_scores map<string,double>, feedback string"
ENTRY = (
    "entry_id string, document string, embedding array<float>, iteration int, "
    "critic_score double, accepted boolean, critic_evaluation string, "
    "timestamp timestamp, task_type string"
)


def report_text(
    analysis: Column, preprocessing: Column, training: Column, results: Column
) -> Column:
    """One text of four headed sections; a missing section is empty."""
    sections = (
        ("Data Analysis", analysis),
        ("Preprocessing", preprocessing),
        ("Model Training", training),
        ("Results", results),
    )
    return F.concat_ws(
        "\n\n",
        *[F.concat(F.lit(f"# {title}\n"), F.coalesce(text, F.lit(""))) for title, text in sections],
    )


def rubric_score(scores: Column, given: Column) -> Column:
    """Mean of the rubric scores, or the given score when there are none."""
    return F.coalesce(mean_of_map(scores), given)


def parse_evaluations(entries: DataFrame) -> DataFrame:
    """Entries with their evaluation read from JSON; unreadable ones are left out.

    ``score`` is the stored score or else the one inside the JSON, ``accepted``
    defaults to false.
    """
    require_columns(entries, ["critic_evaluation", "critic_score", "accepted"])
    # a generator is evaluated once per row; a plain column would be parsed again by every user
    once = F.explode(F.array(F.from_json("critic_evaluation", EVALUATION)))
    parsed = entries.select("*", once.alias("_e"))
    readable = F.col("_e.score").isNotNull() & F.col("_e.feedback").isNotNull()
    return parsed.where(readable).select(
        *entries.columns,
        F.coalesce("critic_score", "_e.score").alias("score"),
        F.coalesce("accepted", F.lit(False)).alias("was_accepted"),
        F.col("_e.rubric_scores").alias("rubric_scores"),
        F.col("_e.feedback").alias("feedback"),
    )


def actor_view(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "iteration",
        F.col("was_accepted").alias("accepted"),
        F.col("document").alias("actions_summary"),
        F.col("feedback").alias("feedback_received"),
    )


def critic_view(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "iteration",
        "score",
        F.col("document").alias("actions_observed"),
        F.col("feedback").alias("feedback_given"),
    )


def similar(
    entries: DataFrame,
    query: Sequence[float],
    k: int = 5,
    where: Column | None = None,
    vector: str = "embedding",
    key: str = "entry_id",
) -> DataFrame:
    """The ``k`` entries closest to ``query`` by cosine, with their ``similarity``.

    One scan with a bounded top-k; ties go to the smaller key.  Entries whose
    vector has another length, holds a NULL or is zero have no cosine and are no hits.
    """
    if k <= 0:
        raise ValueError(f"k must be > 0, got {k}")
    require_columns(entries, [vector, key])
    if where is not None:
        entries = entries.where(where)
    length = sum(float(q) * float(q) for q in query) ** 0.5
    # one literal array, multiplied element by element inside the JVM
    target = F.lit([float(q) for q in query])
    products = F.zip_with(F.col(vector), target, lambda x, y: x.cast("double") * y)
    product = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    cosine = F.try_divide(product, norm(F.col(vector)) * F.lit(length))
    fits = F.size(F.col(vector)) == len(query)
    scored = entries.where(fits).withColumn("similarity", cosine).where("similarity is not null")
    return scored.orderBy(F.desc_nulls_last("similarity"), F.asc(key)).limit(k)


class ExperienceStore:
    """Parquet table of entries, one folder per task type, appended to and searched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def append(self, entries: DataFrame) -> None:
        """Add entries ``(document, embedding, task_type, iteration, score, rubric_scores,
        feedback[, accepted])``; id and time are filled in."""
        require_columns(
            entries,
            ["document", "embedding", "task_type", "iteration", "score", "rubric_scores", "feedback"],
        )
        accepted = F.col("accepted") if "accepted" in entries.columns else F.lit(False)
        evaluation = F.to_json(F.struct("score", "rubric_scores", "feedback"))
        entries.select(
            F.expr("uuid()").alias("entry_id"),
            "document",
            F.col("embedding").cast("array<float>").alias("embedding"),
            F.col("iteration").cast("int").alias("iteration"),
            F.col("score").cast("double").alias("critic_score"),
            F.coalesce(accepted, F.lit(False)).alias("accepted"),
            evaluation.alias("critic_evaluation"),
            F.current_timestamp().alias("timestamp"),
            "task_type",
        ).write.mode("append").partitionBy("task_type").parquet(self.path)

    def entries(self) -> DataFrame:
        """All entries; empty before the first append."""
        try:
            return self.spark.read.schema(ENTRY).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], ENTRY)
            raise

    def retrieve(
        self, query: Sequence[float], task_type: str, k: int = 5
    ) -> tuple[DataFrame, DataFrame]:
        """The two views of the ``k`` most similar entries of one task type."""
        hits = materialise(similar(self.entries(), query, k, F.col("task_type") == task_type))
        parsed = parse_evaluations(hits)
        return actor_view(parsed), critic_view(parsed)

    def clear(self) -> None:
        """Empty the store."""
        empty = self.spark.createDataFrame([], ENTRY)
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path)
