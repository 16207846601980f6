"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a few statistics, shares and rates brought to a logarithmic scale
and damped by the text's length, so that short texts stay near the middle.  Every
class has its own mean and covariance; a covariance is shrunk towards the one both
classes share, and that towards its diagonal.  The score is the logistic function of
the difference of the two Gaussian log densities, from Mahalanobis distances by
Cholesky factors that are computed once.

The statistics of all texts are one narrow table.  Training joins it with the labels
and adds up counts, sums and products over every labelled row; no sample is taken and
no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.llm.common import id_and_text, short_batches, slices, text_or_empty

NAMES = (
    "capitals", "exclamations", "symbols", "digits", "stops", "repeats",
    "distinct", "word_length", "short_lines",
)
SIZE = len(NAMES)
#: Weight of the shared covariance in each class's, and of the diagonal in the shared one.
CLASS_SHRINKAGE = 0.3
DIAGONAL_SHRINKAGE = 0.1
#: Least standard deviation of a statistic, on its logarithmic scale.
LEAST_DEVIATION = 0.15

_UPPER, _LOWER, _DIGIT = (np.zeros(256), np.zeros(256), np.zeros(256))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_LOWER[128:] = 0.5  # a letter beyond ASCII mostly takes two bytes
_STOPS = np.zeros(256)
_STOPS[[ord(c) for c in ".,;:?"]] = 1
_SYMBOLS = np.zeros(256)
_SYMBOLS[33:127] = 1
_SYMBOLS -= np.minimum(_SYMBOLS, _UPPER + _LOWER + _DIGIT + _STOPS)
_SYMBOLS[[ord(c) for c in "!'\"()-"]] = 0
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _STOPS, _SYMBOLS, np.ones(256)], axis=1)
_CLASSES = np.column_stack([_CLASSES, np.arange(256) == ord("!"), np.arange(256) == ord("\n")])


def statistics(text: str) -> np.ndarray:
    """Transformed statistics of one text; an empty text has those of no evidence."""
    words = text.split()
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper, lower, digits, stops, symbols, size, marks, lines = np.bincount(raw, minlength=256) @ _CLASSES
    count = len(words)
    letters = upper + lower
    repeats = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    return np.array(
        [
            np.log((upper + 4) / (letters + 100)),
            np.log((marks + 0.5) / (count + 50)),
            np.log((symbols + 2) / (count + 50)),
            np.log((digits + 2) / (size + 200)),
            np.log((stops + 5) / (count + 50)),
            np.log((repeats + 1) / (count + 50)),
            np.log((distinct + 10) / (count**0.9 + 10)),
            np.log((letters + 100) / (count + 20)),
            np.log((lines + 1) / (count + 50)),
        ]
    )


def features(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, SIZE)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    means: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
        """From the count, sum and sum of outer products of each class (0, then 1)."""
        if not counts.all():
            return cls(np.zeros((2, SIZE)), np.zeros((2, SIZE, SIZE)), np.zeros(2))
        means = sums / counts[:, None]
        own = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.tensordot(counts / counts.sum(), own, 1)
        floor = LEAST_DEVIATION**2 * np.eye(SIZE)
        target = (1 - DIAGONAL_SHRINKAGE) * pooled + DIAGONAL_SHRINKAGE * np.diag(np.diag(pooled))
        covariance = (1 - CLASS_SHRINKAGE) * own + CLASS_SHRINKAGE * target + floor
        factors = np.linalg.cholesky(covariance)
        log_det = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
        prior = np.log(counts / counts.sum())
        return cls(means, np.linalg.inv(factors), prior - log_det / 2)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        logs = []
        for mean, inverse, constant in zip(self.means, self.inverse, self.constant):
            z = (x - mean) @ inverse.T
            logs.append(constant - (z * z).sum(axis=1) / 2)
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -700, 700)))


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id`` and ``x``, its transformed statistics."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = pa.array(features(batch.column("text").to_pylist()).ravel())
            places = pa.array(np.arange(batch.num_rows + 1) * SIZE, pa.int32())
            rows = pa.ListArray.from_arrays(places, flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), rows], ["id", "x"])

    return id_and_text(df, id_col, text_col).mapInArrow(work, "id bigint, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, SIZE)


def one_label_each(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``id, label`` of a label table: null ids and labels other than 0 and 1 are left
    out, and of repeated labels the smallest counts."""
    return (
        labels.select(col(id_col).cast("bigint").alias("id"), col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )


def train(statistics: DataFrame, marks: DataFrame) -> Discriminant:
    """Fit on every row of ``statistics (id, x)`` that ``marks (id, label)`` covers.

    Without rows of both labels the model knows nothing and scores 0.5.
    """
    width = 1 + SIZE + SIZE * SIZE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            x, y = _matrix(batch), batch.column("label").to_numpy()
            for label in (0, 1):
                own = x[y == label]
                total[label] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        for label in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(width, label), pa.int32()),
                    pa.array(np.arange(width), pa.int32()),
                    pa.array(total[label]),
                ],
                ["label", "at", "value"],
            )

    rows = statistics.join(marks, "id").select("label", "x")
    parts = rows.mapInArrow(work, "label int, at int, value double").groupBy("label", "at").sum("value")
    total = np.zeros((2, width))
    for row in parts.collect():  # one row for each entry of the classes' moments
        total[row["label"], row["at"]] = row["sum(value)"]
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + SIZE], total[:, 1 + SIZE :].reshape(2, SIZE, SIZE))


def score(statistics: DataFrame, model: Discriminant) -> DataFrame:
    """``id, score`` for each row of ``statistics (id, x)``; higher where class 1 is likelier.

    Null text counts as empty, and an empty text has a score as well.  Ids may be
    null or repeat; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.score(_matrix(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "score"])

    return statistics.mapInArrow(work, "id bigint, score double")


def keep_good(df: DataFrame, model: Discriminant, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` with all its columns, less the rows whose text scores under ``least``."""
    short_batches(df.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        parts = [model.score(features(texts[i : i + 256].tolist())) for i in range(0, len(texts), 256)]
        return pd.Series(np.concatenate([*parts, np.zeros(0)]) >= least)

    return df.where(good(text_or_empty(text_col)))
