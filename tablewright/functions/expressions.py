"""Reusable column expressions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(keys: Sequence[Column], seed: int) -> Column:
    """Hex digest that orders rows pseudo-randomly but repeatably.

    Each key enters with its length and NULL with a mark of its own, so different
    keys never give the same text.
    """
    parts = [F.lit(str(seed))]
    for key in keys:
        text = key.cast("string")
        parts.append(
            F.when(text.isNull(), ":n").otherwise(
                F.concat(F.lit(":"), F.length(text).cast("string"), F.lit("="), text)
            )
        )
    return F.md5(F.concat(*parts))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector scaled to length one (NULL for a zero vector)."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def threshold(prediction: Column, dtype: str, cut: float = 0.5) -> Column:
    """0/1 label from a floating prediction; other types pass through."""
    if dtype in ("float", "double"):
        return F.when(prediction.isNull(), None).otherwise((prediction > cut).cast("int"))
    return prediction


def mean_of_map(scores: Column) -> Column:
    """Mean of the map's values, NULL for an empty or NULL map."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(scores) > 0, total / F.size(scores))
