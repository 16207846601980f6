"""Exact, repeatable train/test splits.

Rows are ordered by ``md5(seed:key)`` and cut at an exact rank.  The digest at
the cut is found by counting digests by their leading hex digits, level by
level, so no task ever sorts the table: four digits leave a 65,536th of it, eight
a four-billionth.  The split itself is then a plain filter on the digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.functions.expressions import key_hash
from tablewright.session import broadcast_if_small, materialise

SMALL_ROWS = 100_000
_DIGITS = 4
_COPY_BLOCK = 1_000_000


def shuffle(df: DataFrame, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows in a repeatable pseudo-random order (a range-partitioned sort)."""
    keys = [col(c) for c in require_columns(df, key_cols)]
    return df.orderBy(key_hash(keys, seed), *keys)


def _cut_level(counted: DataFrame, part: str, need: str) -> DataFrame:
    """Per group, the ``part`` in which the rank ``need`` falls, and the rank inside it."""
    before = (
        Window.partitionBy("_group").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = (F.col("_before") < F.col(need)) & (F.col(need) <= F.col("_before") + F.col("_n"))
    return placed.where(inside).select(
        "_group", part, (F.col(need) - F.col("_before")).alias("_need"), "_n"
    )


def _settled(cuts: DataFrame) -> DataFrame:
    """One row per group, kept apart from the plan that found it."""
    return broadcast_if_small(materialise(cuts))


def find_cuts(digests: DataFrame, test_size: float, small: int = SMALL_ROWS) -> DataFrame:
    """Per group ``(_group, _cut, _take, _same)``: the last digest of the train part.

    ``_same`` rows carry that digest and ``_take`` of them belong to train.
    ``digests`` has columns ``_group`` and ``_digest``.
    """
    level = _DIGITS
    counted = digests.groupBy("_group", F.substring("_digest", 1, level).alias("_part")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    total = F.sum("_n").over(Window.partitionBy("_group"))
    counted = counted.withColumn("_want", total - F.floor(total * F.lit(test_size)))
    cuts = _settled(_cut_level(counted, "_part", "_want"))
    before = None
    while True:
        largest = cuts.agg(F.max("_n")).first()[0]
        inside = digests.withColumn("_part", F.substring("_digest", 1, level)).join(
            cuts.drop("_n"), ["_group", "_part"]
        )
        # a part that stays large holds one digest many times, which more digits cannot split
        shrinking = before is None or largest < before / 2
        level = min(32, level + _DIGITS) if largest > small and shrinking else 32
        before = largest
        finer = inside.groupBy(
            "_group", "_need", F.substring("_digest", 1, level).alias("_part")
        ).agg(F.count(F.lit(1)).alias("_n"))
        cuts = _cut_level(finer, "_part", "_need")
        if level == 32:
            return _settled(
                cuts.select(
                    "_group",
                    F.col("_part").alias("_cut"),
                    F.col("_need").alias("_take"),
                    F.col("_n").alias("_same"),
                )
            )
        cuts = _settled(cuts)


def train_test_split(
    df: DataFrame,
    test_size: float = 0.2,
    key_cols: Sequence[str] | None = None,
    seed: int = 42,
    stratify: str | None = None,
    small: int = SMALL_ROWS,
    store: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames; test has exactly ``int(n * test_size)`` rows.

    ``store`` writes the rows with their digests once and reads both frames from there: for
    frames that are read many times, as training does, and for rows that are dear to make.

    ``key_cols`` identify a row (all columns by default).  With ``stratify`` the
    sizes hold within every value of that column.
    """
    if not 0 < test_size < 1:
        raise ValueError(f"test_size is a share above 0 and below 1, not {test_size}")
    keys = require_columns(df, key_cols or df.columns)
    if stratify is not None:
        require_columns(df, [stratify])
    if df.isEmpty():
        raise ValueError("the table has no rows")
    columns = [col(c) for c in df.columns]
    group = F.lit("")
    if stratify is not None:  # NULL is a group of its own
        group = F.coalesce(F.concat(F.lit("="), col(stratify).cast("string")), F.lit("null"))
    marked = df.withColumns({"_group": group, "_digest": key_hash([col(k) for k in keys], seed)})
    marked = materialise(marked) if store else marked
    cuts = find_cuts(marked.select("_group", "_digest"), test_size, small)
    tied = not cuts.where(F.col("_take") < F.col("_same")).isEmpty()
    if stratify is None:
        edge = cuts.first()
        placed = marked.withColumns(
            {f: F.lit(edge[f]) for f in ("_cut", "_take", "_same")}
        )
    else:
        placed = marked.join(cuts, "_group")
    digest, cut = F.col("_digest"), F.col("_cut")
    whole = F.col("_take") == F.col("_same")
    train = placed.where(F.when(whole, digest <= cut).otherwise(digest < cut)).select(*columns)
    test = placed.where(digest > cut).select(*columns)
    if tied:
        ties = placed.where((digest == cut) & ~whole)
        extra_train, extra_test = _split_ties(ties, df.columns)
        train, test = train.unionByName(extra_train), test.unionByName(extra_test)
    return train, test


def _split_ties(ties: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Share out rows whose keys are equal at the cut, in the order of a digest of the row.

    Equal rows are interchangeable, so they are counted, not moved, and written
    back as many times as each side needs.  The rows of a group are ordered in two
    steps, by the leading digits of the digest and inside these, so that many
    ties are ranked in many tasks.
    """
    columns = [col(c) for c in names]
    counted = ties.groupBy("_group", "_take", *columns).agg(F.count(F.lit(1)).alias("_copies"))
    digest = key_hash([F.to_json(F.struct(c)) if nested else c for c, nested in _typed(ties, names)], 0)
    counted = counted.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 3))
    counted = materialise(counted)
    ahead = Window.unboundedPreceding, -1
    parts = counted.groupBy("_group", "_part").agg(F.sum("_copies").alias("_sum"))
    over_parts = Window.partitionBy("_group").orderBy("_part").rowsBetween(*ahead)
    parts = parts.select(
        "_group", "_part", F.coalesce(F.sum("_sum").over(over_parts), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_group", "_part").orderBy("_digest").rowsBetween(*ahead)
    before = F.col("_start") + F.coalesce(F.sum("_copies").over(inside), F.lit(0))
    room = F.greatest(F.col("_take") - before, F.lit(0))
    placed = counted.join(parts, ["_group", "_part"]).withColumn(
        "_share", F.least(room, F.col("_copies"))
    )
    placed = materialise(placed)  # both sides below read one and the same sharing

    def written(amount: Column) -> DataFrame:
        blocks = F.ceil(F.col("_amount") / _COPY_BLOCK).cast("bigint")
        spread = (
            placed.withColumn("_amount", amount)
            .where("_amount > 0")
            .withColumn("_block", F.explode(F.sequence(F.lit(1).cast("bigint"), blocks)))
        )
        size = F.least(
            F.col("_amount") - (F.col("_block") - 1) * _COPY_BLOCK, F.lit(_COPY_BLOCK)
        )
        return (
            spread.repartition("_digest", "_block")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
            .select(*columns)
        )

    return written(F.col("_share")), written(F.col("_copies") - F.col("_share"))


def _typed(df: DataFrame, names: Sequence[str]) -> list[tuple[Column, bool]]:
    """Each column, and whether it is nested (its text is then its JSON)."""
    kinds = dict(df.dtypes)
    return [(col(c), kinds[c].startswith(("array", "map", "struct"))) for c in names]
