"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after every run of ASCII white space became one
space.  Each level looks only at rows that still share a group with another row:

1. lengths that occur once settle their rows;
2. among the rest, pairs of length and prefix hash that occur once do the same;
3. only the remaining rows have their whole content hashed (SHA-256).

The rows of a group never meet in one task: counts and smallest ids are combined
before the shuffle, and members find their group by a join that adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.llm.common import id_and_text, is_small, joinable, semi_join_early, stored, text_or_empty, without

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, " ")


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    digests: bool = False,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept`` and, if asked, ``digest``.

    ``keep_id`` is the smallest id among equal texts and ``kept`` marks its row.
    ``digest`` (lower-case hex SHA-256 of the normalised text) costs a hash of
    every row; without it only rows of the last level are hashed.

    Null text counts as empty.  A null id ranks after all others: it is kept only
    in a group of null ids.  Rows repeated with id and text count one by one in
    ``group_size`` and share their ``kept``.  An empty table gives no rows.
    """
    rows = id_and_text(df, id_col, text_col).select("id", normalised(F.col("text")).alias("body"))
    rows = rows.withColumn("length", F.length("body"))
    prefix = F.xxhash64(F.substring("body", 1, prefix_chars))
    full = F.sha2(F.col("body").cast("binary"), 256)

    lengths = stored(
        rows.groupBy("length").count().where("count > 1").select("length"), "dedup-lengths"
    )
    prefixes = stored(
        semi_join_early(
            rows, lengths, ["length"], lambda r: r.select("length", prefix.alias("prefix"))
        )
        .groupBy("length", "prefix")
        .count()
        .where("count > 1")
        .select("length", "prefix", F.lit(True).alias("shared")),
        "dedup-prefixes",
    )
    keyed = rows.withColumn("prefix", prefix)
    reported = [full.alias("digest")] if digests else []
    if is_small(prefixes):
        marked = keyed.join(F.broadcast(prefixes), ["length", "prefix"], "left").select(
            "id", F.when(F.col("shared"), full).alias("content"), *reported
        )
    else:
        marked = (
            keyed.select("id", "length", "prefix", full.alias("all_content"), *reported)
            .join(prefixes.hint("merge"), ["length", "prefix"], "left")
            .withColumn("content", F.when(F.col("shared"), F.col("all_content")))
            .drop("length", "prefix", "shared", "all_content")
        )
    marked = stored(marked, "dedup-rows")

    groups = stored(  # so that both sides of the join below are plain exchanges, which can be split
        marked.where("content is not null")
        .groupBy("content")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")),
        "dedup-groups",
    )
    alone = marked.where("content is null").withColumns(
        {"keep_id": F.col("id"), "group_size": F.lit(1).cast("bigint")}
    )
    together = marked.where("content is not null").join(joinable(groups), "content")
    both = alone.drop("content").unionByName(together.drop("content"))
    return both.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with all its columns, less the rows that ``exact_duplicates`` does not keep."""
    found = exact_duplicates(df, id_col, text_col, digests=True).where("not kept")
    dropped = stored(found.select("id", "digest").distinct(), "dedup-dropped")
    digest = F.sha2(normalised(text_or_empty(text_col)).cast("binary"), 256)
    return without(df, dropped, {"id": col(id_col).cast("bigint"), "digest": digest})
