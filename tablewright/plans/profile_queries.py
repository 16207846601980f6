"""Registered queries: sources, table profile and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import correlation, order_stats, outliers, profile, quality
from tablewright.plans.registry import query, rounded, table
from tablewright.session import scratch_path
from tablewright.sources import files, tables

# The tables hold no NULL, so every third line loses its quantity.
_ITEMS = """items AS (
  SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty,
         l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
         l_linenumber AS line, l_suppkey AS supp,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS flag,
         l_linestatus AS status, 5.0::DOUBLE AS five, NULL::VARCHAR AS nothing
  FROM lineitem)"""


def items(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supp"),
        F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.lit(5.0).alias("five"),
        F.lit(None).cast("string").alias("nothing"),
    )


_COLUMNS = ("qty", "price", "disc", "tax", "line", "supp", "flag", "status", "five", "nothing")
_NUMERIC = ("qty", "price", "disc", "tax", "line", "supp", "five")


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _nearest(column: str, q: float, source: str = "items") -> str:
    return (
        f"(SELECT max(CASE WHEN rn = floor((n - 1) * {q}::DOUBLE + 0.5) + 1 THEN v END) FROM "
        f"(SELECT {column} AS v, row_number() OVER (ORDER BY {column}) AS rn, "
        f"count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL))"
    )


# ---- sources ---------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, folder):
    path = scratch_path(spark, "customer_csv")
    tables.write_table(table(spark, folder, "customer"), path, "csv")
    back = tables.read_table(spark, path, "csv")
    return back.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


_TEXTS = """SELECT doc_id AS id, 0 AS turn, CASE WHEN doc_id % 10 = 0 THEN NULL
    WHEN doc_id % 10 = 1 THEN '' WHEN doc_id % 10 = 2 THEN '  ' || text || ' '
    ELSE '1,"say ""hi"", ok"' || chr(10) || text END AS text FROM documents
  UNION ALL SELECT conv_id, turn, text FROM conversations"""


@query(_TEXTS)
def csv_text_round_trip(spark, folder):
    """Line breaks, quotes, commas, padding, empty text and NULL through both readers."""
    key, text = F.col("doc_id"), F.col("text")
    docs = table(spark, folder, "documents").select(
        key.alias("id"),
        F.lit(0).alias("turn"),
        F.when(key % 10 == 0, None)
        .when(key % 10 == 1, "")
        .when(key % 10 == 2, F.concat(F.lit("  "), text, F.lit(" ")))
        .otherwise(F.concat(F.lit('1,"say ""hi"", ok"\n'), text))
        .alias("text"),
    )
    paths = []
    talk = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("turn"), "text"
    )
    for frame in (docs, talk):
        paths.append(scratch_path(spark, "text_csv"))
        tables.write_table(frame, paths[-1], "csv")
    given = tables.read_table(spark, paths[0], "csv", docs.schema)
    bounded = tables.read_csv(spark, paths[1])
    return given.unionByName(
        bounded.select(F.col("id").cast("bigint").alias("id"), F.col("turn").cast("int").alias("turn"), "text")
    )


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_bounded_inference(spark, folder):
    path = scratch_path(spark, "part_csv")
    tables.write_table(table(spark, folder, "part"), path, "csv")
    back = tables.read_csv(spark, path, infer_rows=500)
    return back.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("SELECT * FROM supplier")
def table_from_path(spark, folder):
    return tables.as_dataframe(spark, f"{folder}/supplier.parquet")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5")
def preview(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.preview(customers, 5, order_by=["c_acctbal", "c_custkey"])


# ---- profile ---------------------------------------------------------------


@query(
    f"""WITH {_ITEMS} SELECT count(*) AS n_rows, 10::BIGINT AS n_columns,
    round((count(qty) * 8 + count(price) * 8 + count(disc) * 8 + count(tax) * 8
      + count(line) * 4 + count(supp) * 8 + sum(strlen(flag)) + sum(strlen(status))
      + count(five) * 8) / (1024.0 * 1024.0), 6)::DOUBLE AS memory_mb FROM items"""
)
def table_info(spark, folder):
    return rounded(profile.table_info(items(spark, folder)))


@query()
def table_metadata(spark, folder):
    return profile.table_metadata(items(spark, folder))


@query(
    f"WITH {_ITEMS} "
    + _union(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS total FROM items"
        for c in _COLUMNS
    )
)
def missing_counts(spark, folder):
    return profile.missing_counts(items(spark, folder))


def _digits(column: str) -> int:
    """Decimals that leave room for rounding: fewer for the columns of large values."""
    return 3 if column in ("price", "supp") else 7


def _distribution_sql(columns) -> str:
    dtypes = {"line": "int", "supp": "bigint"}
    return f"WITH {_ITEMS} " + _union(
        f"SELECT '{c}' AS \"column\", '{dtypes.get(c, 'double')}' AS dtype, count({c}) AS count, "
        f"count(*) - count({c}) AS null_count, round(avg({c}), {_digits(c)}) AS mean, "
        f"round(stddev_samp({c}::DOUBLE), {_digits(c)}) AS std, round(min({c})::DOUBLE, 6) AS min, "
        f"round(max({c})::DOUBLE, 6) AS max, round(median({c})::DOUBLE, 6) AS median, "
        f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique "
        "FROM items"
        for c in columns
    )


@query(_distribution_sql(_NUMERIC))
def numeric_distributions(spark, folder):
    stats = profile.numeric_distributions(items(spark, folder))
    large = F.col("column").isin("price", "supp")
    digits = {c: F.when(large, F.round(c, 3)).otherwise(F.round(c, 7)) for c in ("mean", "std")}
    return stats.withColumns({**digits, "median": F.round("median", 6)})


@query(
    f"WITH {_ITEMS} "
    + _union(
        f"SELECT '{c}' AS \"column\", 'string' AS dtype, count({c}) AS count, "
        f"count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique FROM items"
        for c in ("flag", "status", "nothing")
    )
)
def categorical_distributions(spark, folder):
    return profile.categorical_distributions(items(spark, folder))


def _top(column: str, source: str, k: int = 10) -> str:
    return (
        f"(SELECT '{column}' AS \"column\", {column} AS value, count(*) AS count FROM {source} "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} ASC NULLS FIRST LIMIT {k})"
    )


@query(f"WITH {_ITEMS} " + _union(_top(c, "items") for c in ("flag", "status", "nothing")))
def top_values(spark, folder):
    return profile.top_values(items(spark, folder))


@query(_union(_top(c, "customer") for c in ("c_name", "c_mktsegment")))
def top_values_many_distinct(spark, folder):
    return profile.top_values(table(spark, folder, "customer"), ["c_name", "c_mktsegment"])


def _pair(a: str, b: str) -> str:
    value = (
        "1.0::DOUBLE"
        if a == b
        else f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 6) END"
    )
    return f"SELECT '{a}' AS col1, '{b}' AS col2, {value} AS corr FROM items"


def _pairs(columns) -> str:
    # a column against itself needs no data, hence one row
    return f"WITH {_ITEMS} " + _union(
        _pair(a, b) if a != b else f"SELECT '{a}' AS col1, '{a}' AS col2, 1.0::DOUBLE AS corr"
        for a in columns
        for b in columns
    )


@query(_pairs(("qty", "price", "disc", "five")))
def correlations(spark, folder):
    narrow = items(spark, folder).select("qty", "price", "disc", "five")
    return rounded(correlation.correlations(narrow))


@query(_pairs(_NUMERIC))
def correlations_many_columns(spark, folder):
    return rounded(correlation.correlations(items(spark, folder)))


# one pair whose second column is known only in one of two distant clusters
_CLUSTERED = """items AS (
  SELECT CASE WHEN l_linenumber = 1 THEN -1e9::DOUBLE ELSE 1e9::DOUBLE END + l_quantity AS far,
         CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice END AS price,
         l_discount AS a, l_tax AS b, l_partkey AS c, l_suppkey AS d, l_linenumber AS e
  FROM lineitem)"""


def _clustered_sql() -> str:
    near = "far - 1e9::DOUBLE"
    value = f"round(corr({near}, price) FILTER (WHERE price IS NOT NULL), 6)"
    return f"WITH {_CLUSTERED} " + _union(
        f"SELECT {n} AS columns, {value} AS corr FROM items" for n in (4, 7)
    )


@query(_clustered_sql())
def correlations_clustered(spark, folder):
    """The same pair among four and among seven columns."""
    line = F.col("l_linenumber")
    values = table(spark, folder, "lineitem").select(
        (F.when(line == 1, -1e9).otherwise(1e9) + F.col("l_quantity")).alias("far"),
        F.when(line != 1, F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("a"),
        F.col("l_tax").alias("b"),
        F.col("l_partkey").alias("c"),
        F.col("l_suppkey").alias("d"),
        line.alias("e"),
    )
    parts = []
    for n in (4, 7):
        found = correlation.correlations(values, values.columns[:n])
        pair = found.where("col1 = 'far' and col2 = 'price'")
        parts.append(pair.select(F.lit(n).alias("columns"), "corr"))
    return rounded(parts[0].unionByName(parts[1]))


_SKEWED = """skewed AS (
  SELECT l_extendedprice * l_quantity AS volume, l_tax * l_discount AS levy,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty FROM lineitem)"""


def skewed(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("volume"),
        (F.col("l_tax") * F.col("l_discount")).alias("levy"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("qty"),
    )


def _bounds(columns, source: str, multiplier: float) -> str:
    return ", ".join(
        f"{_nearest(c, 0.25, source)} AS {c}_q1, {_nearest(c, 0.75, source)} AS {c}_q3"
        for c in columns
    )


def _low(c: str, m: float) -> str:
    return f"({c}_q1 - {m}::DOUBLE * ({c}_q3 - {c}_q1))"


def _high(c: str, m: float) -> str:
    return f"({c}_q3 + {m}::DOUBLE * ({c}_q3 - {c}_q1))"


def _outlier_sql(multiplier: float) -> str:
    columns = ("volume", "levy", "qty")
    parts = [
        f"SELECT '{c}' AS \"column\", round(min({_low(c, multiplier)}), 6) AS lower_bound, "
        f"round(min({_high(c, multiplier)}), 6) AS upper_bound, "
        f"count(CASE WHEN {c} < {_low(c, multiplier)} OR {c} > {_high(c, multiplier)} THEN 1 END) "
        f"AS count, round(count(CASE WHEN {c} < {_low(c, multiplier)} OR "
        f"{c} > {_high(c, multiplier)} THEN 1 END) / count(*) * 100, 6) AS percentage "
        "FROM skewed, bounds"
        for c in columns
    ]
    return (
        f"WITH {_SKEWED}, bounds AS (SELECT {_bounds(columns, 'skewed', multiplier)}) "
        + _union(parts)
    )


@query(_outlier_sql(1.5))
def detect_outliers(spark, folder):
    return rounded(outliers.detect_outliers(skewed(spark, folder)))


@query(f"SELECT sum(count)::BIGINT AS total_outliers FROM ({_outlier_sql(0.5)})")
def outlier_total(spark, folder):
    return outliers.outlier_total(outliers.detect_outliers(skewed(spark, folder), None, 0.5))


@query(
    f"WITH {_ITEMS}, counts AS ("
    + _union(
        f"SELECT '{c}' AS \"column\", {str(c in _NUMERIC).upper()} AS numeric, "
        f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS u FROM items"
        for c in _COLUMNS
    )
    + """) SELECT "column", CASE WHEN NOT numeric THEN 'categorical' WHEN u = 2 THEN 'binary'
    WHEN u <= 20 THEN 'categorical' ELSE 'numerical' END AS feature_type FROM counts"""
)
def feature_types(spark, folder):
    return profile.feature_types(items(spark, folder))


@query(
    """WITH v AS (SELECT CASE WHEN value < 50 THEN 'NaN'::DOUBLE ELSE 1.0::DOUBLE END AS two,
      CASE WHEN value < 50 THEN 'NaN'::DOUBLE ELSE value END AS many FROM events)
    SELECT "column", CASE WHEN u = 2 THEN 'binary' WHEN u <= 20 THEN 'categorical'
    ELSE 'numerical' END AS feature_type FROM (
    SELECT 'two' AS "column", count(DISTINCT two) AS u FROM v UNION ALL
    SELECT 'many', count(DISTINCT many) FROM v)"""
)
def feature_types_nan(spark, folder):
    value, nan = F.col("value"), F.lit(float("nan"))
    return profile.feature_types(
        table(spark, folder, "events").select(
            F.when(value < 50, nan).otherwise(1.0).alias("two"),
            F.when(value < 50, nan).otherwise(value).alias("many"),
        )
    )


@query(
    """SELECT "column", CASE WHEN u = 2 THEN 'binary' WHEN u <= 20 THEN 'categorical'
    ELSE 'numerical' END AS feature_type FROM (
    SELECT 'doc_id' AS "column", count(DISTINCT doc_id) AS u FROM labels UNION ALL
    SELECT 'quality', count(DISTINCT quality) FROM labels UNION ALL
    SELECT 'toxic', count(DISTINCT toxic) FROM labels)"""
)
def feature_types_binary(spark, folder):
    return profile.feature_types(table(spark, folder, "labels"))


@query(
    f"WITH {_ITEMS} SELECT * FROM ("
    + _union(
        f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS q, round({_nearest(c, q)}::DOUBLE, 6) AS value"
        for c in ("qty", "price", "line")
        for q in (0.1, 0.25, 0.5, 0.75, 0.99)
    )
    + ")"
)
def quantiles_nearest(spark, folder):
    return rounded(
        order_stats.quantiles(
            items(spark, folder), ["qty", "price", "line"], [0.1, 0.25, 0.5, 0.75, 0.99]
        )
    )


@query(
    f"WITH {_ITEMS} "
    + _union(
        f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS q, "
        f"round(quantile_cont({c}::DOUBLE, {q}), 6) AS value FROM items"
        for c in ("qty", "price", "line")
        for q in (0.1, 0.25, 0.5, 0.75, 0.99)
    )
)
def quantiles_linear(spark, folder):
    return rounded(
        order_stats.quantiles(
            items(spark, folder), ["qty", "price", "line"], [0.1, 0.25, 0.5, 0.75, 0.99], "linear"
        )
    )


@query()
def quantiles_approx(spark, folder):
    return order_stats.quantiles(items(spark, folder), ["qty", "price"], [0.25, 0.75], "approx")


# ---- quality ---------------------------------------------------------------


@query(f"WITH {_ITEMS} SELECT count(*) AS total_rows, 10::BIGINT AS total_columns FROM items")
def quality_totals(spark, folder):
    return quality.quality_totals(items(spark, folder))


@query(
    f"WITH {_ITEMS}, counts AS ("
    + _union(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS count, count(*) AS n FROM items"
        for c in _COLUMNS
    )
    + ') SELECT "column", count, round(count / n * 100, 6) AS percentage FROM counts WHERE count > 0'
)
def missing_report(spark, folder):
    return rounded(quality.missing_report(items(spark, folder)))


@query(
    f"WITH {_ITEMS}, counts AS ("
    + _union(
        f"SELECT '{c}' AS \"column\", "
        f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS u FROM items"
        for c in _COLUMNS
    )
    + ') SELECT "column" FROM counts WHERE u = 1'
)
def constant_columns(spark, folder):
    return quality.constant_columns(items(spark, folder))


_PAIRS = "pairs AS (SELECT l_suppkey, l_quantity, l_returnflag FROM lineitem)"


def _pairs_frame(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")


@query(
    f"WITH {_PAIRS} SELECT (SELECT count(*) FROM pairs) "
    "- (SELECT count(*) FROM (SELECT DISTINCT * FROM pairs)) AS duplicate_rows"
)
def duplicate_rows(spark, folder):
    return quality.duplicate_rows(_pairs_frame(spark, folder))


@query(
    "SELECT (SELECT count(*) FROM lineitem) "
    "- (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows"
)
def duplicate_rows_wide(spark, folder):
    return quality.duplicate_rows(table(spark, folder, "lineitem"))


@query(
    f"""WITH {_ITEMS}, q AS (SELECT
      (SELECT count(*) FROM items) AS total_rows, 10::BIGINT AS total_columns,
      3::BIGINT AS missing_columns, 2::BIGINT AS constant_columns,
      (SELECT count(*) FROM items) - (SELECT count(*) FROM (SELECT DISTINCT * FROM items))
        AS duplicate_rows)
    SELECT *, missing_columns + constant_columns
      + CASE WHEN duplicate_rows > 0 THEN 1 ELSE 0 END AS issues FROM q"""
)
def quality_report(spark, folder):
    return quality.quality_report(items(spark, folder))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark, folder):
    return profile.distinct_values(table(spark, folder, "customer"), "c_mktsegment")


@query(
    f"WITH {_ITEMS} SELECT count(*) AS rows_before, count(qty) AS rows_after, "
    "count(*) - count(qty) AS rows_removed FROM items"
)
def step_report(spark, folder):
    before = items(spark, folder)
    return quality.step_report(before, before.na.drop("any", subset=["qty"]))
