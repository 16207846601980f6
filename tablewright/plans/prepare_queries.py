"""Registered queries: cleaning, encoding, scaling, splitting, feature construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import encode, features, impute, outliers, quality, scale, split
from tablewright.plans.profile_queries import (
    _SKEWED,
    _bounds,
    _high,
    _low,
    skewed,
)
from tablewright.operators.ranking import running_before
from tablewright.plans.registry import query, rounded, table
from tablewright.session import scratch_path
from tablewright.sources import tables

# ---- encoding --------------------------------------------------------------

_SEGMENTS = """segments AS (SELECT c_custkey, c_acctbal,
  CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END AS segment FROM customer)"""


def segments(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        "c_acctbal",
        F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment")).alias("segment"),
    )


def _hot(value: str) -> str:
    return (
        f"CASE WHEN segment = '{value}' THEN 1 ELSE 0 END AS \"segment_{value}\""
        if value != "null"
        else 'CASE WHEN segment IS NULL THEN 1 ELSE 0 END AS "segment_null"'
    )


# The market segments of the customer table.
_VALUES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "null")


@query(
    f"WITH {_SEGMENTS} SELECT c_custkey, c_acctbal, "
    + ", ".join(_hot(v) for v in _VALUES)
    + " FROM segments"
)
def one_hot(spark, folder):
    return encode.one_hot(segments(spark, folder), ["segment"])


@query(
    f"""WITH {_SEGMENTS} SELECT c_custkey,
    (dense_rank() OVER (ORDER BY segment ASC NULLS FIRST) - 1)::BIGINT AS hot,
    6::BIGINT AS width FROM segments"""
)
def one_hot_vector(spark, folder):
    from pyspark.ml.functions import vector_to_array

    encoded = encode.one_hot_vector(segments(spark, folder), "segment")
    dense = vector_to_array("segment")
    return encoded.select(
        "c_custkey",
        (F.array_position(dense, 1.0) - 1).cast("bigint").alias("hot"),
        F.size(dense).cast("bigint").alias("width"),
    )


@query(
    f"""WITH {_SEGMENTS} SELECT c_custkey, c_acctbal,
    (dense_rank() OVER (ORDER BY segment ASC NULLS FIRST) - 1)::BIGINT AS segment FROM segments"""
)
def label_encode(spark, folder):
    df = segments(spark, folder)
    return encode.LabelEncoding.fit(df, ["segment"]).transform(df)


@query(
    """SELECT 'o_custkey' AS "column", o_custkey::VARCHAR AS value,
      (row_number() OVER (ORDER BY o_custkey) - 1)::BIGINT AS code
    FROM (SELECT DISTINCT o_custkey FROM orders)
    UNION ALL SELECT 'o_orderpriority', o_orderpriority,
      (row_number() OVER (ORDER BY o_orderpriority) - 1)::BIGINT
    FROM (SELECT DISTINCT o_orderpriority FROM orders)"""
)
def label_mapping(spark, folder):
    orders = table(spark, folder, "orders")
    # a small bound sends the keys through the bucketed ranking
    fitted = encode.LabelEncoding.fit(orders, ["o_custkey", "o_orderpriority"], small=500)
    return fitted.mapping


@query(
    """SELECT 'long' AS "column", v AS value, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS code
    FROM (SELECT DISTINCT repeat('path/', 60) || o_custkey AS v FROM orders)"""
)
def label_mapping_long_text(spark, folder):
    # keys alike in their first 300 characters, ranked in many ranges
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("path/" * 60), F.col("o_custkey").cast("string")).alias("long")
    )
    return encode.LabelEncoding.fit(orders, ["long"], small=100).mapping


@query(f"WITH {_SEGMENTS} SELECT c_custkey, c_acctbal, segment FROM segments")
def label_decode(spark, folder):
    df = segments(spark, folder)
    fitted = encode.LabelEncoding.fit(df, ["segment"])
    path = scratch_path(spark, "mapping")
    fitted.save(path)
    loaded = encode.LabelEncoding.load(spark, path)
    return loaded.inverse(fitted.transform(df), "segment")


@query(
    """WITH known AS (SELECT DISTINCT l_returnflag AS v FROM lineitem WHERE l_returnflag <> 'R'),
    codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM known)
    SELECT coalesce(code, -1)::BIGINT AS flag, count(*) AS n
    FROM lineitem LEFT JOIN codes ON l_returnflag = v GROUP BY 1"""
)
def label_encode_unseen(spark, folder):
    items = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"))
    fitted = encode.LabelEncoding.fit(items.where("flag <> 'R'"), ["flag"])
    coded = fitted.transform(items, unseen="minus_one")
    return coded.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


# ---- missing values --------------------------------------------------------

_GAPS = """gaps AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  NULL::DOUBLE AS nothing FROM orders)"""


def gaps(spark, folder) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 7 != 0, F.col("o_custkey")).alias("cust"),
        F.when(key % 3 != 0, F.col("o_orderpriority")).alias("priority"),
        F.lit(None).cast("double").alias("nothing"),
    )


@query(
    f"""WITH {_GAPS} SELECT o_orderkey, price, cust, priority FROM gaps
    WHERE price IS NOT NULL AND cust IS NOT NULL AND priority IS NOT NULL"""
)
def impute_drop(spark, folder):
    return impute.impute(gaps(spark, folder).drop("nothing"), "drop")


def _filled(statistic: str) -> str:
    return f"""WITH {_GAPS} SELECT o_orderkey::DOUBLE AS o_orderkey,
      round(coalesce(price, (SELECT {statistic}(price) FROM gaps)), 6) AS price,
      round(coalesce(cust::DOUBLE, (SELECT {statistic}(cust)::DOUBLE FROM gaps)), 6) AS cust,
      priority, nothing FROM gaps"""


@query(_filled("avg"))
def impute_mean(spark, folder):
    return rounded(impute.impute(gaps(spark, folder), "mean"))


@query(_filled("median"))
def impute_median(spark, folder):
    return rounded(impute.impute(gaps(spark, folder), "median"))


def _mode(column: str) -> str:
    return (
        f"(SELECT {column} FROM gaps WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@query(
    f"""WITH {_GAPS} SELECT o_orderkey, coalesce(price, {_mode("price")}) AS price,
    coalesce(cust, {_mode("cust")}) AS cust, coalesce(priority, {_mode("priority")}) AS priority,
    nothing FROM gaps"""
)
def impute_mode(spark, folder):
    return impute.impute(gaps(spark, folder), "mode")


@query(
    f"""WITH {_GAPS} SELECT o_orderkey, coalesce(price, 0) AS price, coalesce(cust, 0) AS cust,
    priority, coalesce(nothing, 0) AS nothing FROM gaps"""
)
def impute_zero(spark, folder):
    return impute.impute(gaps(spark, folder), "zero")


# ---- outliers and scaling --------------------------------------------------


@query(
    f"""WITH {_SKEWED}, b1 AS (SELECT {_bounds(["volume"], "skewed", 0.5)}),
    s1 AS (SELECT volume, levy, qty FROM skewed, b1
      WHERE volume BETWEEN {_low("volume", 0.5)} AND {_high("volume", 0.5)}),
    b2 AS (SELECT {_bounds(["levy"], "s1", 0.5)}),
    s2 AS (SELECT volume, levy, qty FROM s1, b2
      WHERE levy BETWEEN {_low("levy", 0.5)} AND {_high("levy", 0.5)})
    SELECT round(volume, 6) AS volume, round(levy, 6) AS levy, qty FROM s2"""
)
def remove_outliers(spark, folder):
    return rounded(outliers.remove_outliers(skewed(spark, folder), ["volume", "levy"], 0.5))


@query(
    f"""WITH {_SKEWED}, b AS (SELECT {_bounds(["volume", "qty"], "skewed", 0.5)})
    SELECT round(volume, 6) AS volume, round(levy, 6) AS levy, qty FROM skewed, b
    WHERE volume BETWEEN {_low("volume", 0.5)} AND {_high("volume", 0.5)}
      AND qty BETWEEN {_low("qty", 0.5)} AND {_high("qty", 0.5)}"""
)
def remove_outliers_joint(spark, folder):
    return rounded(
        outliers.remove_outliers(skewed(spark, folder), ["volume", "qty"], 0.5, mode="joint")
    )


@query(
    f"""WITH {_SKEWED}, s0 AS (SELECT * FROM skewed WHERE volume IS NOT NULL AND levy IS NOT NULL
      AND qty IS NOT NULL),
    b1 AS (SELECT {_bounds(["volume"], "s0", 0.5)}),
    s1 AS (SELECT volume, levy, qty FROM s0, b1
      WHERE volume BETWEEN {_low("volume", 0.5)} AND {_high("volume", 0.5)}),
    b2 AS (SELECT {_bounds(["levy"], "s1", 0.5)}),
    s2 AS (SELECT volume, levy, qty FROM s1, b2
      WHERE levy BETWEEN {_low("levy", 0.5)} AND {_high("levy", 0.5)}),
    b3 AS (SELECT {_bounds(["qty"], "s2", 0.5)}),
    s3 AS (SELECT volume, levy, qty FROM s2, b3
      WHERE qty BETWEEN {_low("qty", 0.5)} AND {_high("qty", 0.5)}),
    n AS (SELECT (SELECT count(*) FROM skewed) AS n0, (SELECT count(*) FROM s0) AS n1,
      (SELECT count(*) FROM s3) AS n2)
    SELECT 1 AS position, 'drop nulls' AS step, n0 AS rows_before, n1 AS rows_after,
      n0 - n1 AS rows_removed FROM n
    UNION ALL SELECT 2, 'remove outliers', n1, n2, n1 - n2 FROM n"""
)
def clean_steps(spark, folder):
    _, report = quality.clean(
        skewed(spark, folder),
        [
            ("drop nulls", lambda df: impute.fit_fill(df, "drop").transform),
            (
                "remove outliers",
                lambda df: outliers.fit_outliers(df, ["volume", "levy", "qty"], 0.5).transform,
            ),
        ],
    )
    return report


def _scaled_frame(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("cust"),
        F.lit(5.0).alias("five"),
    )


def _scaled(shift: str, width: str) -> str:
    return f"""SELECT o_orderkey,
      round((o_totalprice - {shift.format(c="o_totalprice")}) / {width.format(c="o_totalprice")}, 6)
        AS price,
      round((o_custkey - {shift.format(c="o_custkey")}) / {width.format(c="o_custkey")}, 6) AS cust,
      5.0::DOUBLE AS five FROM orders"""


@query(_scaled("(SELECT avg({c}) FROM orders)", "(SELECT stddev_samp({c}) FROM orders)"))
def scale_standard(spark, folder):
    return rounded(scale.scale(_scaled_frame(spark, folder), ["price", "cust", "five"]))


@query(_scaled("(SELECT min({c}) FROM orders)", "(SELECT max({c}) - min({c}) FROM orders)"))
def scale_minmax(spark, folder):
    return rounded(scale.scale(_scaled_frame(spark, folder), ["price", "cust", "five"], "minmax"))


@query(
    _scaled(
        "(SELECT median({c}) FROM orders)",
        "(SELECT quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) FROM orders)",
    )
)
def scale_robust(spark, folder):
    return rounded(scale.scale(_scaled_frame(spark, folder), ["price", "cust", "five"], "robust"))


# ---- splits ----------------------------------------------------------------

_RANKED = """ranked AS (SELECT o_orderkey, o_totalprice, o_orderpriority,
  row_number() OVER (ORDER BY md5('42:' || length(o_orderkey::VARCHAR) || '=' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)"""
_CUT = "n - floor(n * 0.2::DOUBLE)"


def _orders(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


def _tagged(parts) -> DataFrame:
    train, test = parts
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


@query(
    f"""WITH {_RANKED} SELECT o_orderkey, o_totalprice, o_orderpriority,
    CASE WHEN rn <= {_CUT} THEN 'train' ELSE 'test' END AS part FROM ranked"""
)
def train_test_split(spark, folder):
    return _tagged(split.train_test_split(_orders(spark, folder), 0.2, ["o_orderkey"]))


@query(
    """SELECT o_orderkey, o_totalprice, o_orderpriority,
    CASE WHEN rn <= n - floor(n * 0.3::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || length(o_orderkey::VARCHAR) || '=' || o_orderkey))
        AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""
)
def train_test_split_stratified(spark, folder):
    parts = split.train_test_split(
        _orders(spark, folder), 0.3, ["o_orderkey"], stratify="o_orderpriority"
    )
    return _tagged(parts)


@query(
    """SELECT part, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER () <=
      (SELECT count(*) - floor(count(*) * 0.25::DOUBLE) FROM lineitem)
      THEN 'train' ELSE 'test' END AS part FROM lineitem) GROUP BY part"""
)
def train_test_split_copies(spark, folder):
    # few columns: nearly every row has copies, and the sizes must still be exact
    items = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    return (
        _tagged(split.train_test_split(items, 0.25))
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    """SELECT o_custkey, count(*) - floor(count(*) * 0.3::DOUBLE)::BIGINT AS train,
      floor(count(*) * 0.3::DOUBLE)::BIGINT AS test FROM orders GROUP BY 1"""
)
def train_test_split_many_classes(spark, folder):
    # very many classes, and whole rows as keys with copies among them
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    parts = _tagged(split.train_test_split(orders, 0.3, stratify="o_custkey"))
    return parts.groupBy("o_custkey").agg(
        F.count(F.when(F.col("part") == "train", 1)).alias("train"),
        F.count(F.when(F.col("part") == "test", 1)).alias("test"),
    )


@query(
    "SELECT o_orderkey, o_totalprice, o_orderpriority, (rn - 1)::BIGINT AS position "
    f"FROM (WITH {_RANKED} SELECT * FROM ranked)"
)
def shuffle(spark, folder):
    mixed = split.shuffle(_orders(spark, folder), ["o_orderkey"])
    path = scratch_path(spark, "shuffled")
    mixed.select("*", F.monotonically_increasing_id().alias("at")).write.parquet(path)
    back = spark.read.parquet(path)  # the order of the written rows, as positions
    return running_before(back, "at", {"position": F.lit(1).cast("bigint")}, back.count()).drop("at")


@query(f"WITH {_RANKED} SELECT o_orderkey, o_totalprice FROM ranked WHERE rn > {_CUT}")
def written_test_part(spark, folder):
    train, test = split.train_test_split(_orders(spark, folder), 0.2, ["o_orderkey"])
    paths = tables.write_split(train, test, "o_orderpriority", scratch_path(spark, "split"))
    return tables.read_table(spark, paths["test"], "parquet")


# ---- feature construction --------------------------------------------------


@query(
    """WITH o AS (SELECT avg(o_totalprice) AS m FROM orders),
    means AS (SELECT o_orderpriority AS v,
      (sum(o_totalprice) + 10.0::DOUBLE * (SELECT m FROM o)) / (count(*) + 10.0::DOUBLE) AS e
      FROM orders GROUP BY 1)
    SELECT o_orderkey, round(e, 4) AS encoded FROM orders JOIN means ON o_orderpriority = v"""
)
def target_encoding(spark, folder):
    orders = _orders(spark, folder)
    fitted = features.TargetEncoding.fit(orders, "o_orderpriority", "o_totalprice", 10.0)
    encoded = fitted.transform(orders, "encoded")
    return rounded(encoded.select("o_orderkey", "encoded"), 4)


@query(
    """SELECT l_orderkey, round(l_quantity * l_quantity, 6) AS "l_quantity*l_quantity",
    round(l_quantity * l_tax, 6) AS "l_quantity*l_tax", round(l_tax * l_tax, 6) AS "l_tax*l_tax"
    FROM lineitem"""
)
def polynomial(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    return rounded(features.polynomial(items, ["l_quantity", "l_tax"]).drop("l_quantity", "l_tax"))


@query(
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year,
    quarter(o_orderdate)::INTEGER AS o_orderdate_quarter,
    month(o_orderdate)::INTEGER AS o_orderdate_month, day(o_orderdate)::INTEGER AS o_orderdate_day,
    (dayofweek(o_orderdate) + 1)::INTEGER AS o_orderdate_dayofweek,
    hour(o_orderdate)::INTEGER AS o_orderdate_hour FROM orders"""
)
def temporal(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return features.temporal(orders, "o_orderdate").drop("o_orderdate")
