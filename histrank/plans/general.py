"""Queries p1_ and p7_: general operators for large data, on their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histrank.operators import compression as C
from histrank.operators.packed import IDS, TITLES, split_packed
from histrank.session import table


def _bucket_values(spark: SparkSession, d: str, value: Column | None = None) -> DataFrame:
    rows = table(spark, d, "candidates").where("cf_bucket_size >= 1")
    if value is None:
        rows, value = rows.where("candidate_id IS NOT NULL"), F.col("candidate_id")
    return C.compress(rows, F.col("cf_bucket_size"), value)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys that hold at least 2 % of the counted records."""
    events = C.compress(table(spark, d, "interactions"), F.col("item_id"), F.struct("user_id", "unixreviewtime"))
    found = [("cf_bucket_size", C.heavy_keys(_bucket_values(spark, d), 0.02, disjoint=False)), ("popularity", C.heavy_keys(events, 0.02, disjoint=True))]
    parts = [x.select(F.lit(name).alias("field_name"), F.col("key").cast("bigint").alias("key_value")) for name, x in found]
    return parts[0].unionByName(parts[1])


def p1_bucket_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per cf_bucket_size: rows, distinct items, the most frequent item, median and 95th percentile of candidate_rank."""
    items = _bucket_values(spark, d, F.col("item_id"))
    ranks = C.key_percentiles(_bucket_values(spark, d, F.col("candidate_rank")), [0.5, 0.95])
    wide = ranks.groupBy("key").agg(F.max(F.expr("IF(p = 0.5D, value, NULL)")).alias("median_rank"), F.max(F.expr("IF(p = 0.95D, value, NULL)")).alias("p95_rank"))
    return (
        C.key_counts(items)
        .join(C.key_modes(items), "key", "left")
        .join(wide, "key", "left")
        .select(F.col("key").alias("cf_bucket_size"), "n_rows", F.col("n_values").alias("n_items"), F.col("mode").alias("mode_item"), "mode_rows", "median_rank", "p95_rank")
    )


def p1_item_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per item: interactions, distinct users, most frequent rating, median rating."""
    rows = table(spark, d, "interactions")
    users = C.compress(rows, F.col("item_id"), F.col("user_id"))
    ratings = C.compress(rows, F.col("item_id"), F.col("overall"))
    median = C.key_percentiles(ratings, [0.5]).select("key", F.col("value").alias("median_rating"))
    return (
        C.key_counts(users)
        .join(C.key_modes(ratings), "key", "left")
        .join(median, "key", "left")
        .select(F.col("key").alias("item_id"), "n_rows", F.col("n_values").alias("n_users"), F.col("mode").alias("mode_rating"), "median_rating")
    )


def _packed(spark: SparkSession, d: str) -> DataFrame:
    ids = split_packed(table(spark, d, "samples"), "sample_id", "history_item_id", IDS)
    titles = split_packed(table(spark, d, "title_histories"), "row_id", "history_item_title", TITLES)
    return ids.withColumn("field_name", F.lit("history_item_id")).unionByName(titles.withColumn("field_name", F.lit("history_item_title")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the packed histories with its position."""
    return _packed(spark, d).select("field_name", "row_key", "value_pos", "item_value").distinct()


def p7_quality(spark: SparkSession, d: str) -> DataFrame:
    """Per field: values, values read with an error flag, longest list."""
    return _packed(spark, d).groupBy("field_name").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if("error").alias("n_errors"), (F.max("value_pos") + 1).alias("longest")
    )


QUERIES = {"p1_found": p1_found, "p1_bucket_profile": p1_bucket_profile, "p1_item_profile": p1_item_profile, "p7_found": p7_found, "p7_quality": p7_quality}

_PERCENTILE = """(SELECT k, min(CASE WHEN c >= greatest(1, ceil({p} * t)) THEN v END) AS x FROM (
  SELECT k, v, sum(count(*)) OVER (PARTITION BY k ORDER BY v) AS c, sum(count(*)) OVER (PARTITION BY k) AS t
  FROM (SELECT {key} AS k, {value} AS v FROM {table}) WHERE k IS NOT NULL {cond} AND v IS NOT NULL GROUP BY k, v) GROUP BY k)"""
_MODE = """(SELECT k, v AS x, n FROM (SELECT k, v, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) AS r
  FROM (SELECT {key} AS k, {value} AS v FROM {table}) WHERE k IS NOT NULL {cond} AND v IS NOT NULL GROUP BY k, v) WHERE r = 1)"""
_CAND = {"key": "cf_bucket_size", "table": "candidates", "cond": "AND k >= 1"}
_INTER = {"key": "item_id", "table": "interactions", "cond": ""}

ORACLE = {
    "p1_found": """
WITH c AS (SELECT cf_bucket_size AS k, count(DISTINCT candidate_id) AS n FROM candidates WHERE cf_bucket_size >= 1 GROUP BY 1),
ct AS (SELECT count(DISTINCT candidate_id) AS t FROM candidates WHERE cf_bucket_size >= 1),
i AS (SELECT item_id AS k, count(*) AS n FROM (SELECT DISTINCT user_id, item_id, unixreviewtime FROM interactions WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT 'cf_bucket_size' AS field_name, k AS key_value FROM c, ct WHERE n >= 0.02 * t
UNION ALL SELECT 'popularity', k FROM i WHERE n >= 0.02 * (SELECT sum(n) FROM i)""",
    "p1_bucket_profile": f"""
SELECT k AS cf_bucket_size, n_rows, n_items, m.x AS mode_item, m.n AS mode_rows, a.x AS median_rank, b.x AS p95_rank
FROM (SELECT cf_bucket_size AS k, count(*) AS n_rows, count(DISTINCT item_id) AS n_items FROM candidates WHERE cf_bucket_size >= 1 GROUP BY 1) c
LEFT JOIN {_MODE.format(value="item_id", **_CAND)} m USING (k)
LEFT JOIN {_PERCENTILE.format(p="0.5::DOUBLE", value="candidate_rank", **_CAND)} a USING (k)
LEFT JOIN {_PERCENTILE.format(p="0.95::DOUBLE", value="candidate_rank", **_CAND)} b USING (k)""",
    "p1_item_profile": f"""
SELECT k AS item_id, n_rows, n_users, m.x AS mode_rating, a.x AS median_rating
FROM (SELECT item_id AS k, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM interactions WHERE item_id IS NOT NULL GROUP BY 1) c
LEFT JOIN {_MODE.format(value="overall", **_INTER)} m USING (k)
LEFT JOIN {_PERCENTILE.format(p="0.5::DOUBLE", value="overall", **_INTER)} a USING (k)""",
}
