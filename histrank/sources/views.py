"""Logical tables of the engine, derived from the parquet tables, and the same tables in SQL for the oracle.

inter(user_id, item_id, rating, ts)       clean interactions, one row per user, item and second
hist(user_id, item_id, ts, history, split) up to ten earlier items of each interaction, split by time
cat(item_id, title, sid, tokens)          the catalogue with semantic-id tokens
ranked(q, item, stream, rank, score, ...)  0-based ranked candidates of the streams 'cf' and 'direct', all of them
truth(q, target)                          the wanted item of each query
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histrank.functions.sid import sid_tokens
from histrank.operators.sequences import chronological_split, group_rank, sliding_history, epoch_seconds
from histrank.session import table

#: Length of a full list in candidate_count_summary; ranked() and RANKED cut nothing.
LIST = 50


def inter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interactions").where("user_id IS NOT NULL AND item_id IS NOT NULL AND unixreviewtime IS NOT NULL")
    last = F.max_by(F.col("overall"), F.struct("ingested_at", "overall"))
    return rows.groupBy("user_id", "item_id", epoch_seconds(F.col("unixreviewtime")).alias("ts")).agg(last.alias("rating"))


def hist(spark: SparkSession, d: str) -> DataFrame:
    return chronological_split(sliding_history(inter(spark, d)), ["ts", "user_id", "item_id"])


def cat(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").where("item_id IS NOT NULL")
    return rows.select("item_id", "title", F.col("item_sid").alias("sid"), sid_tokens(F.col("item_sid")).alias("tokens"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").where("sample_id IS NOT NULL AND item_id IS NOT NULL AND candidate_rank BETWEEN 1 AND 999998")
    stream = F.when(F.col("source_type") == "sasrec_direct", "direct").otherwise("cf")
    score = F.when(~F.isnan("fusion_score"), F.col("fusion_score"))
    best = F.min(F.struct(F.col("candidate_rank"), score.isNull().alias("none"), (-score).alias("low"), "candidate_id", "source_type", "cf_expansion_level", "cf_bucket_size"))
    rows = rows.groupBy(F.col("sample_id").alias("q"), F.col("item_id").alias("item"), stream.alias("stream")).agg(best.alias("b"))
    rows = group_rank(rows, ["q", "stream"], ["b.candidate_rank", "b.none", "b.low", "item"])
    return rows.select("q", "item", "stream", "rank", (-F.col("b.low")).alias("score"), F.col("b.source_type").alias("source"), F.col("b.cf_expansion_level").alias("level"), F.col("b.cf_bucket_size").alias("bucket"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_samples").where("sample_id IS NOT NULL AND target_item_id IS NOT NULL")
    return rows.groupBy(F.col("sample_id").alias("q")).agg(F.max_by("target_item_id", F.struct("ingested_at", -F.col("target_item_id"))).alias("target"))


def ranks(spark: SparkSession, d: str) -> DataFrame:
    """(q, target, cf, direct): 0-based rank of the target in each stream, null where it is absent."""
    found = ranked(spark, d).select("q", F.col("item").alias("target"), "stream", "rank")
    rows = truth(spark, d).join(found, ["q", "target"], "left")
    pick = lambda s: F.min(F.when(F.col("stream") == s, F.col("rank"))).alias(s)
    return rows.groupBy("q", "target").agg(pick("cf"), pick("direct"))


# The same tables in SQL.
INTER = """inter AS (SELECT user_id, item_id, rating, ts FROM (SELECT user_id, item_id, overall AS rating, ingested_at,
  CASE WHEN unixreviewtime > 100000000000 THEN unixreviewtime // 1000 ELSE unixreviewtime END AS ts
  FROM interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND unixreviewtime IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id, ts ORDER BY ingested_at DESC NULLS LAST, rating DESC NULLS LAST) = 1)"""
HIST = (
    INTER
    + """, hist0 AS (SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id) - 1 AS rn, count(*) OVER () AS n FROM (
  SELECT user_id, item_id, rating, ts, list(item_id) OVER (PARTITION BY user_id ORDER BY ts, item_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS history FROM inter)
  WHERE len(history) > 0),
hist AS (SELECT user_id, item_id, ts, history, CASE WHEN rn < floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn < floor(n * 0.9::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM hist0)"""
)
CAT = """cat AS (SELECT item_id, title, item_sid AS sid, CASE WHEN regexp_full_match(regexp_replace(item_sid, '\\s+', '', 'g'), '(<[A-Za-z]_[0-9]+>)+')
  THEN regexp_extract_all(regexp_replace(item_sid, '\\s+', '', 'g'), '<[A-Za-z]_[0-9]+>') ELSE [] END AS tokens FROM items WHERE item_id IS NOT NULL)"""
RANKED = """ranked AS (SELECT q, item, stream, rank, score, source, level, bucket FROM (
  SELECT *, row_number() OVER (PARTITION BY q, stream ORDER BY candidate_rank, score DESC NULLS LAST, item) - 1 AS rank FROM (SELECT * FROM (
    SELECT sample_id AS q, item_id AS item, CASE WHEN source_type = 'sasrec_direct' THEN 'direct' ELSE 'cf' END AS stream, candidate_rank, candidate_id,
      CASE WHEN NOT isnan(fusion_score) THEN fusion_score END AS score, source_type AS source, cf_expansion_level AS level, cf_bucket_size AS bucket
    FROM candidates WHERE sample_id IS NOT NULL AND item_id IS NOT NULL AND candidate_rank BETWEEN 1 AND 999998)
  QUALIFY row_number() OVER (PARTITION BY q, item, stream ORDER BY candidate_rank, score DESC NULLS LAST, candidate_id) = 1)))"""
TRUTH = """truth AS (SELECT sample_id AS q, target_item_id AS target FROM candidate_samples WHERE sample_id IS NOT NULL AND target_item_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC, target_item_id) = 1)"""
RANKS = f"""{RANKED}, {TRUTH}, ranks AS (SELECT q, target, min(CASE WHEN stream = 'cf' THEN rank END) AS cf, min(CASE WHEN stream = 'direct' THEN rank END) AS direct
  FROM (SELECT t.q, t.target, r.stream, r.rank FROM truth t LEFT JOIN ranked r ON r.q = t.q AND r.item = t.target) GROUP BY 1, 2)"""
