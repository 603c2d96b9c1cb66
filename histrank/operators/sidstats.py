"""Statistics of semantic ids: collisions, levels, prefixes, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histrank.functions.sid import sid_prefixes


def dedup_suffix(items: DataFrame, sid: str) -> DataFrame:
    """items with unique_sid: ids that several items share get the suffix <d_k>, k from 1 in order of the items."""
    bucket = Window.partitionBy(sid)
    n = F.count(F.lit(1)).over(bucket)
    k = F.row_number().over(bucket.orderBy("item_id"))
    return items.withColumn("unique_sid", F.when(n > 1, F.concat(F.col(sid), F.lit("<d_"), k.cast("string"), F.lit(">"))).otherwise(F.col(sid)))


def uniqueness(items: DataFrame, sid: str) -> DataFrame:
    """One row: items, different ids, share of items beyond the first of each id, collided items and groups, bucket sizes."""
    g = items.groupBy(sid).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_sids"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("collision_rate"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("collided_items"), F.count_if(F.col("n") > 1).alias("collided_groups"),
        F.max("n").alias("max_bucket"), F.round(F.avg("n"), 6).alias("mean_bucket"), F.round(F.percentile("n", 0.95), 6).alias("p95_bucket"),
    )


def level_stats(items: DataFrame) -> DataFrame:
    """Per level: tokens, entropy in bits, perplexity, spread of the token counts, Gini index, tokens above mean + 2 sigma."""
    t = items.select(F.posexplode("tokens").alias("level", "token")).groupBy((F.col("level") + 1).alias("level"), "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("level")
    t = t.withColumns({
        "total": F.sum("n").over(w), "mean": F.avg("n").over(w), "sd": F.stddev_pop("n").over(w), "k": F.count(F.lit(1)).over(w),
        "i": F.row_number().over(w.orderBy("n", "token")),
    })
    entropy = -F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("total")))
    return t.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.round(entropy, 6).alias("entropy"), F.round(F.coalesce(F.try_divide(entropy, F.log2(F.count(F.lit(1)))), F.lit(0.0)), 6).alias("normalized"), F.round(F.pow(F.lit(2.0), entropy), 6).alias("perplexity"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.95), 6).alias("p95"),
        F.round(F.sum((2 * F.col("i") - F.col("k") - 1) * F.col("n")).cast("double") / (F.first("k") * F.sum("n")), 6).alias("gini"),
        F.count_if(F.col("n") > F.col("mean") + 2 * F.col("sd")).alias("hotspots"),
    )


def prefix_stats(items: DataFrame) -> DataFrame:
    """Per level and prefix of items(sid, tokens): items, different next tokens, sizes of their buckets, share of items
    that share an id, and whether it holds more items than mean + 2 sigma of its level."""
    sizes = items.groupBy("sid").agg(F.count(F.lit(1)).alias("b"))
    p = items.join(sizes, "sid").select("b", "tokens", F.explode(sid_prefixes(F.col("tokens"))).alias("p")).select("p.level", "p.prefix", "b", F.get("tokens", F.col("p.level")).alias("child"))
    p = p.groupBy("level", "prefix").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("child").alias("fanout"), F.round(F.avg("b"), 6).alias("bucket_mean"), F.max("b").alias("bucket_max"), F.round(F.avg((F.col("b") > 1).cast("double")), 6).alias("pressure")
    )
    level = p.groupBy("level").agg((F.avg("n_items") + 2 * F.stddev_pop("n_items")).alias("limit"))
    return p.join(F.broadcast(level), "level").withColumn("hotspot", F.col("n_items") > F.col("limit")).drop("limit")


def prefix_summary(stats: DataFrame) -> DataFrame:
    """Per level: what prefix_stats gives, rolled up."""
    return stats.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_prefixes"), F.round(F.avg("n_items"), 6).alias("mean_items"), F.max("n_items").alias("max_items"), F.round(F.percentile("n_items", 0.95), 6).alias("p95_items"), F.round(F.avg("fanout"), 6).alias("mean_fanout"),
        F.max("fanout").alias("max_fanout"), F.max("pressure").alias("max_pressure"), F.count_if("hotspot").alias("n_hotspots"),
    )


def sid2items(items: DataFrame, sid: str) -> DataFrame:
    """(sid, items, n): the items of each id in order."""
    return items.groupBy(sid).agg(F.array_sort(F.collect_list("item_id")).alias("items"), F.count(F.lit(1)).alias("n"))


def array_lookup(rows: DataFrame, key: str, array: str, dim: DataFrame, name: str) -> DataFrame:
    """(key, name): the values of dim (key, value) of the array's elements in order; elements without a value drop out."""
    each = rows.select(F.col(key), F.posexplode(array).alias("_pos", "_key")).join(dim.where("value IS NOT NULL").select(F.col("key").alias("_key"), "value"), "_key")
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "value"))), lambda x: x["value"]).alias(name))
