"""Union, fusion, reranking and promotion of ranked candidate streams.

ranked: (q, item, stream, rank, score, source, level, bucket), rank 0-based and unique in each (q, stream).
Lists may be of any length: places within a query come from group_rank, figures of a query from aggregates that are joined,
and windows over a query see its first rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histrank.operators.sequences import group_rank

FAR = 10**12  # a rank that no candidate has


def place(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their 0-based place within the query in the order."""
    return group_rank(rows, ["q"], order, name)


def first_places(rows: DataFrame, most: int, *order: Column, by: tuple[str, ...] = ("q",), name: str = "rank") -> DataFrame:
    """The first `most` rows of each group with their 0-based place; the limit is applied before the shuffle as well."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, nth).where(F.col(name) <= most).withColumn(name, F.col(name) - 1)


def with_totals(rows: DataFrame, *totals: Column) -> DataFrame:
    """rows with aggregates of their query."""
    return rows.join(rows.groupBy("q").agg(*totals), "q")


def both_streams(ranked: DataFrame) -> DataFrame:
    """(q, item, cf, direct, ...): full outer join of the streams; ranks are null where an item is absent."""
    side = lambda s: ranked.where(F.col("stream") == s).select("q", "item", F.col("rank").alias(s), F.col("score").alias(f"{s}_score"), F.col("source").alias(f"{s}_source"), F.col("level").alias(f"{s}_level"), F.col("bucket").alias(f"{s}_bucket"))
    return side("cf").join(side("direct"), ["q", "item"], "full")


def either(rows: DataFrame) -> DataFrame:
    """rows with both (whether both streams have the item) and low (the smaller 1-based rank)."""
    low = F.least(F.coalesce("cf", F.lit(FAR)), F.coalesce("direct", F.lit(FAR))) + 1
    return rows.withColumn("both", F.col("cf").isNotNull() & F.col("direct").isNotNull()).withColumn("low", low)


def rrf(rows: DataFrame, weight: float = 0.5, k: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion: weight / (k + cf) + (1 - weight) / (k + direct) over 1-based ranks."""
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c) + 1), F.lit(0.0))
    rows = either(rows).withColumn("fused", part("cf", weight) + part("direct", 1.0 - weight))
    return place(rows, F.desc(F.round("fused", 12)), F.col("low"), F.desc("both"), F.col("item"))


def min_rank(rows: DataFrame) -> DataFrame:
    """Order by the smaller rank, both streams first, then each rank; the score is its reciprocal."""
    rows = either(rows).withColumn("fused", F.lit(1.0) / F.col("low"))
    return place(rows, F.col("low"), F.desc("both"), F.coalesce("cf", F.lit(FAR)), F.coalesce("direct", F.lit(FAR)), F.col("item"))


def source_aware_rrf(rows: DataFrame, weight: float, bonus: float) -> DataFrame:
    """1 / (61 + cf) + weight / (61 + direct), plus a bonus where both streams have the item."""
    rows = either(rows)
    score = F.coalesce(F.lit(1.0) / (F.col("cf") + 61), F.lit(0.0)) + F.coalesce(F.lit(weight) / (F.col("direct") + 61), F.lit(0.0)) + F.when(F.col("both"), F.lit(bonus)).otherwise(0.0)
    return place(rows.withColumn("fused", score), F.desc(F.round("fused", 12)), F.col("low"), F.col("item"))


def ordered_union(rows: DataFrame, exclusive: int | None = None) -> DataFrame:
    """cf in its order, then the items that only direct has in theirs, at most `exclusive` of them."""
    if exclusive is not None:
        rows = rows.where("cf IS NOT NULL").unionByName(first_places(rows.where("cf IS NULL"), exclusive, F.col("direct"), name="nth").drop("nth"))
    return place(rows, F.asc_nulls_last("cf"), F.asc_nulls_last("direct"))


def best_source(rows: DataFrame) -> DataFrame:
    """rows with source and bucket of the better source: exact before long prefixes before short ones."""
    order = lambda c: F.when(F.col(c) == "exact", 3).when(F.col(c).isin("prefix@4", "prefix@3"), 2).when(F.col(c).isin("prefix@2", "prefix@1"), 1).when(F.col(c).isNotNull(), 0).otherwise(-1)
    cf_first = order("cf_source") >= order("direct_source")
    cf, direct = F.coalesce(F.col("cf_bucket").cast("double"), F.lit(1.0)), F.col("direct_bucket").cast("double")
    bucket = F.when(direct.isNull(), cf).when(cf > 1, F.least(cf, direct)).otherwise(direct)
    return rows.withColumns({"source": F.when(cf_first, F.col("cf_source")).otherwise(F.col("direct_source")), "bucket": bucket})


def source_score(source: Column, level: Column) -> Column:
    """1 for exact, else a quarter for each level of the prefix, between 0 and 1."""
    return F.when(source == "exact", 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(level.cast("double") / 4, F.lit(0.0)))))


#: Names of the features of ranker_features, in order.
FEATURES = (
    "text_present", "cf_present", "both_sources", "text_only", "cf_only", "source_count", "text_rank_filled", "cf_rank_filled", "min_source_rank", "fusion_rank",
    "reciprocal_text_rank", "reciprocal_cf_rank", "reciprocal_min_source_rank", "reciprocal_fusion_rank", "fusion_score",
)


def ranker_features(fused: DataFrame) -> DataFrame:
    """The features of each fused candidate; a missing rank counts as one beyond the query's candidates."""
    t, c, r = F.col("cf") + 1, F.col("direct") + 1, F.col("rank") + 1
    rows = with_totals(fused, F.count(F.lit(1)).alias("n")).withColumns({"t": F.coalesce(t, F.col("n") + 1), "c": F.coalesce(c, F.col("n") + 1)})
    has_t, has_c, low = F.col("cf").isNotNull(), F.col("direct").isNotNull(), F.least("t", "c")
    zero = F.lit(0.0)
    values = (
        has_t, has_c, has_t & has_c, has_t & ~has_c, has_c & ~has_t, has_t.cast("int") + has_c.cast("int"), F.col("t"), F.col("c"), low, r,
        F.coalesce(F.lit(1.0) / t, zero), F.coalesce(F.lit(1.0) / c, zero), F.lit(1.0) / low, F.lit(1.0) / r, F.col("fused"),
    )
    return rows.select("q", "item", *[v.cast("double").alias(name) for name, v in zip(FEATURES, values)])


def standardised(rows: DataFrame, fit: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows with each feature less its mean over `fit`, divided by its population deviation (1 where it is nearly 0)."""
    stats = fit.agg(*[f(x).alias(f"{x}_{k}") for x in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {x: (F.col(x) - F.col(f"{x}_m")) / F.when(F.col(f"{x}_s") > 1e-12, F.col(f"{x}_s")).otherwise(1.0) for x in names}
    return rows.crossJoin(F.broadcast(stats)).withColumns(z).select(*rows.columns)


def linear_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with total: the weighted sum of the features, and rank by it (ties by fusion rank, then item)."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.col(name)
    return place(rows.withColumn("total", F.round(total, 9)), F.desc("total"), F.col("fusion_order"), F.col("item"))


def cf_quota_reorder(fused: DataFrame, quota: int, top: int = 20) -> DataFrame:
    """The `quota` best of cf's first `top` go first, in order of the fused rank; all others follow in theirs."""
    kept = first_places(fused.where(F.col("cf") < top).select("q", "item", "rank"), quota, F.col("rank"), name="nth")
    rows = fused.join(kept.select("q", "item", F.lit(True).alias("first")), ["q", "item"], "left").fillna(False, ["first"])
    return place(rows, F.desc("first"), F.col("rank"), name="new_rank")


def tail_promotion(rows: DataFrame, most: int, threshold: float, top: int = 20) -> DataFrame:
    """(q, item, new_rank, promoted): up to `most` items that only direct has, with probability >= threshold, take the tail of cf's first `top`."""
    only = F.col("cf").isNull() & (F.col("probability") >= threshold)
    sizes = rows.groupBy("q").agg(F.least(F.lit(top), F.count("cf")).alias("size"))
    best = first_places(rows.where(only).select("q", "item", "probability", "direct"), most, F.desc("probability"), F.col("direct"), F.col("item"), name="nth")
    best = best.join(sizes, "q").where("nth < size").select("q", "item", (F.col("nth") + 1).alias("nth"), F.lit(True).alias("promoted"))
    sizes = sizes.join(best.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q", "left").fillna(0, ["n"])
    rows = rows.join(sizes, "q").join(best, ["q", "item"], "left").fillna(False, ["promoted"])
    retained = F.coalesce(F.col("cf") < F.least(F.lit(top) - F.col("n"), F.col("size")), F.lit(False))
    group = F.when(retained, 0).when(F.col("promoted"), 1).when(F.col("cf").isNotNull(), 2).otherwise(3)
    order = F.when(retained | (group == 2), F.col("cf")).when(F.col("promoted"), F.col("nth")).otherwise(F.col("direct"))
    return place(rows.withColumns({"grp": group, "ord": order}), F.col("grp"), F.col("ord"), F.col("item"), name="new_rank").select("q", "item", "cf", "direct", "new_rank", "promoted")
