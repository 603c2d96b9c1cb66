"""Items that appear together: basket collapsing and association scores.

Baskets are made sets, identical sets become one weighted basket, and pairs are enumerated once per
distinct basket.  Two exact bounds shrink baskets before that: a pair that passes has items that both
occur min_support times, and n(a,b) <= min(n(a), n(b)) gives max(n(a), n(b)) <= N / min_lift, so the
items that nearly every basket holds never meet.  Of the latter there are at most min_lift times the mean
basket length (their counts sum to no more than all items), so their list may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histrank.session import materialize

#: Left sides of pairs that one row enumerates; longer baskets are spread over several tasks.
SLICE = 64


def collapse_baskets(df: DataFrame, basket: str, items: str) -> DataFrame:
    """(items, weight): distinct sorted item sets and the number of baskets that have each.

    Rows of one basket id are united; null ids, null elements, repeats and empty baskets drop out.
    """
    sets = df.select(F.col(f"`{basket}`").alias("b"), F.array_sort(F.array_distinct(F.array_compact(F.col(f"`{items}`")))).alias("items"))
    sets = sets.where("b IS NOT NULL AND size(items) > 0").distinct()
    sets = sets.groupBy("b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return sets.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def item_pairs(df: DataFrame, basket: str, items: str, min_support: int, min_lift: float) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, conviction) for item_a < item_b.

    Exact for all pairs with n_ab >= min_support and n_ab * n >= min_lift * n_a * n_b.  conviction of
    a -> b is (1 - n_b/n) / (1 - n_ab/n_a), null where every basket with a holds b.  An empty table gives none.
    """
    baskets = materialize(collapse_baskets(df, basket, items), "baskets")
    n = baskets.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first()["n"]
    each = baskets.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n"))
    counts = materialize(each.where(F.col("n") >= min_support), "counts")
    common = counts.where(F.col("n") * F.lit(float(min_lift)) > F.lit(float(n))).select("item")
    usable = counts.join(F.broadcast(common), "item", "left_anti")
    # an item is rare or usable or common; baskets shrink to their usable items and are collapsed again
    long = baskets.where("size(items) > 1").select(F.md5(F.to_json(F.struct("items"))).alias("id"), "weight", F.explode("items").alias("item"))
    kept = long.join(F.broadcast(common), "item", "left_anti").join(usable.select("item"), "item", "left_semi")
    shrunk = kept.groupBy("id").agg(F.first("weight").alias("weight"), F.array_sort(F.collect_list("item")).alias("items"))
    shrunk = shrunk.where("size(items) > 1").groupBy("items").agg(F.sum("weight").alias("weight"))
    starts = shrunk.select("items", "weight", F.explode(F.sequence(F.lit(0), F.size("items") - 2, F.lit(SLICE))).alias("s"))
    left = starts.select("items", "weight", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + F.lit(SLICE - 1), F.size("items") - 2))).alias("i"))
    pairs = left.select(F.get("items", F.col("i")).alias("item_a"), F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"), "weight")
    pairs = pairs.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_support)
    scored = (
        pairs.join(usable.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(usable.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .where(F.col("n_ab").cast("double") * F.lit(float(n)) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
        .withColumn("n", F.lit(n).cast("bigint"))
    )
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    miss = 1 - F.col("n_ab").cast("double") / F.col("n_a")
    conviction = F.when(miss > 0, (1 - F.col("n_b").cast("double") / F.col("n")) / miss)
    return scored.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), conviction.alias("conviction"))
