"""Co-occurrence of items in baskets, and positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooccurrences(rows: DataFrame, basket: str, items: str) -> DataFrame:
    """(item_a, item_b, n): baskets that hold both, in both directions.

    Equal item sets are collapsed to one weighted set before pairs are enumerated.
    """
    sets = rows.where(F.col(basket).isNotNull()).groupBy(F.col(basket).alias("b")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(items))))).alias("x"))
    sets = sets.groupBy("x").agg(F.count(F.lit(1)).alias("w")).where(F.size("x") > 1)
    pairs = sets.select("x", "w", F.explode("x").alias("item_a")).select("item_a", "w", F.explode("x").alias("item_b")).where("item_a <> item_b")
    return pairs.groupBy("item_a", "item_b").agg(F.sum("w").alias("n"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(item_a, item_b, ppmi): max(0, ln(n * total / (n_a * n_b))) where it is above 0."""
    sums = pairs.groupBy("item_a").agg(F.sum("n").alias("s"))
    total = pairs.agg(F.sum("n").alias("t"))
    scored = pairs.join(sums.withColumnRenamed("s", "sa"), "item_a").join(sums.select(F.col("item_a").alias("item_b"), F.col("s").alias("sb")), "item_b").crossJoin(F.broadcast(total))
    value = F.log(F.col("n").cast("double") * F.col("t") / (F.col("sa").cast("double") * F.col("sb")))
    return scored.select("item_a", "item_b", F.round(value, 6).alias("ppmi")).where("ppmi > 0")
