"""Ranking metrics on (q, target, rank): rank is 0-based and null where the target is absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_k(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Each row once for each k."""
    return rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))


def gain(rank: Column) -> Column:
    """1 / log2(rank + 2)."""
    return F.lit(1.0) / F.log2(rank + F.lit(2.0))


def hr_ndcg(rows: DataFrame, rank: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by..., k, n, hr, ndcg): misses count in n; hr and ndcg are 0 where n is 0."""
    hit = F.coalesce(F.col(rank) < F.col("k"), F.lit(False))
    return with_k(rows, ks).groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("hr"), F.round(F.avg(F.when(hit, gain(F.col(rank))).otherwise(0.0)), 6).alias("ndcg")
    )


def mrr(rows: DataFrame, rank: str) -> Column:
    """Mean reciprocal rank, misses 0."""
    return F.round(F.avg(F.coalesce(F.lit(1.0) / (F.col(rank) + 1), F.lit(0.0))), 6)


def within(rank: str) -> Column:
    """Whether the rank lies below k."""
    return F.coalesce(F.col(rank) < F.col("k"), F.lit(False))


def rank_bucket(rank: Column) -> Column:
    """Bucket of a 0-based rank."""
    return F.when(rank.isNull(), "absent").when(rank < 5, "1-5").when(rank < 10, "6-10").when(rank < 20, "11-20").when(rank < 50, "21-50").when(rank < 100, "51-100").otherwise(">100")


def hit_bucket(rank: Column) -> Column:
    """Narrower bucket of a 0-based rank."""
    return F.when(rank.isNull(), "missing_or_not_hit").when(rank < 5, "rank_1_5").when(rank < 10, "rank_6_10").when(rank < 15, "rank_11_15").when(rank < 20, "rank_16_20").otherwise("rank_over_20")


# Names of the buckets.
BUCKETS = ("1-5", "6-10", "11-20", "21-50", "51-100", ">100", "absent")


def rate(a: Column, b: Column) -> Column:
    """a / b rounded to 6 digits, 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
