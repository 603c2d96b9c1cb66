"""Rewards of generated candidates and group-normalised advantages.

rows: (q, i, hit), i the 0-based place of a generation in its group q.  Groups have a fixed number of generations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_reward(rows: DataFrame) -> DataFrame:
    """rows with rule (1 for a hit) and ndcg: in groups with a hit, misses lose their share of the summed gains."""
    w = Window.partitionBy("q")
    share = F.lit(1.0) / F.log2(F.col("i") + F.lit(2.0))
    return rows.withColumns({
        "rule": F.col("hit").cast("double"),
        "ndcg": F.when(F.max(F.col("hit").cast("int")).over(w) == 0, 0.0).when(F.col("hit"), 0.0).otherwise(-share / F.sum(share).over(w)),
    })


def prefix_reward(tokens: Column, target: Column) -> Column:
    """0.2, 0.5 or 1 for one, two or three leading tokens in common; 0 where the target has none."""
    same = lambda n: F.coalesce((F.size(tokens) >= n) & (F.size(target) >= n) & (F.slice(tokens, 1, n) == F.slice(target, 1, n)), F.lit(False))
    return F.when(same(3), 1.0).when(same(2), 0.5).when(same(1), 0.2).otherwise(0.0)


def group_advantage(reward: str, by: str = "q") -> Column:
    """(reward - mean) / (sample deviation + 0.0001) within the group."""
    w = Window.partitionBy(by)
    return (F.col(reward) - F.avg(reward).over(w)) / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + 1e-4)
