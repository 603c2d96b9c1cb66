"""Joins that must be one to one: they fail, with counts, where the sides don't fit together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histrank.operators.sequences import global_rank


def align_strict(a: DataFrame, b: DataFrame, key: str, same: Sequence[str] = ()) -> DataFrame:
    """The inner join of a and b on key, with the columns `same` (of both) equal.

    An error where a key repeats or is null, is on one side only, or where a pair differs in one of `same`; nulls are equal.
    """
    left = a.select(key, F.struct(*[c for c in a.columns if c != key]).alias("_a"), F.lit(1).alias("_ia"))
    right = b.select(key, F.struct(*[c for c in b.columns if c != key]).alias("_b"), F.lit(1).alias("_ib"))
    both = left.join(right, key, "full")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col("_a")[c].eqNullSafe(F.col("_b")[c])
    paired = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    found = both.agg(F.count_if(F.col("_ib").isNull()).alias("only_left"), F.count_if(F.col("_ia").isNull()).alias("only_right"), F.count_if(paired & differs).alias("different"), F.count_if(paired).alias("pairs"), F.countDistinct(F.when(paired, F.col(key))).alias("keys")).first()
    if found["only_left"] or found["only_right"] or found["different"] or found["pairs"] != found["keys"]:
        raise ValueError(f"sides don't align on {key}: {found.asDict()}")
    return both.select(key, "_a.*", *[F.col("_b")[c].alias(c) for c in b.columns if c != key and c not in a.columns])


def zip_by_position(a: DataFrame, order_a: Sequence[str], b: DataFrame, order_b: Sequence[str]) -> DataFrame:
    """Rows of a and b with the same place in their orders, as (position, columns of a, columns of b); an error where the numbers of rows differ."""
    (left, n), (right, m) = global_rank(a, order_a, "position"), global_rank(b, order_b, "position")
    if n != m:
        raise ValueError(f"{n} rows can't be zipped with {m}")
    return left.select("position", *a.columns).join(right.select("position", *[c for c in b.columns if c not in a.columns]), "position")


def merge_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, str]:
    """(inner join, key): joined on the first of keys that both sides have and that is unique and never null on both; an error if there is none."""
    for key in keys:
        if key in a.columns and key in b.columns:
            counts = [df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("u")).first() for df in (a, b)]
            if all(c["n"] == c["u"] for c in counts):
                return a.join(b.select(key, *[c for c in b.columns if c not in a.columns]), key), key
    raise ValueError(f"no key of {list(keys)} is unique on both sides")
