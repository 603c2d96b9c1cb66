"""Per-key results where a few keys hold most rows: value-frequency compression.

Rows are first grouped by key AND value, so that the shuffle spreads a hot key over all tasks by
its values and repeated values collapse map-side.  Distinct counts, modes and percentiles are then
derived from the weighted values; the second grouping sees partial aggregates only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges into which percentiles split a key, so that no task sorts a whole hot key.
VALUE_BUCKETS = 64


def compress(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, weight): how often each key has each value.

    Null keys are dropped, a null value is kept as a value of its own.  An empty table gives none.
    """
    return df.select(key.alias("key"), value.alias("value")).where("key IS NOT NULL").groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def key_counts(weighted: DataFrame) -> DataFrame:
    """(key, n_rows, n_values): rows and distinct non-null values of each key, exact."""
    return weighted.groupBy("key").agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_values"))


def key_modes(weighted: DataFrame) -> DataFrame:
    """(key, mode, mode_rows): the most frequent non-null value of each key, ties to the smallest value."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v")))
    return (
        weighted.where("value IS NOT NULL").groupBy("key").agg(best.alias("b")).select("key", F.col("b.v").alias("mode"), (-F.col("b.w")).alias("mode_rows"))
    )


def key_percentiles(weighted: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(key, p, value): for each key and p the smallest value that at least p of its rows do not exceed.

    Exact.  Boundaries from one bounded sketch over all values split each key into VALUE_BUCKETS
    ranges; cumulated range weights tell the range that holds the answer, and only the rows of that
    range are ordered.  The boundaries change the balance of tasks, never the result.
    Null and NaN values do not count; a key without other values gives no row.
    """
    rows = weighted.where("value IS NOT NULL AND NOT isnan(cast(value AS double))")
    cuts = rows.agg(F.percentile_approx("value", [i / VALUE_BUCKETS for i in range(1, VALUE_BUCKETS)], 1000)).first()[0]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<double>")
    rows = rows.withColumn("range", F.size(F.filter(bounds, lambda b: b < F.col("value"))))
    ranges = rows.groupBy("key", "range").agg(F.sum("weight").alias("w"))
    by_key = Window.partitionBy("key")
    ranges = ranges.withColumn("upto", F.sum("w").over(by_key.orderBy("range"))).withColumn("total", F.sum("w").over(by_key))
    wanted = ranges.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    wanted = wanted.withColumn("target", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("total"))))
    wanted = wanted.where("upto >= target AND upto - w < target").select("key", "range", "p", (F.col("target") - F.col("upto") + F.col("w")).alias("left"))
    inside = Window.partitionBy("key", "range", "p").orderBy("value")
    return (
        rows.join(wanted, ["key", "range"])
        .withColumn("upto", F.sum("weight").over(inside))
        .where("upto >= left AND upto - weight < left")
        .select("key", "p", "value")
    )


def heavy_keys(weighted: DataFrame, share: float, disjoint: bool) -> DataFrame:
    """(key, n_values, n_total): keys that hold at least `share` of all distinct values.

    disjoint tells that a value belongs to one key only (the key is part of it); else the values of
    all keys are made distinct once more for the total.  A null value counts as one value here.
    """
    per_key = weighted.groupBy("key").agg(F.count(F.lit(1)).alias("n_values"))
    total = per_key.agg(F.sum("n_values").alias("n_total")) if disjoint else weighted.select("value").distinct().agg(F.count(F.lit(1)).alias("n_total"))
    return per_key.crossJoin(F.broadcast(total)).where(F.col("n_values") >= F.lit(share) * F.col("n_total"))
