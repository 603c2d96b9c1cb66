"""User sequences, sliding histories, global order and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histrank.session import materialize


def epoch_seconds(x: Column) -> Column:
    """Seconds of an epoch number that may be in milliseconds."""
    return F.when(x > 100_000_000_000, F.floor(x / 1000)).otherwise(x).cast("bigint")


def user_sequence(rows: DataFrame) -> DataFrame:
    """(user_id, items, n): items of each user in order of time, repeats kept."""
    events = F.array_sort(F.collect_list(F.struct("ts", "item_id")))
    return rows.groupBy("user_id").agg(F.transform(events, lambda e: e["item_id"]).alias("items"), F.count(F.lit(1)).alias("n"))


def sliding_history(rows: DataFrame, length: int = 10) -> DataFrame:
    """Each interaction with the user's up to `length` items before it; first interactions drop out."""
    w = Window.partitionBy("user_id").orderBy("ts", "item_id").rowsBetween(-length, -1)
    return rows.select("user_id", "item_id", "ts", F.collect_list("item_id").over(w).alias("history")).where(F.size("history") > 0)


def global_rank(rows: DataFrame, order: Sequence[str], name: str = "rn") -> tuple[DataFrame, int]:
    """rows with their 0-based place in the total order, and their number.

    Rows are range-partitioned by the order and written; each partition counts its rows, and places are
    offsets plus places within the partition.  No single task sees all rows.
    """
    placed = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number per partition
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p] = total
        total += sizes[p]
    if not sizes:
        return placed.drop("_part").withColumn(name, F.lit(0).cast("bigint")), 0
    start = F.get(F.array(*[F.lit(offsets.get(p, 0)).cast("bigint") for p in range(max(sizes) + 1)]), F.col("_part"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn(name, start + inside).drop("_part"), total


def group_rank(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """rows with their 0-based place in the order within their group; the order tells all rows of a group apart.

    Rows are range-partitioned by group and order, so a large group spreads over partitions: places are offsets of
    the group's earlier partitions plus places within the partition.  Group columns hold no nulls.
    """
    keys = ["_part", *group]
    placed = materialize(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "placed")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    # a row for each boundary of partitions that a group crosses, hence fewer than partitions
    found = placed.withColumn(name, inside).join(F.broadcast(before.select(*keys, "_before")), keys, "left")
    return found.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("int")).select(*[c for c in rows.columns if c != name], name)


def chronological_split(rows: DataFrame, order: Sequence[str], train: float = 0.8, valid: float = 0.9) -> DataFrame:
    """rows with split: the first floor(n * train) in the order are train, up to floor(n * valid) valid, the rest test."""
    ordered, n = global_rank(rows, order)
    return ordered.withColumn("split", F.when(F.col("rn") < int(n * train), "train").when(F.col("rn") < int(n * valid), "valid").otherwise("test")).drop("rn")


def dense_ids(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, id): 0-based ids in the order in which keys are first seen."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("f"))
    ranked, _ = global_rank(first.select(key, *[F.col(f"f.{c}").alias(f"o_{c}") for c in order]), [*[f"o_{c}" for c in order], key], "id")
    return ranked.select(key, "id")


def row_range_shards(rows: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """rows with shard: shard i has the rows [i * n // shards, (i + 1) * n // shards) of the order."""
    ranked, n = global_rank(rows, order)
    return ranked.withColumn("shard", F.floor(((F.col("rn") + 1) * shards - 1) / F.lit(max(1, n))).cast("int"))


def kcore(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(rows of the k-core, rounds): users and items with fewer than k rows, counted on one snapshot, drop out until none does."""
    rounds, before = 0, -1
    rows = materialize(rows, "core")
    count = rows.count()
    while count != before:
        users = rows.groupBy("user_id").count().where(F.col("count") >= k).select("user_id")
        items = rows.groupBy("item_id").count().where(F.col("count") >= k).select("item_id")
        rows = materialize(rows.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi"), "core")
        before, count, rounds = count, rows.count(), rounds + 1
    return rows, rounds


def hash_split(rows: DataFrame, user: Column, seed: int = 42, tag: str = "split") -> DataFrame:
    """rows with bucket (0-99) and split by the sha-256 of tag:seed:user: fit below 60, select below 80, else gate."""
    digest = F.substring(F.sha2(F.concat_ws(":", F.lit(tag), F.lit(str(seed)), user.cast("string")), 256), 1, 16)
    bucket = (F.conv(digest, 16, 10).cast("decimal(20,0)") % 100).cast("int")
    return rows.withColumn("bucket", bucket).withColumn("split", F.when(bucket < 60, "fit").when(bucket < 80, "select").otherwise("gate"))


def hash_order_split(rows: DataFrame, key: Column, fraction: float, seed: int = 42) -> DataFrame:
    """rows with part: the floor(n * fraction) rows with the smallest sha-256 are fit, the rest select."""
    hashed = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256))
    ranked, n = global_rank(hashed, ["digest"])
    return ranked.withColumn("part", F.when(F.col("rn") < int(n * fraction), "fit").otherwise("select")).drop("rn")


def popularity_groups(counts: DataFrame, head: float, tail: float) -> DataFrame:
    """(item_id, n, grp): head, mid or tail by count, most frequent first, ties to the smaller item."""
    ranked, n = global_rank(counts.withColumn("low", -F.col("n")), ["low", "item_id"])
    heads = max(1, int(n * head)) if head > 0 and n else int(n * head)
    tails = max(1, int(n * tail)) if tail > 0 and n else int(n * tail)
    tails = max(0, n - heads) if heads + tails > n else tails
    return ranked.select("item_id", "n", F.when(F.col("rn") < heads, "head").when(F.col("rn") >= n - tails, "tail").otherwise("mid").alias("grp"))


def min_max(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with `name`: value scaled to [0, 1] over all rows, 0.5 where all are equal; null stays null."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5))
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, F.when(F.col(value).isNotNull(), scaled)).drop("_lo", "_hi")


def adaptive_core(rows: DataFrame, k: int, start: int, first: int, least: int, year: int = 31_536_000) -> tuple[DataFrame, int]:
    """(k-core of the rows from a start on, the start): while fewer than `least` items are left and the start lies behind
    `first`, it moves back by a year and the core is made anew."""
    rows = materialize(rows, "window")
    earliest = rows.agg(F.min("ts")).first()[0]
    while True:
        inside = rows.where(F.col("ts") >= start)
        last = start <= first
        if last or inside.select("item_id").distinct().count() >= least:  # a core has no more items than its window
            core = kcore(inside, k)[0]
            if last or core.select("item_id").distinct().count() >= least:
                return core, start
            if earliest is None or start <= earliest:  # the window holds all rows, so the core stays as it is
                return core, start - year * -(-(start - first) // year)
        start -= year


def first_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in the order; an error if there are fewer."""
    found = materialize(rows.orderBy(*order).limit(n), "first")
    if (have := found.count()) < n:
        raise ValueError(f"{n} rows asked for, {have} there")
    return found
