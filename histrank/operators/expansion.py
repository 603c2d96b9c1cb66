"""From predicted semantic ids to candidate items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histrank.functions.sid import sid_prefix
from histrank.operators.sequences import group_rank


def expand(pred: DataFrame, dim: DataFrame, levels: Sequence[int] = (), invalid: bool = False) -> DataFrame:
    """(q, item, place, source, level, bucket, sid_rank, sources): candidates of predicted ids pred(q, sid_rank, sid, tokens).

    dim(item, sid, tokens) is the catalogue.  The items of each predicted id come first, then those of ids with the same
    prefix of each level, longest level first, ids and items in order.  Predicted ids that the catalogue hasn't are expanded by
    prefix only if `invalid` is set.  An item keeps its first place and detail,
    and gathers the sources that bring it.  Of predictions of one id, or of one prefix, only the first counts.
    """
    sizes = dim.groupBy("sid").agg(F.count(F.lit(1)).alias("bucket"))
    items = dim.join(sizes, "sid").select("item", "sid", "tokens", "bucket")
    exact = pred.groupBy("q", "sid", F.size("tokens").alias("level")).agg(F.min("sid_rank").alias("sid_rank")).join(items.select("item", "sid", "bucket"), "sid")
    parts = [exact.select("q", "sid_rank", F.lit(0).alias("stage"), "sid", "item", F.lit("exact").alias("source"), "level", "bucket")]
    valid = pred if invalid else pred.join(sizes.select("sid"), "sid", "left_semi")
    for stage, level in enumerate(sorted(levels, reverse=True), start=1):
        left = valid.select("q", "sid_rank", sid_prefix(F.col("tokens"), level).alias("prefix")).where("prefix IS NOT NULL").groupBy("q", "prefix").agg(F.min("sid_rank").alias("sid_rank"))
        right = items.select("item", "sid", "bucket", sid_prefix(F.col("tokens"), level).alias("prefix"))
        found = left.join(right, "prefix")
        parts.append(found.select("q", "sid_rank", F.lit(stage).alias("stage"), "sid", "item", F.lit(f"prefix@{level}").alias("source"), F.lit(level).alias("level"), "bucket"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    first = F.min(F.struct("sid_rank", "stage", "sid", "item", "source", "level", "bucket"))
    rows = rows.groupBy("q", "item").agg(first.alias("f"), F.array_sort(F.collect_set("source")).alias("sources"))
    rows = group_rank(rows, ["q"], ["f.sid_rank", "f.stage", "f.sid", "item"], "place")
    return rows.select("q", "item", "place", F.col("f.source").alias("source"), F.col("f.level").alias("level"), F.col("f.bucket").alias("bucket"), F.col("f.sid_rank").alias("sid_rank"), "sources")
