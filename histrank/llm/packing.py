"""Fixed-capacity packing by shortest-pack-first over the length histogram.

Only the histogram (at most `capacity` numbers, whatever the data) reaches the driver.  Lengths are placed
longest first, each into the shortest pack (that with the most space left), and packs of the same
composition are one pattern with a count.  A pattern is a run of consecutive container numbers, so
placing items updates a few runs, not single packs.  The placements (length, first rank, number of items,
first container, copies per container, offset) are joined back to the items by their rank within the length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histrank.session import materialize

#: Items of one length that one task ranks; a length with more is spread over several hash buckets.
RANK_ROWS = 100_000


def place(histogram: dict[int, int], capacity: int, fullest: bool = False) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (length, rank0, items, container0, copies, offset) and the number of containers.

    Lengths go longest first, each item to the shortest pack (the one with the most space left), and to a new
    pack where it doesn't fit there, as then it fits nowhere.  All packs with one space left are served
    together: each of them gets one item before the next shortest does.  With `fullest` an item goes to the
    longest pack that still holds it (best fit) instead.
    The item of rank r in [rank0, rank0 + items) lies in container0 + (r - rank0) // copies at
    offset + (r - rank0) % copies * length.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # remaining space -> runs (first container, count)
    spaces: list[int] = []  # sorted keys of free
    made, out = 0, []

    def keep(space: int, run: tuple[int, int]) -> None:
        if run[1] and space:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(spaces, length) if fullest else len(spaces) - 1
            if 0 <= k < len(spaces) and spaces[k] >= length:
                space = spaces[k]
                start, count = free[space].pop()
                if not free[space]:
                    del free[space], spaces[k]
                copies = min(space // length, left) if fullest else 1
            else:  # a new pack is the shortest until the length doesn't fit any more
                space, start, count = capacity, made, -(-left // (capacity // length))
                made += count
                copies = min(capacity // length, left)
            full = min(count, left // copies)
            out.append((length, rank, full * copies, start, copies, capacity - space))
            keep(space - copies * length, (start, full))
            keep(space, (start + full, count - full))
            left -= full * copies
            rank += full * copies
    return out, made


def pack(df: DataFrame, key: str, size: str, capacity: int, fullest: bool = False) -> DataFrame:
    """(key, piece, n_tokens, container_id, container_offset): every item in a container of the capacity.

    Items above the capacity are cut into pieces of the capacity and a rest; sizes that are null or below
    1 drop out.  No container is over-filled; the same input gives the same containers.  fullest: best fit
    in place of shortest-pack-first.
    """
    cap = F.lit(capacity)
    sized = df.where(F.col(size) >= 1).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("n"))
    pieces = sized.select("key", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / cap))).alias("piece"))
    pieces = materialize(pieces.select("key", "piece", F.least(cap, F.col("n") - F.col("piece") * cap).cast("int").alias("n_tokens")), "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    placements, _ = place(histogram, capacity, fullest)
    salts = F.array(*[F.lit(1 + histogram.get(x, 0) // RANK_ROWS) for x in range(capacity + 1)])
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.get(salts, F.col("n_tokens"))))
    before = rows.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("c"))
    before = before.select("n_tokens", "salt", (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("c")).alias("before"))
    inside = Window.partitionBy("n_tokens", "salt").orderBy("key", "piece")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1).join(before, ["n_tokens", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    table = np.array(sorted(placements), np.int64).reshape(-1, 6)
    codes = table[:, 0] * (1 << 48) + table[:, 1]

    @F.pandas_udf("container_id bigint, container_offset int")
    def locate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, rank in batches:
            at = table[np.searchsorted(codes, n.to_numpy(np.int64) * (1 << 48) + rank.to_numpy(np.int64), side="right") - 1]
            nth = rank.to_numpy(np.int64) - at[:, 1]
            yield pd.DataFrame({"container_id": at[:, 3] + nth // at[:, 4], "container_offset": (at[:, 5] + nth % at[:, 4] * at[:, 0]).astype(np.int32)})

    placed = ranked.select("key", "piece", "n_tokens", locate("n_tokens", "rank").alias("at"))
    return placed.select(F.col("key").alias(key), "piece", "n_tokens", "at.container_id", "at.container_offset")
