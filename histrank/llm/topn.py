"""Top N items within every group by simultaneous bisection.

The order is an order-preserving code of several words (doubles, ascending): the score words and at last
the identifier, so no two rows of a group are equal.  In each round all unfinished groups split the
interval of their first word that still differs into SPLITS parts, count the rows in each part (partial
counts before the shuffle), and keep only the part in which the N-th row lies; rows below are accepted,
rows above drop out.  A group of millions of rows is never sorted or gathered: it costs SPLITS counters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histrank.session import materialize

#: Parts of each interval in one round (a bisection by several midpoints at once).
SPLITS = 64


def long_words(x: Column) -> list[Column]:
    """Two words that order as the bigint x does, each exact as a double."""
    low = F.shiftright(x, 32)
    return [low.cast("double"), (x - F.shiftleft(low, 32)).cast("double")]


def descending_words(x: Column) -> list[Column]:
    """Words that order by the double x descending, null and NaN last: a class, a logarithm that keeps the order, the value."""
    bad = x.isNull() | F.isnan(x)
    limit = F.lit(float("inf"))
    finite = F.when(bad | (F.abs(x) == limit), F.lit(0.0)).otherwise(x)
    kind = F.when(bad, 3.0).when(x == limit, 0.0).when(x == -limit, 2.0).otherwise(1.0)
    return [kind, -F.signum(finite) * F.log(F.lit(1.0) + F.abs(finite) / F.lit(1e-9)), -finite]


def _ranges(words: int) -> list[Column]:
    return [f(F.get("code", F.lit(i))).alias(f"{n}{i}") for i in range(words) for n, f in (("lo", F.min), ("hi", F.max))]


def _next_word(words: int) -> Column:
    """Index of the first word that differs within the interval; null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(words)):
        out = F.when(F.col(f"lo{i}") < F.col(f"hi{i}"), F.lit(i)).otherwise(out)
    return out


def _pick(words: int, name: str) -> Column:
    return F.get(F.array(*[F.col(f"{name}{i}") for i in range(words)]), F.col("word"))


def top_n(df: DataFrame, group: str, n: int, code: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """(group, keep...): the n rows of each group with the smallest code; fewer if the group has fewer.

    code must tell all rows of a group apart (end it with an identifier).  Null groups drop out; an empty
    table gives none.
    """
    words = len(code)
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.array(*code).alias("code"), F.struct(*keep).alias("kept"))
    rows = materialize(rows, "rows")
    first = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *_ranges(words))
    state = first.withColumn("word", F.when(F.col("n") > n, _next_word(words))).select(
        "g", "word", _pick(words, "lo").alias("lo"), _pick(words, "hi").alias("hi"), F.lit(n).cast("bigint").alias("need")
    )
    accepted: list[DataFrame] = []
    while True:
        at = F.get("code", F.col("word"))
        part = F.least(F.lit(SPLITS - 1.0), F.floor((at / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * SPLITS)).cast("int")
        # groups that need no split (word is null) are accepted whole: part 0 of a finished group
        split = materialize(rows.join(state, "g").select("g", "code", "kept", "need", F.when(F.col("word").isNull(), -1).otherwise(part).alias("part")), "split")
        accepted.append(split.where("part = -1").select("g", "kept"))
        parts = split.where("part >= 0").groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), *_ranges(words))
        parts = parts.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("part"))).where("upto >= need AND upto - n < need")
        cuts = materialize(
            parts.select("g", F.col("part").alias("cut"), (F.col("need") - F.col("upto") + F.col("n")).alias("left"), (F.col("upto") == F.col("need")).alias("done"), *[c for i in range(words) for c in (f"lo{i}", f"hi{i}")]),
            "cuts",
        )
        if cuts.isEmpty():
            break
        judged = split.where("part >= 0").join(cuts.select("g", "cut", "done"), "g")
        accepted.append(judged.where("part < cut OR (done AND part = cut)").select("g", "kept"))
        open_cuts = cuts.where("NOT done")
        if open_cuts.isEmpty():
            break
        rows = judged.where("part = cut AND NOT done").select("g", "code", "kept")
        state = open_cuts.withColumn("word", _next_word(words)).select("g", "word", _pick(words, "lo").alias("lo"), _pick(words, "hi").alias("hi"), F.col("left").alias("need"))
    out = accepted[0]
    for more in accepted[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g").alias(group), "kept.*")
