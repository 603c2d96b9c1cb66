"""Residual quantisation, nearest centroids, low-rank factors and linear rankers with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histrank.functions.vector import dot
from histrank.operators.sequences import group_rank
from histrank.session import materialize


def residual_kmeans(rows: DataFrame, key: str, vector: str, levels: int, k: int, seed: int = 42) -> DataFrame:
    """(key, codes, residual): k-means on the vectors, then on what the centroids leave, `levels` times.

    residual is the length of what is left at the end; it does not grow from one level to the next.
    """
    rows = materialize(rows.select(key, F.transform(vector, lambda x: x.cast("double")).alias("left"), F.array().cast("array<int>").alias("codes")), "residual")
    for _ in range(levels):
        data = rows.withColumn("features", array_to_vector("left"))
        model = KMeans(k=k, seed=seed, maxIter=10).fit(data)
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
        rows = model.transform(data).select(
            key, F.zip_with("left", F.get(centres, F.col("prediction")), lambda x, c: x - c).alias("left"), F.array_append("codes", F.col("prediction")).alias("codes")
        )
        rows = materialize(rows, "residual")
    return rows.select(key, "codes", F.sqrt(dot(F.col("left"), F.col("left"))).alias("residual"))


def nearest_centroid(rows: DataFrame, key: str, vector: str, centroids: DataFrame) -> DataFrame:
    """(key, code, distance): the centroid (code, centre) of the smallest squared distance, ties to the smaller code.

    A codebook has a fixed number of codes, so it is broadcast.
    """
    pairs = rows.select(key, vector).crossJoin(F.broadcast(centroids))
    distance = F.aggregate(F.zip_with(vector, "centre", lambda x, c: F.pow(x.cast("double") - c, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    best = pairs.select(key, F.struct(F.round(distance, 9).alias("distance"), "code").alias("b")).groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, "b.code", "b.distance")


def balanced_codes(rows: DataFrame, key: str, distances: str, capacity: int) -> DataFrame:
    """(key, code): greedy assignment to the nearest code that has room, nearest pairs first; codes fill up to `capacity`.

    distances is an array with one entry for each code.  In each round every open row asks for its nearest open
    code, and each code takes the nearest askers that fit.
    """
    rows = materialize(rows.select(key, F.posexplode(distances).alias("code", "d")), "pairs")
    done: DataFrame | None = None
    room = rows.select("code").distinct().withColumn("room", F.lit(capacity))
    while True:
        asks = rows.join(F.broadcast(room.where("room > 0")), "code").groupBy(key).agg(F.min(F.struct("d", "code", "room")).alias("b")).select(key, "b.*")
        taken = materialize(group_rank(asks, ["code"], ["d", key], "n").where("n < room").select(key, "code"), "taken")
        if taken.isEmpty():
            break
        done = taken if done is None else done.unionByName(taken)
        used = taken.groupBy("code").agg(F.count(F.lit(1)).alias("u"))
        room = materialize(room.join(used, "code", "left").select("code", (F.col("room") - F.coalesce("u", F.lit(0))).cast("int").alias("room")), "room")
        rows = materialize(rows.join(taken.select(key), key, "left_anti"), "pairs")
    return done if done is not None else rows.select(key, "code")


def truncated_svd(pairs: DataFrame, rank: int, rounds: int = 15) -> DataFrame:
    """(item_a, factor): rows of U * sqrt(S) of the symmetric sparse matrix (item_a, item_b, ppmi), up to the sign of each column.

    Subspace iteration: each round multiplies the matrix with `rank` columns (a join and a sum) and makes them orthonormal
    by their Gram matrix, which has rank x rank numbers and is all that reaches the driver.
    """
    start = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda j: F.xxhash64("item", j) / F.lit(2.0**63))
    q = pairs.select(F.col("item_b").alias("item")).distinct().withColumn("x", start)

    def times(x: DataFrame) -> DataFrame:
        each = pairs.join(x.select(F.col("item").alias("item_b"), "x"), "item_b").select("item_a", F.posexplode(F.transform("x", lambda v: v * F.col("ppmi"))).alias("j", "v"))
        sums = each.groupBy("item_a", "j").agg(F.sum("v").alias("v"))
        return materialize(sums.groupBy(F.col("item_a").alias("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("x")), "columns")

    def products(rows: DataFrame, a: str, b: str) -> np.ndarray:
        sums = rows.agg(*[F.sum(F.get(a, F.lit(i)) * F.get(b, F.lit(j))) for i in range(rank) for j in range(rank)]).first()
        return np.array([x or 0.0 for x in sums], float).reshape(rank, rank)

    def turned(rows: DataFrame, m: np.ndarray) -> DataFrame:
        column = lambda j: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in m[:, j]]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
        return rows.select("item", F.array(*[column(j) for j in range(rank)]).alias("x"))

    for _ in range(rounds):
        y = times(q)
        size, basis = np.linalg.eigh(products(y, "x", "x"))
        size = np.where(size > 1e-12 * max(size.max(), 1e-300), size, np.inf)  # directions that the matrix hasn't
        q = turned(y, basis / np.sqrt(size))
    z = times(q).select("item", F.col("x").alias("z"))
    values, basis = np.linalg.eigh(products(q.join(z, "item"), "x", "z"))
    order = np.argsort(-np.abs(values), kind="stable")
    return turned(q, basis[:, order] * np.sqrt(np.abs(values[order]))).select(F.col("item").alias("item_a"), F.col("x").alias("factor"))


def reassigned(rows: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """(key, prefix, code): rows(key, prefix, distances) with as few equal (prefix, code) as `rounds` rounds allow.

    code is the nearest last-level code.  In each round, of the rows with one (prefix, code) the nearest stays, and the
    others move on to their next nearest code; a row that has tried all codes stays at its last.
    """
    order = F.transform(F.array_sort(F.transform("distances", lambda d, i: F.struct(d.alias("d"), i.alias("code")))), lambda x: x)
    rows = materialize(rows.select(key, "prefix", order.alias("order"), F.lit(0).alias("tried")), "asks")
    for _ in range(rounds):
        at = F.get("order", F.col("tried"))
        now = rows.select("*", at["code"].alias("code"), at["d"].alias("d"))
        first = now.groupBy("prefix", "code").agg(F.min(F.struct("d", key)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("prefix", "code", F.col(f"first.{key}").alias("stays"))
        moving = now.join(first, ["prefix", "code"]).where((F.col(key) != F.col("stays")) & (F.col("tried") + 1 < F.size("order"))).select(key, F.lit(1).alias("m"))
        moving = materialize(moving, "moving")
        if moving.isEmpty():
            break
        rows = materialize(rows.join(moving, key, "left").select(key, "prefix", "order", (F.col("tried") + F.coalesce("m", F.lit(0))).alias("tried")), "asks")
    return rows.select(key, "prefix", F.get("order", F.col("tried"))["code"].alias("code"))


def best_scores(queries: DataFrame, items: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(q, item, score): of every query (q, x) the k items (item, u) of the largest inner product, rounded to 5 digits, ties to the smaller item.

    Queries and items meet in blocks of `block` rows; each block gives its k best, so at most k rows per query and block are left.
    """

    def packed(df: DataFrame, key: str, vector: str, name: str) -> tuple[DataFrame, int]:
        parts = max(1, -(-df.count() // block))
        rows = df.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(name), F.struct(F.col(key).alias("k"), F.col(vector).alias("v")).alias("r"))
        return materialize(rows.groupBy(name).agg(F.collect_list("r").alias(f"{name}_rows")), "block"), parts

    (left, _), (right, n) = packed(queries, "q", "x", "qb"), packed(items, "item", "u", "ib")
    met = left.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(right, "ib")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                x, u = (np.array([r["v"] for r in rows], float) for rows in (row.qb_rows, row.ib_rows))
                q, item = (np.array([r["k"] for r in rows], np.int64) for rows in (row.qb_rows, row.ib_rows))
                score = np.round(x @ u.T, 5) + 0.0
                order = np.lexsort((np.broadcast_to(item, score.shape), -score), axis=1)[:, :k]
                yield pd.DataFrame({"q": np.repeat(q, order.shape[1]), "item": item[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})

    found = met.mapInPandas(best, "q bigint, item bigint, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item"))
    return found.withColumn("n", nth).where(F.col("n") <= k).drop("n")


def pairwise_ranker(positives: DataFrame, negatives: DataFrame, names: tuple[str, ...], l2: float = 0.01) -> dict[str, float]:
    """Weights of a linear ranker: logistic regression on the differences of positives and negatives of one query."""
    from pyspark.ml.classification import LogisticRegression

    pairs = positives.alias("p").join(negatives.alias("n"), "q")
    diff = [F.col(f"p.{x}") - F.col(f"n.{x}") for x in names]
    there = pairs.select(array_to_vector(F.array(*diff)).alias("features"), F.lit(1.0).alias("label"))
    back = pairs.select(array_to_vector(F.array(*[-x for x in diff])).alias("features"), F.lit(0.0).alias("label"))
    model = LogisticRegression(regParam=l2, fitIntercept=False, maxIter=30).fit(there.unionByName(back))
    return dict(zip(names, (float(x) for x in model.coefficients)))


def balanced_logistic(rows: DataFrame, names: tuple[str, ...], label: str) -> DataFrame:
    """rows with probability: logistic regression in which both classes weigh the same."""
    from pyspark.ml.classification import LogisticRegression

    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    weight = F.when(F.col(label) == 1, n["n"] / (2 * max(1, n["p"]))).otherwise(n["n"] / (2 * max(1, n["n"] - n["p"])))
    data = rows.withColumns({"features": array_to_vector(F.array(*names)), "label": F.col(label).cast("double"), "weight": weight})
    scored = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30).fit(data).transform(data)
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, "score")


def sinkhorn_codes(rows: DataFrame, key: str, distances: str, capacity: int, epsilon: float = 0.05, rounds: int = 50) -> DataFrame:
    """(key, code): a balanced mapping by entropic transport; codes fill up to `capacity`.

    distances is an array with one entry for each code.  Row weights are made to sum to 1 and code weights to be equal, in turn;
    in each round the partitions' sums, one number for each code, are all that reaches the driver.  Rows then take the codes of the
    largest weight that have room (balanced_codes).  Costs are divided by their mean over all rows and codes.
    """
    rows = materialize(rows.select(key, F.col(distances).alias("d")), "costs")
    scale = rows.select(F.avg(F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")).alias("m"), F.count(F.lit(1)).alias("n"), F.max(F.size("d")).alias("k")).first()
    if not scale["n"]:
        return rows.select(key, F.lit(0).alias("code"))
    n, k, mean = scale["n"], scale["k"], scale["m"] or 1.0
    price = np.zeros(k)
    for _ in range(rounds):

        def partial(batches: Iterator[pd.DataFrame], price: np.ndarray = price) -> Iterator[pd.DataFrame]:
            total = np.zeros(k)
            for b in batches:
                if len(b):
                    w = price - np.stack(b.d.to_numpy()) / (mean * epsilon)
                    w = np.exp(w - w.max(axis=1, keepdims=True))
                    total += (w / w.sum(axis=1, keepdims=True)).sum(axis=0)
            yield pd.DataFrame({"code": np.arange(k, dtype=np.int32), "mass": total})

        mass = {r["code"]: r["m"] for r in rows.select("d").mapInPandas(partial, "code int, mass double").groupBy("code").agg(F.sum("mass").alias("m")).collect()}
        step = np.log(n / k) - np.log(np.maximum([mass[c] for c in range(k)], 1e-300))
        price = price + step
        if np.abs(step).max() < 1e-3:
            break
    book = F.array(*[F.lit(float(p)) for p in price])
    cost = F.zip_with("d", book, lambda d, p: d / F.lit(mean * epsilon) - p)
    return balanced_codes(rows.select(key, cost.alias("d")), key, "d", capacity)
