"""Most similar vectors of every vector.

Copies (equal to 6 decimals after normalisation) are one node, so a vector that a third of the rows share costs
one search.  Nodes belong to the cell of their nearest centroid (spherical k-means on a bounded sample); a cell is a group of near
centroids, and one with more
than SHARD nodes is split by hash.  Each shard gets a robust-pruned graph (histrank.llm.graph), and every node is
searched by beam in the shards of its PROBES nearest cells only, so the work grows in proportion to the nodes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histrank.llm import graph
from histrank.session import materialize

#: Nodes of a cell at most, as the sample has it, and of a shard on average (what one task builds a graph of).
CELL, SHARD = 8_192, 16_384
#: Centroids at most, and nodes for each.
CENTROIDS, NODES_A_CENTROID = 4_096, 16
#: Nodes that the centroids are fitted on (the bound of the sample), and rounds of k-means.
SAMPLE, ROUNDS = 32_768, 4
#: Cells that a node is searched in.
PROBES = 3
#: Length of the beam of a search; in a dense cell it has to be longer than when the graph is built.
SEARCH_BEAM = 80
#: Searches of one task.
QUERIES = 65_536
#: Nodes of a block of a cluster in the exact step.
BLOCK_ROWS = 1_024
#: More than the error of a cosine in single precision.
DOUBT = 1e-5


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of m divided by their lengths, in double precision, without overflow or underflow."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(row, matrix, copy): rows whose vector has dim finite numbers, not all zero; copy is equal for equal directions."""
    ok = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ok).select(F.col(key).alias("row"), F.col(vector).cast("array<float>").alias("matrix"))

    @F.pandas_udf("string")
    def direction(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            rounded = (np.round(unit(np.stack(b.to_numpy())) * 1e6)).astype(np.int32) if len(b) else []
            yield pd.Series([hashlib.md5(r.tobytes()).hexdigest() for r in rounded], dtype=object)

    return rows.withColumn("copy", direction("matrix"))


def nodes_of(rows: DataFrame, members: int) -> DataFrame:
    """(copy, rep, members, matrix): one node per direction with its smallest rows (at most `members`)."""
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("copy").orderBy("row"))).where(F.col("r") <= members)
    return first.groupBy("copy").agg(F.min("row").alias("rep"), F.array_sort(F.collect_list("row")).alias("members"), F.min_by("matrix", "row").alias("matrix"))


def k_means(x: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, weight of each): at most k unit vectors by spherical k-means on the unit vectors x; empty ones are dropped."""
    centroids = x[np.random.default_rng(11).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        home = homes(x, centroids)
        sums = np.stack([np.bincount(home, x[:, j] * weight, len(centroids)) for j in range(x.shape[1])], axis=1)
        size, held = np.linalg.norm(sums, axis=1), np.bincount(home, weight, len(centroids))
        centroids, held = (sums[size > 0] / size[size > 0, None]).astype(np.float32), held[size > 0]
    return centroids, held


def homes(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row of x."""
    return np.concatenate([(x[i : i + 2048] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 2048)])


def fit_cells(sample: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, first centroid of each cell) for n nodes, of which the rows of sample are some.

    There are many centroids, so that even a small group of similar nodes has its own; a cell is a group of near centroids
    that stand for at most CELL nodes, found by halving.
    """
    k = min(CENTROIDS, n // NODES_A_CENTROID)
    if k < 2:
        return np.eye(1, sample.shape[1], dtype=np.float32), np.zeros(1, np.int64)
    centroids, held = k_means(sample, np.full(len(sample), n / len(sample)), k)
    cells, todo = [], [np.arange(len(centroids))]
    while todo:
        some = todo.pop()
        if held[some].sum() > CELL and len(some) > 1:
            halves = homes(centroids[some], k_means(centroids[some], held[some], 2)[0])
            if 0 < halves.sum() < len(some):
                todo += [some[halves == 0], some[halves == 1]]
                continue
        cells.append(some)
    return centroids[np.concatenate(cells)], np.concatenate([[0], np.cumsum([len(c) for c in cells])[:-1]])


class Cells:
    """The nodes (rep, matrix) by cells and shards, and their meetings with the shards of near cells.

    placed: (rep, matrix, cell, probes, shard) of each node, probes naming all cells, nearest first; cells (cell, first, parts)
    tells which shards a cell has.  It has at most CENTROIDS rows, so it may be broadcast.
    """

    def __init__(self, nodes: DataFrame, dim: int, probes: int):
        self.dim, n = dim, nodes.count()
        sample = nodes.orderBy(F.xxhash64("rep", F.lit(7)), "rep").limit(SAMPLE).select("matrix").toPandas() if n > CELL else None
        vectors = unit(np.stack(sample.matrix.to_numpy())).astype(np.float32) if n > CELL else np.zeros((0, dim), np.float32)
        centroids, starts = fit_cells(vectors, n if n > CELL else 0)
        self.n_cells = len(starts)

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 2048):
                    part = b.iloc[at : at + 2048]
                    near = np.maximum.reduceat(unit(np.stack(part.matrix.to_numpy())).astype(np.float32) @ centroids.T, starts, axis=1)
                    order = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    yield part.assign(cell=order[:, 0], probes=list(order))

        at_home = materialize(nodes.select("rep", "matrix").mapInPandas(home, "rep bigint, matrix array<float>, cell int, probes array<int>"), "cells")
        first, shapes = 0, []
        for r in at_home.groupBy("cell").count().orderBy("cell").collect():
            parts = -(-r["count"] // SHARD)
            shapes.append((r["cell"], first, parts))
            first += parts
        self.shards = max(1, first)
        self.cells = nodes.sparkSession.createDataFrame(shapes, "cell int, first int, parts int")
        self.placed = at_home.join(F.broadcast(self.cells), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")).drop("first", "parts")

    def packed(self, rows: DataFrame, make: Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]], names: Sequence[str]) -> DataFrame:
        """One row for each shard of rows(rep, matrix, shard, ...): the arrays that make gives for its rows and vectors."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [b for b in batches if len(b)]  # the rows of one shard
            if parts:
                pdf = pd.concat(parts).sort_values("rep")
                arrays = make(pdf, np.stack(pdf.matrix.to_numpy()).astype(np.float32))
                yield pd.DataFrame([[int(pdf.shard.iloc[0]), *(arrays[n].tobytes() for n in names)]], columns=["shard", *names])

        schema = ", ".join(["shard int", *(f"{n} binary" for n in names)])
        return materialize(rows.repartitionById(self.shards, F.col("shard")).mapInPandas(run, schema), "shards")

    def meet(self, index: DataFrame, asked: DataFrame, probes: Column, answer: Callable[[pd.Series, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """What answer(row of index, blocks of asked nodes) gives for each shard and the nodes that ask in one of its cells.

        index has one row for each shard (packed); asked has (rep, matrix, ...) and the array probes of cells.  Each task holds
        one row of the index and at most about QUERIES nodes.
        """
        more = [c for c in asked.columns if c not in ("cell", "probes", "shard")]
        sent = asked.select(*more, F.explode(probes).alias("cell")).join(F.broadcast(self.cells), "cell")
        sent = sent.select(*more, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard"))
        shapes, first = [], 0
        for r in sent.groupBy("shard").count().orderBy("shard").collect():  # one row for each shard
            shapes.append((r["shard"], first, -(-r["count"] // QUERIES)))
            first += shapes[-1][2]
        tasks = asked.sparkSession.createDataFrame(shapes, "shard int, first int, parts int")
        kinds, arrays = dict(sent.dtypes), [c for c in index.columns if c != "shard"]
        left = index.join(tasks, "shard").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("task"), F.lit(False).alias("query"), *[F.lit(None).cast(kinds[c]).alias(c) for c in more], *arrays)
        right = sent.join(tasks, "shard").select((F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int").alias("task"), F.lit(True).alias("query"), *more, *[F.lit(None).cast("binary").alias(c) for c in arrays])
        both = left.unionByName(right).repartitionById(max(1, first), F.col("task")).sortWithinPartitions("query")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            batches = (b for b in batches if len(b))
            b = next(batches, None)
            if b is None or b["query"].iloc[0]:  # no node of the index is in this shard
                return
            rest = itertools.chain([b.iloc[1:]], batches)  # the row of the index comes first
            yield from answer(b.iloc[0], (r.iloc[at : at + graph.BLOCK] for r in rest for at in range(0, len(r), graph.BLOCK)))

        return both.mapInPandas(run, schema)

    def links(self, near: int, far: int, least: float, full: int) -> DataFrame:
        """(rep, other, cosine): for each node the nodes of cosine >= least in its PROBES nearest cells, by matrix products.

        Of a shard that has more than `full` of them only the `near` nearest and `far` far ones are given.  Cosines are
        exact (double precision), rounded to 6 digits.
        """
        dim = self.dim
        index = self.packed(self.placed.select("rep", "matrix", "shard"), lambda pdf, m: {"ids": pdf.rep.to_numpy(np.int64), "vectors": m}, ["ids", "vectors"])

        def answer(x: pd.Series, blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, exact = np.frombuffer(x.ids, np.int64), unit(np.frombuffer(x.vectors, np.float32).reshape(-1, dim))
            single = exact.astype(np.float32)
            for part in blocks:
                mine, q = part.rep.to_numpy(np.int64), unit(np.stack(part.matrix.to_numpy()))
                cos = q.astype(np.float32) @ single.T
                cos[mine[:, None] == ids[None, :]] = -2
                hit = cos >= least - DOUBT
                many = hit.sum(axis=1) > full
                r, c = np.nonzero(hit & ~many[:, None])
                busy = np.flatnonzero(many)
                if len(busy):
                    some = cos[busy]
                    top = np.argpartition(-some, near - 1, axis=1)[:, :near]
                    low = np.argpartition(np.where(hit[busy], some, 3), far - 1, axis=1)[:, :far]
                    r = np.concatenate([r, np.repeat(busy, near + far)])
                    c = np.concatenate([c, np.concatenate([top, low], axis=1).ravel()])
                near_by = np.round(np.einsum("ij,ij->i", q[r], exact[c]), 6)
                good = near_by >= least
                yield pd.DataFrame({"rep": mine[r[good]], "other": ids[c[good]], "cosine": near_by[good]})

        return self.meet(index, self.placed, F.slice("probes", 1, PROBES), answer, "rep bigint, other bigint, cosine double")

    def bridges(self, labelled: DataFrame, probes: int, least: float) -> DataFrame:
        """(u, v), u < v: roots of labelled (rows of placed with a root) that a pair of cosine >= least joins, by matrix products in the `probes` nearest cells."""
        dim = self.dim
        index = self.packed(labelled.select("rep", "matrix", "shard", "root"), lambda pdf, m: {"roots": pdf.root.to_numpy(np.int64), "vectors": m}, ["roots", "vectors"])

        def answer(x: pd.Series, blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            roots, exact = np.frombuffer(x.roots, np.int64), unit(np.frombuffer(x.vectors, np.float32).reshape(-1, dim))
            single = exact.astype(np.float32)
            for part in blocks:
                mine, q = part.root.to_numpy(np.int64), unit(np.stack(part.matrix.to_numpy()))
                r, c = np.nonzero((q.astype(np.float32) @ single.T >= least - DOUBT) & (mine[:, None] != roots[None, :]))
                good = np.round(np.einsum("ij,ij->i", q[r], exact[c]), 6) >= least
                u, v = mine[r[good]], roots[c[good]]
                yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()

        return self.meet(index, labelled, F.slice("probes", 1, probes), answer, "u bigint, v bigint").distinct()


class Index(Cells):
    """Graphs over the nodes of each shard, and searches in them."""

    def __init__(self, nodes: DataFrame, dim: int):
        super().__init__(nodes, dim, PROBES)

        def build(pdf: pd.DataFrame, m: np.ndarray) -> dict[str, np.ndarray]:
            links, entries = graph.build(unit(m).astype(np.float32))
            return {"ids": pdf.rep.to_numpy(np.int64), "vectors": m, "links": links, "entries": entries}

        self.graphs = self.packed(self.placed.select("rep", "matrix", "shard"), build, ["ids", "vectors", "links", "entries"])

    def search(self, near: int, least: float, beam: int) -> DataFrame:
        """(rep, other, cosine): for each node and shard of its PROBES nearest cells the `near` nearest of the beam, of cosine >= least.

        Cosines are exact (double precision), rounded to 6 digits.
        """
        dim = self.dim

        def answer(x: pd.Series, blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, exact = np.frombuffer(x.ids, np.int64), unit(np.frombuffer(x.vectors, np.float32).reshape(-1, dim))
            built = exact.astype(np.float32), np.frombuffer(x.links, np.int32).reshape(len(ids), -1), np.frombuffer(x.entries, np.int32)
            for part in blocks:
                mine, q = part.rep.to_numpy(np.int64), unit(np.stack(part.matrix.to_numpy()))
                found, _ = graph.beam_search(q.astype(np.float32), *built, beam)
                other = ids[np.maximum(found, 0)]
                cos = np.round(np.einsum("nj,nkj->nk", q, exact[np.maximum(found, 0)]), 6)
                cos[(found < 0) | (other == mine[:, None]) | (cos < least)] = -2
                order = np.lexsort((other, -cos), axis=1)[:, :near]
                cos, other = np.take_along_axis(cos, order, 1), np.take_along_axis(other, order, 1)
                r, c = np.nonzero(cos > -2)
                yield pd.DataFrame({"rep": mine[r], "other": other[r, c], "cosine": cos[r, c]})

        return self.meet(self.graphs, self.placed, F.slice("probes", 1, PROBES), answer, "rep bigint, other bigint, cosine double")


def cluster_bridges(nodes: DataFrame, shards: int, dim: int, least: float, many: int) -> DataFrame:
    """(u, v), u < v: roots of nodes(rep, root, matrix, shard), one of them with more than `many` nodes, between which any two nodes have a cosine >= least.

    Exact.  The nodes of large roots are packed in blocks with a centre and a radius; a node can be similar to one of a block
    only if its angle to the centre is at most the radius plus that of `least` (triangle inequality).  Nodes that pass
    meet the block in a matrix product; what single precision leaves in doubt is computed in double precision.
    """
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select("root", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf.matrix.to_numpy()).astype(np.float32)
        u = unit(m)
        centre = u.sum(axis=0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-9 else u[0]
        radius = float(np.arccos(np.clip((u @ centre).min(), -1, 1)))
        return pd.DataFrame([[pdf.root.iloc[0], int(pdf.part.iloc[0]), centre, radius, m.tobytes()]], columns=["root", "part", "centre", "radius", "vectors"])

    large = nodes.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    blocks = large.select("root", "part", "matrix").groupBy("root", "part").applyInPandas(pack, "root bigint, part int, centre array<double>, radius double, vectors binary")
    blocks = materialize(blocks.withColumn("block", F.xxhash64("root", "part")), "blocks")
    chunks = -(-blocks.count() // BLOCK_ROWS)
    if not chunks:
        return nodes.select(F.col("root").alias("u"), F.col("root").alias("v")).where("false")
    bounds = blocks.groupBy(F.pmod("block", F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("block", "root", "centre", "radius")).alias("bounds"))

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]  # the rows of one shard
        if parts:
            pdf = pd.concat(parts)
            m = np.stack(pdf.matrix.to_numpy()).astype(np.float32)
            yield pd.DataFrame([[pdf.root.to_numpy(np.int64).tobytes(), m.tobytes()]], columns=["roots", "vectors"])

    packed = nodes.select("root", "matrix", "shard").repartitionById(shards, F.col("shard")).mapInPandas(shard, "roots binary, vectors binary")
    met = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(bounds, "chunk")
    angle = float(np.arccos(least))

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                roots, m = np.frombuffer(row.roots, np.int64), np.frombuffer(row.vectors, np.float32).reshape(-1, dim)
                centres = np.array([x["centre"] for x in row.bounds])
                theirs = np.array([x["root"] for x in row.bounds])
                reach = np.cos(np.minimum(np.pi, np.array([x["radius"] for x in row.bounds]) + angle)) - DOUBT
                near = (unit(m) @ centres.T >= reach[None, :]) & (roots[:, None] != theirs[None, :])
                for k in np.flatnonzero(near.any(axis=0)):
                    at = near[:, k]
                    yield pd.DataFrame([[row.bounds[k]["block"], roots[at].tobytes(), m[at].tobytes()]], columns=["block", "roots", "near"])

    left = met.mapInPandas(passing, "block bigint, roots binary, near binary")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                x, q = (unit(np.frombuffer(v, np.float32).reshape(-1, dim)) for v in (row.vectors, row.near))
                roots, found = np.frombuffer(row.roots, np.int64), set()
                for at in range(0, len(q), graph.BLOCK):
                    cos = (q[at : at + graph.BLOCK].astype(np.float32) @ x.astype(np.float32).T).max(axis=1)
                    for i in np.flatnonzero(cos >= least - DOUBT) + at:
                        if roots[i] not in found and (cos[i - at] >= least + DOUBT or (np.round(x @ q[i], 6) >= least).any()):
                            found.add(roots[i])
                yield pd.DataFrame({"u": [min(r, row.root) for r in found], "v": [max(r, row.root) for r in found]}, dtype=np.int64)

    return left.join(blocks.select("block", "root", "vectors"), "block").mapInPandas(compare, "u bigint, v bigint").distinct()


def nearest_rows(df: DataFrame, key: str, vector: str, dim: int, k: int, least: float) -> DataFrame:
    """(row, other, cosine): the k nearest rows of every usable row, of cosine >= least; ties go to the smaller row.

    Null, short and long vectors, null or non-finite elements and zero vectors are not usable and give no rows.
    """
    rows = materialize(usable_vectors(df, key, vector, dim), "vectors")
    nodes = materialize(nodes_of(rows, k + 1), "nodes")
    index = Index(nodes, dim)
    found = materialize(index.search(near=k, least=least, beam=SEARCH_BEAM), "found")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k)
    others = best.join(nodes.select(F.col("rep").alias("other"), F.slice("members", 1, k).alias("rows")), "other")
    others = others.select("rep", (-F.col("cosine")).alias("d"), F.explode("rows").alias("row"))
    own = nodes.select("rep", F.lit(-1.0).alias("d"), F.explode("members").alias("row"))
    lists = own.unionByName(others).select("rep", F.struct("d", "row").alias("n")).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("n")), 1, 2 * k + 1).alias("list"))  # at most k + 1 + k * k entries
    of_copy = nodes.select("copy", "rep").join(lists, "rep").select("copy", "list")
    mine = rows.select("row", "copy").join(of_copy, "copy").select("row", F.slice(F.filter("list", lambda n: n["row"] != F.col("row")), 1, k).alias("list"))
    return mine.select("row", F.explode("list").alias("n")).select("row", F.col("n.row").alias("other"), (-F.col("n.d")).alias("cosine"))
