"""Clusters of mutually similar vectors by Markov clustering on a sparse similarity graph.

The graph has, for every node (histrank.llm.vectors), the similar nodes of the nearest cells, found by matrix products.  Its column-stochastic
matrix is squared (a sparse distributed product: join and sum), inflated (entries squared) and pruned (small entries
dropped, at most ENTRIES kept in a column) until attractors and flow settle; the strongest row of a column is its
attractor, and nodes with one attractor are a cluster.  The flow into a node (its row sum) tells how typical it is.

A cluster is to hold whatever steps of the wanted similarity lead to, while Markov clustering cuts such chains where
the flow is thin.  So the links are contracted to links between attractors, and clusters with a link between them are
united.  Two checks follow for links that the graph hasn't: large clusters (whose nodes give some of their links only) are
compared with all nodes exactly, in blocks with a centre and a radius, and small clusters and loners (whose nodes give all
links) are compared in more and more cells until no new link joins two clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histrank.llm import vectors
from histrank.session import materialize

#: Links of each node that the matrix begins with, entries of a column that pruning keeps, and the least entry.
LINKS, ENTRIES, LEAST = 8, 12, 1e-3
#: Nodes that a small cluster has at most; a node with more links in a shard gives LINKS of them only.
LARGE = 40
#: Cells that small clusters and loners are compared in at most.
WIDEST = 48
#: Power of the inflation, and the mean change of the columns' strongest entries below which they have settled.
INFLATION, SETTLED = 2.0, 1e-4


def _columns(m: DataFrame, power: float) -> DataFrame:
    """Entries (col, row, v) raised to the power, pruned and made to sum to 1 in each column."""
    best = m.withColumn("n", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("v"), "row"))).where((F.col("n") <= ENTRIES) & (F.col("v") >= LEAST))
    raised = best.select("col", "row", F.pow("v", F.lit(power)).alias("v"))
    return raised.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("col")))


def markov_clusters(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, flow) of links (rep, other, cosine): members (rep, attractor), flow (rep, flow).

    Links count in both directions; a node is linked to itself with weight 1.
    """
    both = links.select(F.col("rep").alias("col"), F.col("other").alias("row"), "cosine").unionByName(links.select(F.col("other").alias("col"), F.col("rep").alias("row"), "cosine")).distinct()
    near = both.withColumn("n", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("cosine"), "row"))).where(F.col("n") <= LINKS).select("col", "row", F.col("cosine").alias("v"))
    loops = both.select("col").distinct().select("col", F.col("col").alias("row"), F.lit(1.0).alias("v"))
    m = materialize(_columns(near.unionByName(loops), 1.0), "matrix")
    strongest = lambda x: x.groupBy("col").agg(F.min_by("row", F.struct(-F.col("v"), "row")).alias("attractor"), F.max("v").alias("v"))
    summary = F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("col", "attractor")), F.lit(0)).alias("who"), F.coalesce(F.avg("v"), F.lit(1.0)).alias("mean")
    before = strongest(m).agg(*summary).first()
    while before["n"]:
        left = m.select(F.col("col").alias("k"), F.col("row"), F.col("v").alias("a"))
        right = m.select("col", F.col("row").alias("k"), F.col("v").alias("b"))
        square = left.join(right, "k").groupBy("col", "row").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
        m = materialize(_columns(square, INFLATION), "matrix")
        now = strongest(m).agg(*summary).first()
        if now["who"] == before["who"] and abs(now["mean"] - before["mean"]) < SETTLED:
            break
        before = now
    return strongest(m).select(F.col("col").alias("rep"), "attractor"), m.groupBy(F.col("row").alias("rep")).agg(F.sum("v").alias("flow"))


def united(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the undirected edges (u, v) the smallest node that steps lead to.

    Each round hangs every node on its smallest neighbour, follows the parents to their roots, and contracts
    the edges; edges within a root drop out, so the rounds grow with the logarithm of the longest path.
    """
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = materialize(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "parents")
        while True:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            up = materialize(up.join(above, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parents")
            if up.where("moved").isEmpty():
                break
            up = up.select("u", "p")
        up = up.select("u", "p")
        if roots is None:
            roots = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = roots.join(up.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        roots = materialize(roots, "roots")
        moved = edges.join(up.select("u", F.col("p").alias("a")), "u").join(up.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").where("a <> b")
        edges = materialize(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v), u < v: labels between which there are links (rep, other); labels(rep, root)."""
    ends = links.select("rep", "other").join(labels.select("rep", F.col("root").alias("a")), "rep").join(labels.select(F.col("rep").alias("other"), F.col("root").alias("b")), "other")
    return ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def merged(labels: DataFrame, bridges: DataFrame) -> DataFrame:
    """labels(rep, root) after uniting the roots that bridges (u, v) join."""
    roots = united(bridges).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return materialize(labels.join(roots, "root", "left").select("rep", F.coalesce("new", "root").alias("root")), "labels")


def similarity_clusters(df: DataFrame, key: str, vector: str, dim: int, least: float, min_rows: int) -> DataFrame:
    """(row, first, n_rows, flow): every usable row in a cluster of at least min_rows rows.

    first is the smallest row of the cluster; flow is what flows into the row's node, greatest for the most typical.
    Copies are rows of one node.  Rows without a similar row are in no cluster.
    """
    rows = materialize(vectors.usable_vectors(df, key, vector, dim), "vectors")
    nodes = materialize(vectors.nodes_of(rows, 1), "nodes")
    cells = vectors.Cells(nodes, dim, probes=WIDEST)
    links = materialize(cells.links(near=LINKS - 2, far=2, least=least, full=LARGE), "links")
    members, flow = markov_clusters(links)
    labels = materialize(nodes.select("rep").join(members, "rep", "left").select("rep", F.coalesce("attractor", "rep").alias("root")), "labels")
    labels = merged(labels, contracted(links, labels))
    placed = cells.placed.join(labels, "rep")
    bridges = materialize(vectors.cluster_bridges(placed.select("rep", "root", "matrix", "shard"), cells.shards, dim, least, many=LARGE), "bridges")
    if not bridges.isEmpty():
        labels = merged(labels, bridges)
    probes = vectors.PROBES
    while probes < min(cells.n_cells, WIDEST):  # small clusters and loners: more cells
        probes *= 2
        small = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= LARGE).select("root")
        bridges = materialize(cells.bridges(cells.placed.join(labels.join(small, "root", "left_semi"), "rep"), probes, least), "bridges")
        if bridges.isEmpty():
            break
        labels = merged(labels, bridges)
    root = nodes.select("copy", "rep").join(labels, "rep").join(flow, "rep", "left").select("copy", "root", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    labelled = materialize(rows.select("row", "copy").join(root, "copy").select("row", "root", "flow"), "labelled")
    sizes = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row").alias("first")).where(F.col("n_rows") >= min_rows)
    return labelled.join(sizes, "root").select("row", "first", "n_rows", "flow")
