"""Queries of one problem agree with each other on sf0.01."""

from pyspark.sql import functions as F

from histrank.llm import clusters, overlap, queries, tokens, vectors
from histrank.session import materialize
from tests.conftest import rows

SF = "/root/testdata/sf0.01"


def test_clusters_have_the_sizes_of_their_rows(spark):
    found = queries.p4_found(spark, SF).groupBy("cluster_first").agg(F.count(F.lit(1)).alias("n"), F.collect_set("row_index").alias("rows"))
    both = found.join(queries.p4_clusters(spark, SF), "cluster_first", "full").collect()
    assert both and all(r["n"] == r["n_rows"] >= 4 and set(r["typical_rows"]) <= set(r["rows"]) and len(r["typical_rows"]) == 3 for r in both)


def test_attractors_leave_little_to_unite(spark):
    """Links are contracted to links between attractors: most of them lie within a cluster and drop out."""
    usable = vectors.usable_vectors(spark.read.parquet(f"{SF}/item_vectors.parquet"), "row_index", "matrix", 64)
    nodes = materialize(vectors.nodes_of(usable, 1), "nodes")
    links = materialize(vectors.Cells(nodes, 64, probes=clusters.WIDEST).links(near=6, far=2, least=0.8, full=40), "links")
    members, flow = clusters.markov_clusters(links)
    labels = materialize(members.select("rep", F.col("attractor").alias("root")), "labels")
    n_links, n_bridges = links.count(), clusters.contracted(links, labels).count()
    assert labels.select("root").distinct().count() < labels.count() / 2 and n_bridges < n_links / 10
    n = labels.count()
    assert abs(flow.agg(F.sum("flow")).first()[0] - n) < 1e-6 * n  # columns sum to one
    groups = rows(clusters.merged(labels, clusters.contracted(links, labels)).groupBy("root").count())
    whole = rows(clusters.united(links.select(F.col("rep").alias("u"), F.col("other").alias("v"))).groupBy("root").count())
    assert sorted(n for _, n in groups) == sorted(n for _, n in whole)


def test_bridges_of_large_clusters_are_exact(spark):
    """Every pair of roots with a similar pair of nodes is found by centres, radii and products, as by brute force."""
    import numpy as np

    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 64))
    centre[1] = centre[0] + 0.55 * rng.normal(size=64)
    m = np.concatenate([c + 0.3 * rng.normal(size=(60, 64)) for c in centre] + [rng.normal(size=(40, 64))]).astype(np.float32)
    root = np.concatenate([np.repeat(np.arange(6), 60), np.arange(100, 140)])
    u = vectors.unit(m)
    cos = np.round(u @ u.T, 6)
    want = {(int(min(root[i], root[j])), int(max(root[i], root[j]))) for i, j in zip(*np.nonzero(cos >= 0.8)) if root[i] != root[j] and min(root[i], root[j]) < 6}
    df = spark.createDataFrame([(i, int(r), v.tolist(), i % 3) for i, (r, v) in enumerate(zip(root, m))], "rep bigint, root bigint, matrix array<float>, shard int")
    got = {(r["u"], r["v"]) for r in vectors.cluster_bridges(df, 3, 64, 0.8, many=40).collect()}
    assert got == want and (0, 1) in want


def test_overlapping_records_are_those_of_the_pairs(spark):
    pairs = queries.p6_found(spark, SF).collect()
    evaluation = {r["id"] for r in queries._records(spark, SF).where("side = 'eval'").select("id").distinct().collect()}
    ids = {x for p in pairs for x in p if x in evaluation}
    records = queries.p6_records(spark, SF).collect()
    assert {r["sample_id"] for r in records} == ids and all(0.6 <= r["coverage"] <= 1 and r["n_train"] >= 1 for r in records)
    report = queries.p6_report(spark, SF).collect()
    assert all(r["n_overlapping"] <= r["n_samples"] for r in report) and overlap.SHORT == 4


def test_containers_hold_every_token_once(spark):
    out = materialize(queries.p9_containers(spark, SF), "containers")
    full = out.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("end"), F.countDistinct("container_offset").alias("spans"), F.count(F.lit(1)).alias("n"))
    assert full.where("used > 2048 OR used <> end OR spans <> n").isEmpty()
    sizes = tokens.count_tokens(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").where("n_tokens > 0")
    assert out.groupBy("doc_id").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens")).exceptAll(sizes).isEmpty() and out.select("doc_id").distinct().count() == sizes.count()
    r = queries.p9_report(spark, SF).first()
    assert r["n_containers"] <= r["least_containers"] + 2
