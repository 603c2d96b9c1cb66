"""Queries of the operators on training data, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histrank.llm import clusters, encoding, overlap, packing, pairs, tokens, topn, vectors
from histrank.operators.packed import IDS, packed_values
from histrank.session import table


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items of candidate_samples with counts, lift and conviction."""
    found = pairs.item_pairs(table(spark, d, "candidate_samples"), "sample_id", "history_item_id", min_support=8, min_lift=4.0)
    return found.withColumns({c: F.round(c, 6) for c in ("lift", "conviction")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that at least 8 samples hold and that are together at least 4 times as often as expected."""
    return p2_pairs(spark, d).select("item_a", "item_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of item_vectors of which one is among the five nearest of the other."""
    found = vectors.nearest_rows(table(spark, d, "item_vectors"), "row_index", "matrix", dim=64, k=5, least=0.8)
    return found.select(F.least("row", "other").alias("row_index_a"), F.greatest("row", "other").alias("row_index_b")).distinct()


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_clusters(table(spark, d, "item_vectors"), "row_index", "matrix", dim=64, least=0.8, min_rows=4)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of item_vectors in clusters of at least four, with the smallest row of the cluster."""
    return _clusters(spark, d).select(F.col("first").alias("cluster_first"), F.col("row").alias("row_index"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with their size and their three most typical rows, by flow."""
    rows = _clusters(spark, d)
    typical = rows.withColumn("r", F.row_number().over(Window.partitionBy("first").orderBy(F.desc("flow"), "row"))).where("r <= 3")
    return typical.groupBy(F.col("first").alias("cluster_first")).agg(
        F.first("n_rows").alias("n_rows"), F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("typical_rows")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The best five items of each sample."""
    rows = table(spark, d, "candidates").where("sample_id IS NOT NULL AND candidate_rank BETWEEN 1 AND 999998")
    score = F.when(~F.isnan("fusion_score"), F.col("fusion_score"))
    best = F.min(F.struct(F.col("candidate_rank").alias("rank"), score.isNull().alias("none"), (-score).alias("low")))
    rows = rows.where("item_id IS NOT NULL").groupBy("sample_id", "item_id").agg(best.alias("b"))
    rows = rows.select("sample_id", "item_id", F.col("b.rank").alias("rank"), (-F.col("b.low")).alias("score"))
    code = [*topn.long_words(F.col("rank")), *topn.descending_words(F.col("score")), *topn.long_words(F.col("item_id"))]
    return topn.top_n(rows, "sample_id", 5, code, ["item_id"])


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "samples").select("sample_id", "split", "source", "target_item_id", "history_item_id").distinct()
    items = F.transform(packed_values(F.col("history_item_id"), IDS), lambda v: v["item_value"])
    return rows.select(F.col("sample_id").alias("id"), overlap.side_of(F.col("split")).alias("side"), "split", "source", F.col("target_item_id").alias("target"), items.alias("items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one training and one evaluation sample with the same target and nearly the same history."""
    found = overlap.cross_split_pairs(_records(spark, d), similarity=0.6, min_items=4)
    return found.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b")).distinct()


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation sample and source of training samples: the largest coverage and the training samples that overlap."""
    found = overlap.record_coverage(_records(spark, d), similarity=0.6, min_items=4)
    return found.select(F.col("id").alias("sample_id"), "split", "source", "train_source", F.round("coverage", 6).alias("coverage"), "n_train")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split, source and source of training samples: samples, those that overlap, mean and largest coverage.

    A row whose train_source is null and n_overlapping 0 stands for a split and source without any overlap.
    """
    records = _records(spark, d)
    covered = overlap.record_coverage(records, similarity=0.6, min_items=4)
    name = F.lower(F.trim("split")).alias("split")
    sizes = records.where("side = 'eval'").groupBy(name, "source").agg(F.countDistinct("id").alias("n_samples"))
    parts = covered.groupBy(name, "source", "train_source").agg(F.countDistinct("id").alias("n_overlapping"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.round(F.max("coverage"), 6).alias("max_coverage"))
    met = (F.col("a.split") == F.col("b.split")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    return sizes.alias("a").join(parts.alias("b"), met, "left").select("a.split", "a.source", "b.train_source", "a.n_samples", F.coalesce("b.n_overlapping", F.lit(0)).alias("n_overlapping"), "b.mean_coverage", "b.max_coverage")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text as ids of byte_bpe_50k."""
    return tokens.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text of documents, sized in ids of byte_bpe_50k, in a container of 2,048."""
    sizes = tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, pieces, tokens, the share of space that is filled, and the least number of containers there could be."""
    rows = p9_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * 2048), 6).alias("filled"), F.ceil(F.sum("used") / 2048).alias("least_containers"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least one passage that was decoded in another charset than it was written in."""
    return encoding.find_garbled(table(spark, d, "documents"), "doc_id", "text", "lang", page="raw_bytes", restore=False).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same documents with the chains undone and the restored text."""
    return encoding.find_garbled(table(spark, d, "documents"), "doc_id", "text", "lang", page="raw_bytes")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p4_found": p4_found, "p4_clusters": p4_clusters, "p5_found": p5_found, "p6_found": p6_found, "p6_records": p6_records, "p6_report": p6_report, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_report": p9_report, "p10_found": p10_found, "p10_restored": p10_restored}

_P2 = """
WITH s AS (SELECT DISTINCT sample_id AS b, i FROM (SELECT sample_id, unnest(history_item_id) AS i FROM candidate_samples) WHERE i IS NOT NULL AND sample_id IS NOT NULL),
n AS (SELECT count(DISTINCT b) AS n FROM s), c AS (SELECT i, count(*) AS n FROM s GROUP BY i HAVING count(*) >= 8),
p AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n_ab FROM s x JOIN s y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 8)
SELECT {columns} FROM p JOIN c a ON a.i = item_a JOIN c b ON b.i = item_b, n WHERE n_ab::DOUBLE * n.n >= 4.0 * a.n * b.n"""

ORACLE = {
    "p2_found": _P2.format(columns="item_a, item_b"),
    "p2_pairs": _P2.format(
        columns="""item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, n.n AS n, round(n_ab::DOUBLE * n.n / (a.n::DOUBLE * b.n), 6) AS lift,
 round(CASE WHEN n_ab < a.n THEN (1 - b.n::DOUBLE / n.n) / (1 - n_ab::DOUBLE / a.n) END, 6) AS conviction"""
    ),
    "p5_found": """
SELECT sample_id, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY candidate_rank, s DESC NULLS LAST, item_id) AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id, item_id ORDER BY candidate_rank, s DESC NULLS LAST) AS q
    FROM (SELECT *, CASE WHEN NOT isnan(fusion_score) THEN fusion_score END AS s FROM candidates)
    WHERE sample_id IS NOT NULL AND item_id IS NOT NULL AND candidate_rank >= 1 AND candidate_rank < 999999)
  WHERE q = 1) WHERE r <= 5""",
}
