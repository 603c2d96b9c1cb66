"""Sources and sinks: each query writes a table in a format, reads it with the source, and returns what it read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histrank.operators.sequences import row_range_shards
from histrank.plans.base import Plans
from histrank.session import shared_dir, table
from histrank.sources import files as S
from histrank.sources import views as V

P = Plans()


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


@P.add("SELECT item_id, title FROM items WHERE item_id IS NOT NULL")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with broken, blank and incomplete lines between them."""
    path = _path(spark, "rows.jsonl")
    lines = table(spark, d, "items").select(F.to_json(F.struct("item_id", "title")).alias("value"))
    noise = spark.createDataFrame([("{broken",), ("",), ('{"title": "no id"}',)], "value string")
    lines.unionByName(noise).write.text(path)
    return S.read_jsonl(spark, S.first_that_exists(spark, [path + ".missing", path]), "item_id bigint, title string", ["item_id"])


@P.add("SELECT item_id::VARCHAR AS key, item_sid AS value FROM items WHERE item_id IS NOT NULL")
def json_map_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "map.json")
    entries = F.collect_list(F.struct(F.col("item_id").cast("string"), F.col("item_sid")))
    S.json_chunks(table(spark, d, "items").where("item_id IS NOT NULL"), F.map_from_entries(entries)).write.text(path)
    return S.read_json_map(spark, path, "string", lines=True)


@P.add("SELECT DISTINCT item_sid AS value FROM items WHERE item_sid IS NOT NULL")
def json_set_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "set.json")
    S.json_chunks(table(spark, d, "items"), F.collect_list("item_sid")).write.text(path)
    return S.read_json_set(spark, path, lines=True)


@P.add("SELECT item_id, asin, title FROM items WHERE title IS NOT NULL AND title <> ''")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "items")
    S.write_once(table(spark, d, "items").where("title <> ''").select("item_id", "asin", "title"), path, "csv", header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    return S.read_csv(spark, path, "item_id bigint, asin string, title string", ["item_id", "asin"])


@P.add("SELECT 0 AS n_rows, 1 AS n_reasons")
def optional_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    rows, reasons = S.read_optional_csv(spark, _path(spark, "absent"), "item_id bigint")
    return rows.agg(F.count(F.lit(1)).cast("int").alias("n_rows")).withColumn("n_reasons", F.lit(len(reasons)))


@P.add(f"WITH {V.HIST} SELECT user_id, list_transform(history, lambda x: x::VARCHAR) AS history, item_id::VARCHAR AS item_id FROM hist")
def inter_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "train")
    S.write_inter(V.hist(spark, d), path)
    return S.read_inter(spark, path)


@P.add("SELECT count(*) AS n, 2 AS malformed FROM (SELECT item_id FROM items UNION ALL SELECT 1 UNION ALL SELECT 2)")
def info_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "info.txt")
    lines = table(spark, d, "items").select(F.concat_ws("\t", F.coalesce("item_sid", F.lit("")), F.coalesce(F.translate("title", "\t\n\r", ""), F.lit("")), F.col("item_id").cast("string")).alias("value"))
    lines.unionByName(spark.createDataFrame([("<a_1>",), ("<a_1>\ttitle",)], "value string")).write.text(path)
    return S.read_info(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_if("malformed").cast("int").alias("malformed"))


@P.add("SELECT item_id, asin, count(*) AS n FROM items, (SELECT unnest([1, 2, 3])) GROUP BY 1, 2")
def dispatch_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as gzipped CSV, TSV and JSON lines, read by the endings of their paths."""
    rows, schema, parts = table(spark, d, "items").select("item_id", "asin"), "item_id bigint, asin string", []
    for kind, options in (("csv", {"header": "true"}), ("tsv", {"header": "true", "sep": "\t"}), ("jsonl", {})):
        path = _path(spark, f"rows.{kind}")
        rows.write.format("json" if kind == "jsonl" else "csv").options(compression="gzip", **options).save(path)
        parts.append(S.read_any(spark, path, schema))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("item_id", "asin").agg(F.count(F.lit(1)).alias("n"))


@P.add("SELECT row_index, list_transform(matrix, lambda x: CASE WHEN isnan(x) OR isinf(x) OR x IS NULL THEN 0.0::DOUBLE ELSE round(x::DOUBLE, 6) END) AS matrix FROM item_vectors")
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read_vectors(table(spark, d, "item_vectors"), "row_index", "matrix")
    return rows.select("row_index", F.transform("matrix", lambda x: F.round(x, 6)).alias("matrix"))


@P.add("SELECT item_type, u.metric, u.value FROM (SELECT item_type, unnest([{'metric': 'n', 'value': count(*)::DOUBLE}, {'metric': 'n_titles', 'value': count(title)::DOUBLE}]) AS u FROM items GROUP BY 1)")
def report_flattener(spark: SparkSession, d: str) -> DataFrame:
    return S.flatten_report(table(spark, d, "items").groupBy("item_type").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("n_titles")), ["item_type"])


@P.add(f"WITH {V.INTER} SELECT user_id, item_id, ts FROM inter")
def shard_merge(spark: SparkSession, d: str) -> DataFrame:
    """Shards written to directories of their own and read together."""
    path = _path(spark, "shards")
    row_range_shards(V.inter(spark, d), ["ts", "user_id", "item_id"], 4).select("user_id", "item_id", "ts", "shard").write.partitionBy("shard").parquet(path)
    return spark.read.schema("user_id string, item_id bigint, ts bigint, shard int").parquet(path).drop("shard")


@P.add("SELECT item_id, sha256(coalesce(item_id::VARCHAR, '') || '|' || coalesce(asin, '')) AS digest FROM items")
def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_id", S.row_hash("item_id", "asin").alias("digest"))


@P.add("SELECT count(*) AS n_rows, bit_xor(('0x' || substr(sha256(coalesce(item_id::VARCHAR, '') || '|' || coalesce(asin, '')), 1, 15))::BIGINT) AS digest FROM items")
def table_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.table_hash(table(spark, d, "items"), ["item_id", "asin"])


@P.add("SELECT 'v1' AS version, 'items' AS category, 'path' AS name, 'b' AS value UNION ALL SELECT 'v1', 'items', 'rows', (SELECT count(*) FROM items)::VARCHAR")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    path, schema = _path(spark, "manifest"), "version string, category string, name string, value string, stamp int"
    n = table(spark, d, "items").count()
    S.upsert_manifest(spark, path, spark.createDataFrame([("v1", "items", "path", "a", 1), ("v1", "items", "rows", str(n), 1)], schema))
    return S.upsert_manifest(spark, path, spark.createDataFrame([("v1", "items", "path", "b", 2)], schema))


@P.add("SELECT item_id, title FROM items")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").select(F.col("item_id").alias("Parent_ASIN"), F.col("title").alias("product_title"))
    return S.resolve_aliases(rows, {"item_id": ["asin", "parent_asin"], "title": ["product_title", "name"], "brand": ["store"]})


QUERIES, ORACLE = P.queries, P.oracle
