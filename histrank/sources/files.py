"""File sources and sinks: JSON lines, JSON maps and sets, CSV, TSV, vectors, manifests.

Schemas are given, never inferred.  Sinks refuse to overwrite unless told so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histrank.functions.vector import finite


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with each column that is known under an alias renamed; the first alias that is there wins, apart from case."""
    there = {c.lower(): c for c in reversed(df.columns)}
    found = {name: next((there[a.lower()] for a in (name, *others) if a.lower() in there), None) for name, others in aliases.items()}
    return df.select(*[F.col(f"`{old}`").alias(name) for name, old in found.items() if old is not None])


def first_that_exists(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of the paths that exists; an error if none does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """JSON lines; lines that don't parse, blank lines and rows without a required column drop out."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.dropna(how="all").dropna(subset=list(required)) if required else df.dropna(how="all")


def json_chunks(df: DataFrame, chunk: Column, size: int = 1000) -> DataFrame:
    """(value): the aggregate `chunk` of up to `size` rows of a partition at a time, as JSON."""
    part = F.floor(F.monotonically_increasing_id() / size)
    return df.withColumn("_chunk", part).groupBy("_chunk").agg(F.to_json(chunk).alias("value")).select("value")


def read_json_map(spark: SparkSession, path: str, value: str, lines: bool = False) -> DataFrame:
    """(key, value) of one JSON object that maps keys to values of the type `value`, or of one such object a line."""
    text = spark.read.text(path, wholetext=not lines)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_json_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(value): the different elements of a JSON list, or the keys of a JSON object, or of one such value a line."""
    text = spark.read.text(path, wholetext=not lines)
    values = F.coalesce(F.from_json("value", "array<string>"), F.map_keys(F.from_json("value", "map<string,string>")))
    return text.select(F.explode(values).alias("value")).where("value IS NOT NULL").distinct()


def read_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """A CSV file with a header; an error if a required column is missing in it."""
    header = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').csv(path).limit(1).first()
    names = [x for x in (header or []) if x is not None]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"columns missing in {path}: {missing}")
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).option("enforceSchema", False).csv(path)


def read_optional_csv(spark: SparkSession, path: str | None, schema: str) -> tuple[DataFrame, list[str]]:
    """(rows, reasons): no rows and a reason if the path is not given or not there."""
    try:
        if path is None:
            raise FileNotFoundError("no path is given")
        return read_csv(spark, first_that_exists(spark, [path]), schema), []
    except FileNotFoundError as e:
        return spark.createDataFrame([], schema), [str(e)]


def read_inter(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, history, item_id) of an atomic TSV file with a header; rows without exactly three fields drop out."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where((F.size("p") == 3) & ~F.get("p", F.lit(0)).contains(":token"))
    return parts.select(F.get("p", F.lit(0)).alias("user_id"), F.filter(F.split(F.get("p", F.lit(1)), " "), lambda x: x != "").alias("history"), F.get("p", F.lit(2)).alias("item_id"))


def write_inter(df: DataFrame, path: str) -> None:
    """(user_id, history, item_id) as an atomic TSV file."""
    line = F.concat_ws("\t", F.col("user_id").cast("string"), F.array_join(F.transform("history", lambda x: x.cast("string")), " "), F.col("item_id").cast("string"))
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """(sid, title, item_id, malformed) of a TSV file: a line with fewer than three fields is malformed and keeps its first field only."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return p.select(F.get("p", F.lit(0)).alias("sid"), F.get("p", F.lit(1)).alias("title"), F.get("p", F.lit(2)).alias("item_id"), (F.size("p") < 3).alias("malformed"))


def read_any(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """A file by its ending: .csv, .tsv, .jsonl or .json, each also with .gz; at most `most` rows where that is asked for."""
    kind = path.removesuffix(".gz").rsplit(".", 1)[-1]
    if kind in ("csv", "tsv"):
        df = read_csv(spark, path, schema, sep="\t" if kind == "tsv" else ",")
    elif kind in ("jsonl", "json"):
        df = read_jsonl(spark, path, schema)
    else:
        raise ValueError(f"unknown kind of file: {path}")
    return df if most is None else df.limit(most)


def read_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) in double precision with bad elements as 0."""
    return df.select(key, finite(F.col(vector)).alias(vector))


def write_once(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False, **options: str) -> None:
    """Write df; an error if the path exists, unless overwrite; paths that name a test split are refused."""
    if "test" in path.rsplit("/", 1)[-1].split("_"):
        raise ValueError(f"refusing to write to a test path: {path}")
    df.write.mode("overwrite" if overwrite else "errorifexists").options(**options).format(kind).save(path)


def row_hash(*columns: str) -> F.Column:
    """sha-256 of the columns as text, joined by |; null is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def table_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, digest): a digest of the rows that their order doesn't change."""
    head = F.conv(F.substring(row_hash(*columns), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(head).alias("digest"))


def upsert_manifest(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """Append (version, category, name, value, stamp) rows to a manifest and return the latest value of each key."""
    entries.write.mode("append").parquet(path)
    rows = spark.read.schema(entries.schema).parquet(path)
    return rows.groupBy("version", "category", "name").agg(F.max_by("value", "stamp").alias("value"))


def flatten_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., metric, value): a wide report in long form."""
    metrics = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot(list(keys), metrics, "metric", "value")


def flatten_nested(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., metric, value): the leaves of a nested report as texts; paths are joined by dots, lists and maps are JSON, null is empty."""

    def leaves(path: str, kind: T.DataType) -> list[tuple[str, T.DataType]]:
        if isinstance(kind, T.StructType):
            return [leaf for f in kind.fields for leaf in leaves(f"{path}.{f.name}", f.dataType)]
        return [(path, kind)]

    found = [leaf for f in df.schema.fields if f.name not in keys for leaf in leaves(f.name, f.dataType)]
    text = lambda p, k: F.to_json(F.col(p)) if isinstance(k, (T.ArrayType, T.MapType)) else F.col(p).cast("string")
    pairs = F.array(*[F.struct(F.lit(p).alias("metric"), F.coalesce(text(p, k), F.lit("")).alias("value")) for p, k in found])
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.metric", "x.value")
