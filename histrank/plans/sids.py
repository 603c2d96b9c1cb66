"""Semantic-id algebra and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histrank.functions import sid as N
from histrank.operators import sidstats as Q
from histrank.operators.packed import TITLES, packed_values
from histrank.plans.base import Plans
from histrank.plans.data import GROUPS, POP, item_groups, popularity
from histrank.session import materialize, table
from histrank.sources import views as V

P = Plans()
C = f"WITH {V.CAT} "
#: Prefix of a base id: the first three tokens, without the suffix that tells equal ids apart.
BASE = "array_to_string(tokens[:3], '')"


def base(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with base (the first three tokens of the id)."""
    return V.cat(spark, d).withColumn("base", F.array_join(F.slice("tokens", 1, 3), ""))


B = f"{C}, b AS (SELECT *, {BASE} AS base FROM cat) "


@P.add(C + "SELECT item_id, sid, tokens, len(tokens) AS n FROM cat")
def parse_sid_tokens(spark: SparkSession, d: str) -> DataFrame:
    return V.cat(spark, d).select("item_id", "sid", "tokens", F.size("tokens").alias("n"))


@P.add(C + "SELECT item_id, l AS level, array_to_string(tokens[:l], '') AS prefix FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS l FROM cat)")
def sid_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return V.cat(spark, d).select("item_id", F.explode(N.sid_prefixes(F.col("tokens"))).alias("p")).select("item_id", "p.level", "p.prefix")


@P.add("SELECT p_partkey, '<a_' || (p_size) || '><b_' || (p_partkey % 7) || '>' AS sid, '<a_' || (p_size + 1) || '><b_' || (p_partkey % 7 + 1) || '>' AS sid1, [p_size & 7, (p_size >> 3) & 7] AS unpacked FROM part")
def codes_to_tokens(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 7)
    return table(spark, d, "part").select("p_partkey", N.codes_to_sid(codes).alias("sid"), N.codes_to_sid(codes, 1).alias("sid1"), N.unpack_codes(F.col("p_size"), 2, 3).alias("unpacked"))


@P.add(B + "SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '<d_' || row_number() OVER (PARTITION BY base ORDER BY item_id) || '>' ELSE base END AS sid FROM b")
def dedup_suffix(spark: SparkSession, d: str) -> DataFrame:
    return Q.dedup_suffix(base(spark, d), "base").select("item_id", F.col("unique_sid").alias("sid"))


@P.add(B + ", g AS (SELECT base, count(*) AS n FROM b GROUP BY 1) SELECT sum(n)::BIGINT AS n_items, count(*) AS n_sids, round(1 - count(*)::DOUBLE / sum(n), 6) AS collision_rate, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS collided_items, count_if(n > 1) AS collided_groups, max(n) AS max_bucket, round(avg(n), 6) AS mean_bucket, round(quantile_cont(n, 0.95), 6) AS p95_bucket FROM g")
def sid_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return Q.uniqueness(base(spark, d), "base")


@P.add(C + """, t AS (SELECT level, token, count(*) AS n FROM (SELECT unnest(range(1, len(tokens) + 1)) AS level, unnest(tokens) AS token FROM cat) GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY level) AS total, avg(n) OVER (PARTITION BY level) AS mean, stddev_pop(n) OVER (PARTITION BY level) AS sd, row_number() OVER (PARTITION BY level ORDER BY n, token) AS i, count(*) OVER (PARTITION BY level) AS k FROM t)
SELECT level, count(*) AS n_tokens, round(-sum(n / total * log2(n / total)), 6) AS entropy, round(coalesce(-sum(n / total * log2(n / total)) / nullif(log2(count(*)), 0), 0), 6) AS normalized, round(pow(2, -sum(n / total * log2(n / total))), 6) AS perplexity, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95,
round(sum((2 * i - k - 1) * n)::DOUBLE / (any_value(k) * sum(n)), 6) AS gini, count_if(n > mean + 2 * sd) AS hotspots FROM s GROUP BY 1""")
def sid_level_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.level_stats(V.cat(spark, d))


PS = C + """, bs AS (SELECT sid, count(*) AS b FROM cat GROUP BY 1), p AS (SELECT b, l AS level, array_to_string(tokens[:l], '') AS prefix, tokens[l + 1] AS child FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS l FROM cat JOIN bs USING (sid))),
ps0 AS (SELECT level, prefix, count(*) AS n_items, count(DISTINCT child) AS fanout, round(avg(b), 6) AS bucket_mean, max(b) AS bucket_max, round(avg(CASE WHEN b > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pressure FROM p GROUP BY 1, 2),
ps AS (SELECT *, n_items > avg(n_items) OVER (PARTITION BY level) + 2 * stddev_pop(n_items) OVER (PARTITION BY level) AS hotspot FROM ps0) """


@P.add(PS + "SELECT * FROM ps")
def sid_prefix_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.prefix_stats(V.cat(spark, d))


@P.add(PS + "SELECT level, count(*) AS n_prefixes, round(avg(n_items), 6) AS mean_items, max(n_items) AS max_items, round(quantile_cont(n_items, 0.95), 6) AS p95_items, round(avg(fanout), 6) AS mean_fanout, max(fanout) AS max_fanout, max(pressure) AS max_pressure, count_if(hotspot) AS n_hotspots FROM ps GROUP BY 1")
def sid_prefix_summary(spark: SparkSession, d: str) -> DataFrame:
    return Q.prefix_summary(Q.prefix_stats(V.cat(spark, d)))


HB = f"WITH {V.HIST}{POP}, {V.CAT}, b AS (SELECT *, {BASE} AS base FROM cat) "
HBG = f"WITH {V.HIST}{POP}{GROUPS}, {V.CAT}, b AS (SELECT *, {BASE} AS base FROM cat) "


@P.add(HBG + "SELECT base, count(*) AS n, list(b.item_id ORDER BY b.item_id) AS items, list(coalesce(title, '') ORDER BY b.item_id) AS titles, list(coalesce(grp, 'mid') ORDER BY b.item_id) AS groups, sum(coalesce(pop.n, 0))::BIGINT AS interactions FROM b LEFT JOIN grp ON grp.item_id = b.item_id LEFT JOIN pop ON pop.item_id = b.item_id GROUP BY 1 HAVING count(*) > 1")
def collision_groups(spark: SparkSession, d: str) -> DataFrame:
    """Ids that several items share, with the items' titles, groups of popularity and interactions of the training split."""
    counts = materialize(popularity(spark, d).select("item_id", "n"), "popularity")
    groups = item_groups(spark, d, counts).select("item_id", "grp")
    rows = base(spark, d).select("item_id", "base", "title")
    shared = rows.groupBy("base").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(shared, "base").join(groups, "item_id", "left").join(counts, "item_id", "left")
    each = F.array_sort(F.collect_list(F.struct("item_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("grp", F.lit("mid")).alias("grp"))))
    rows = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n"), each.alias("x"), F.sum(F.coalesce("n", F.lit(0))).alias("interactions"))
    return rows.select("base", "n", F.col("x.item_id").alias("items"), F.col("x.title").alias("titles"), F.col("x.grp").alias("groups"), "interactions")


@P.add(HB + ", c AS (SELECT b.item_id, count(*) OVER (PARTITION BY base) > 1 AS hit FROM b) SELECT round(sum(CASE WHEN hit THEN target_n ELSE 0 END)::DOUBLE / sum(target_n), 6) AS target_share, round(sum(CASE WHEN hit THEN history_n ELSE 0 END)::DOUBLE / sum(history_n), 6) AS history_share, round(sum(CASE WHEN hit THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS total_share FROM c JOIN pop USING (item_id)")
def weighted_collision(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d).withColumn("hit", F.count(F.lit(1)).over(Window.partitionBy("base")) > 1).join(popularity(spark, d), "item_id")
    share = lambda c: F.round(F.sum(F.when(F.col("hit"), F.col(c)).otherwise(0)) / F.sum(c), 6)
    return rows.agg(share("target_n").alias("target_share"), share("history_n").alias("history_share"), share("n").alias("total_share"))


@P.add(C + "SELECT len(tokens) AS n_tokens, count(*) AS n FROM cat GROUP BY 1")
def sid_length_distribution(spark: SparkSession, d: str) -> DataFrame:
    return V.cat(spark, d).groupBy(F.size("tokens").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n"))


@P.add(C + "SELECT sid, list(item_id ORDER BY item_id) AS items, count(*) AS n FROM cat WHERE sid IS NOT NULL GROUP BY 1")
def sid2items(spark: SparkSession, d: str) -> DataFrame:
    return Q.sid2items(V.cat(spark, d).where("sid IS NOT NULL"), "sid")


@P.add(C + ", p AS (SELECT DISTINCT sid, array_to_string(tokens[:l], '') AS prefix FROM (SELECT *, unnest(range(1, len(tokens))) AS l FROM cat WHERE len(tokens) > 1)) SELECT DISTINCT p.sid, prefix FROM p WHERE prefix IN (SELECT sid FROM cat)")
def prefix_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    rows = V.cat(spark, d)
    prefixes = rows.select("sid", F.explode(N.sid_prefixes(F.col("tokens"))).alias("p"), F.size("tokens").alias("n")).where("p.level < n").select("sid", "p.prefix").distinct()
    return prefixes.join(rows.select(F.col("sid").alias("prefix")).distinct(), "prefix", "left_semi").select("sid", "prefix")


@P.add(C + ", p AS (SELECT array_to_string(tokens[:l], '') AS prefix, coalesce(tokens[l + 1], '<eos>') AS nxt FROM (SELECT *, unnest(range(0, len(tokens) + 1)) AS l FROM cat WHERE len(tokens) > 0)) SELECT prefix, list_sort(list(DISTINCT nxt)) AS next_tokens FROM p GROUP BY 1")
def prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    rows = V.cat(spark, d).where(F.size("tokens") > 0).withColumn("l", F.explode(F.sequence(F.lit(0), F.size("tokens"))))
    rows = rows.select(F.array_join(F.slice("tokens", F.lit(1), F.col("l")), "").alias("prefix"), F.coalesce(F.get("tokens", F.col("l")), F.lit("<eos>")).alias("nxt")).distinct()
    return rows.groupBy("prefix").agg(F.array_sort(F.collect_list("nxt")).alias("next_tokens"))


MAPS = ", m AS (SELECT item_id, max(item_sid) AS sid FROM title_histories WHERE item_id IS NOT NULL AND item_sid IS NOT NULL GROUP BY 1)"


def _titled_sids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "title_histories").where("item_id IS NOT NULL AND item_sid IS NOT NULL")
    return rows.groupBy("item_id").agg(F.max("item_sid").alias("sid_b"))


@P.add(C + MAPS + " SELECT cat.item_id, cat.sid AS sid_a, m.sid AS sid_b FROM cat JOIN m USING (item_id) WHERE cat.sid <> m.sid")
def mapping_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return V.cat(spark, d).select("item_id", F.col("sid").alias("sid_a")).join(_titled_sids(spark, d), "item_id").where("sid_a <> sid_b")


@P.add(C + MAPS + " SELECT coalesce(cat.item_id, m.item_id) AS item_id, coalesce(cat.sid, m.sid) AS sid FROM cat FULL JOIN m USING (item_id)")
def mapping_priority_merge(spark: SparkSession, d: str) -> DataFrame:
    a = V.cat(spark, d).where("sid IS NOT NULL").select("item_id", "sid", F.lit(0).alias("priority"))
    b = _titled_sids(spark, d).select("item_id", F.col("sid_b").alias("sid"), F.lit(1).alias("priority"))
    known = a.unionByName(b).groupBy("item_id").agg(F.min_by("sid", "priority").alias("sid"))
    return V.cat(spark, d).select("item_id").unionByName(b.select("item_id")).distinct().join(known, "item_id", "left")


S = f"WITH {V.CAT}, cs AS (SELECT sample_id, target_item_id, history_item_id FROM candidate_samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC) = 1) "


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_samples").where("sample_id IS NOT NULL")
    return rows.groupBy("sample_id").agg(F.max_by(F.struct("target_item_id", "history_item_id"), "ingested_at").alias("s")).select("sample_id", "s.*")


@P.add(S + ", e AS (SELECT sample_id, unnest(history_item_id) AS item, unnest(range(1, len(history_item_id) + 1)) AS pos FROM cs) SELECT sample_id, list(sid ORDER BY pos) AS history_sid FROM e JOIN cat ON cat.item_id = e.item WHERE sid IS NOT NULL GROUP BY 1")
def array_dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    return Q.array_lookup(_samples(spark, d), "sample_id", "history_item_id", V.cat(spark, d).select(F.col("item_id").alias("key"), F.col("sid").alias("value")), "history_sid")


@P.add(S + ", e AS (SELECT sample_id, unnest(history_item_id) AS item, unnest(range(1, len(history_item_id) + 1)) AS pos FROM cs), h AS (SELECT sample_id, list(sid ORDER BY pos) AS history_sid FROM e JOIN cat ON cat.item_id = e.item WHERE sid IS NOT NULL GROUP BY 1) SELECT cs.sample_id, cs.target_item_id, t.sid AS target_sid, coalesce(h.history_sid, []) AS history_sid, coalesce(len(cs.history_item_id), 0) - coalesce(len(h.history_sid), 0) AS n_missing FROM cs LEFT JOIN cat t ON t.item_id = cs.target_item_id LEFT JOIN h ON h.sample_id = cs.sample_id")
def rewrite_sids(spark: SparkSession, d: str) -> DataFrame:
    dim = V.cat(spark, d).select(F.col("item_id").alias("key"), F.col("sid").alias("value"))
    rows = _samples(spark, d)
    found = Q.array_lookup(rows, "sample_id", "history_item_id", dim, "history_sid")
    rows = rows.join(dim.select(F.col("key").alias("target_item_id"), F.col("value").alias("target_sid")), "target_item_id", "left").join(found, "sample_id", "left")
    history = F.coalesce("history_sid", F.array().cast("array<string>"))
    missing = F.coalesce(F.array_size("history_item_id"), F.lit(0)) - F.size(history)
    return rows.select("sample_id", "target_item_id", "target_sid", history.alias("history_sid"), missing.alias("n_missing"))


@P.add(S + "SELECT count(*) AS n, count_if(target_item_id IS NULL) AS null_targets, count_if(history_item_id IS NULL OR len(history_item_id) = 0) AS empty_histories, count_if(target_item_id IS NOT NULL AND cat.item_id IS NULL) AS unknown_targets, count(DISTINCT target_item_id) AS n_targets FROM cs LEFT JOIN cat ON cat.item_id = cs.target_item_id")
def split_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).join(V.cat(spark, d).select(F.col("item_id").alias("target_item_id"), F.lit(True).alias("known")), "target_item_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_item_id").isNull()).alias("null_targets"), F.count_if(F.col("history_item_id").isNull() | (F.size("history_item_id") == 0)).alias("empty_histories"),
        F.count_if(F.col("target_item_id").isNotNull() & F.col("known").isNull()).alias("unknown_targets"), F.countDistinct("target_item_id").alias("n_targets"),
    )


@P.add(HBG + ", sz AS (SELECT base, count(*) AS n FROM b GROUP BY 1) SELECT b.item_id, b.sid, b.tokens, b.title, sz.n AS bucket, sz.n > 1 AS collided, coalesce(target_n, 0) AS target_n, coalesce(history_n, 0) AS history_n, coalesce(grp.grp, 'mid') AS grp FROM b JOIN sz USING (base) LEFT JOIN pop ON pop.item_id = b.item_id LEFT JOIN grp ON grp.item_id = b.item_id")
def item_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(popularity(spark, d), "popularity")
    rows = base(spark, d)
    rows = rows.join(rows.groupBy("base").agg(F.count(F.lit(1)).alias("bucket")), "base")
    rows = rows.join(counts.drop("n"), "item_id", "left").fillna(0, ["target_n", "history_n"]).join(item_groups(spark, d, counts).select("item_id", "grp"), "item_id", "left")
    return rows.select("item_id", "sid", "tokens", "title", "bucket", (F.col("bucket") > 1).alias("collided"), "target_n", "history_n", F.coalesce("grp", F.lit("mid")).alias("grp"))


@P.add("SELECT item_id, min_by(item_title, row_id) AS title FROM title_histories WHERE item_id IS NOT NULL AND trim(item_title) <> '' GROUP BY 1")
def title_harvest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "title_histories").where("item_id IS NOT NULL AND trim(item_title) <> ''")
    return rows.groupBy("item_id").agg(F.min_by("item_title", "row_id").alias("title"))


@P.add()
def harvested_history_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the packed histories with the number of rows that hold each."""
    rows = table(spark, d, "title_histories").select("row_id", F.explode(F.array_distinct(F.transform(packed_values(F.col("history_item_title"), TITLES), lambda v: v["item_value"]))).alias("title")).distinct()
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@P.add("SELECT 'sid2title' AS task, item_sid AS source, title AS target FROM items WHERE item_sid IS NOT NULL AND trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY item_sid ORDER BY item_id DESC) = 1 UNION ALL SELECT 'title2sid', title, item_sid FROM items WHERE item_sid IS NOT NULL AND trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY title ORDER BY item_id DESC) = 1")
def bidirectional_alignment_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").where("item_sid IS NOT NULL AND trim(title) <> ''")
    there = rows.groupBy(F.col("item_sid").alias("source")).agg(F.max_by("title", "item_id").alias("target")).withColumn("task", F.lit("sid2title"))
    back = rows.groupBy(F.col("title").alias("source")).agg(F.max_by("item_sid", "item_id").alias("target")).withColumn("task", F.lit("title2sid"))
    return there.unionByName(back)


@P.add("SELECT row_id, 'The user has interacted with ' || history_item_sid || '. Context ' || coalesce(e_token, '[CTX_UNKNOWN]') || '. Next: ' AS prompt, item_sid AS target FROM (SELECT DISTINCT row_id, history_item_sid, e_token, item_sid FROM title_histories WHERE item_sid IS NOT NULL AND history_item_sid IS NOT NULL)")
def prompt_rendering(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "title_histories").where("item_sid IS NOT NULL AND history_item_sid IS NOT NULL").select("row_id", "history_item_sid", "e_token", "item_sid").distinct()
    prompt = F.concat(F.lit("The user has interacted with "), F.col("history_item_sid"), F.lit(". Context "), F.coalesce("e_token", F.lit("[CTX_UNKNOWN]")), F.lit(". Next: "))
    return rows.select("row_id", prompt.alias("prompt"), F.col("item_sid").alias("target"))


@P.add(C + "SELECT item_id, CASE WHEN regexp_matches(asin, '^[0-9]+$') THEN 0 ELSE 1 END AS kind, row_number() OVER (ORDER BY CASE WHEN regexp_matches(asin, '^[0-9]+$') THEN 0 ELSE 1 END, try_cast(asin AS BIGINT), asin, item_id) AS place FROM items")
def numeric_first_order(spark: SparkSession, d: str) -> DataFrame:
    from histrank.operators.sequences import global_rank

    number = F.col("asin").try_cast("bigint")
    rows = table(spark, d, "items").select("item_id", "asin", F.when(F.col("asin").rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"))
    ranked, _ = global_rank(rows, ["kind", "number", "asin", "item_id"], "place")
    return ranked.select("item_id", "kind", (F.col("place") + 1).alias("place"))


QUERIES, ORACLE = P.queries, P.oracle
