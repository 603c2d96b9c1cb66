"""The smaller operators: predicates, set operations, checks, selections and report rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histrank.functions import text as X
from histrank.operators import fusion as U
from histrank.operators import metrics as M
from histrank.operators.sequences import first_rows, global_rank
from histrank.plans.base import Plans
from histrank.plans.data import H, I, POP, popularity
from histrank.plans.learning import GEN, generations
from histrank.plans.ranking import FR, KS, KSQL, R, Z, ZR, fused_ranks, streams
from histrank.plans.sids import BASE, C, base
from histrank.session import table
from histrank.sources import views as V

P = Plans()


# predicates and projections


@P.add(I + "SELECT user_id, item_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id) AS n FROM inter) WHERE n <= 100")
def row_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred rows of the total order (a limit is the operator)."""
    return first_rows(V.inter(spark, d).select("user_id", "item_id", "ts"), ["ts", "user_id", "item_id"], 100)


@P.add("SELECT user_id FROM (SELECT DISTINCT user_id FROM interactions WHERE user_id IS NOT NULL) ORDER BY sha256('7:' || user_id) LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty users by the smallest hash: a sample that is the same on every run."""
    users = table(spark, d, "interactions").select("user_id").where("user_id IS NOT NULL").distinct()
    return users.orderBy(F.sha2(F.concat(F.lit("7:"), F.col("user_id")), 256)).limit(50)


@P.add(C + "SELECT level, count(*) AS n FROM (SELECT unnest(range(1, (SELECT max(len(tokens)) FROM cat) + 1)) AS level), cat WHERE len(tokens) >= level GROUP BY 1")
def prefix_level_inference(spark: SparkSession, d: str) -> DataFrame:
    return V.cat(spark, d).where(F.size("tokens") > 0).select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.size("tokens").cast("bigint"))).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@P.add(C + "SELECT s.sample_id, s.target_item_id, c.item_id IS NOT NULL AS known FROM (SELECT DISTINCT sample_id, target_item_id FROM samples WHERE target_item_id IS NOT NULL) s LEFT JOIN cat c ON c.item_id = s.target_item_id AND len(c.tokens) > 0")
def valid_sid_predicate(spark: SparkSession, d: str) -> DataFrame:
    known = V.cat(spark, d).where(F.size("tokens") > 0).select(F.col("item_id").alias("target_item_id"), F.lit(True).alias("k"))
    rows = table(spark, d, "samples").select("sample_id", "target_item_id").where("target_item_id IS NOT NULL").distinct()
    return rows.join(known, "target_item_id", "left").select("sample_id", "target_item_id", F.col("k").isNotNull().alias("known"))


@P.add(H + ", l AS (SELECT count(*) AS n, count_if(h.user_id IN (SELECT user_id FROM hist WHERE split = 'train')) AS shared FROM hist h WHERE split = 'test') SELECT CASE WHEN n = 0 THEN 'UNKNOWN' WHEN shared = n THEN 'CONFIRMED' WHEN shared > 0 THEN 'POSSIBLE' ELSE 'CLEAN' END AS verdict FROM l")
def leakage_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = V.hist(spark, d)
    users = rows.where("split = 'train'").select("user_id", F.lit(1).alias("s")).distinct()
    c = rows.where("split = 'test'").join(users, "user_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("shared"))
    return c.select(F.when(F.col("n") == 0, "UNKNOWN").when(F.col("shared") == F.col("n"), "CONFIRMED").when(F.col("shared") > 0, "POSSIBLE").otherwise("CLEAN").alias("verdict"))


@P.add("SELECT item_id, CASE WHEN t = '' OR length(t) >= 60 THEN '' ELSE t || '.' END AS sentence FROM (SELECT item_id, regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(coalesce(description, ''), '&quot;', '\"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '[.]*$', '') AS t FROM items)")
def clean_text_td(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_id", X.clean_sentence(F.col("description"), 60).alias("sentence"))


@P.add("SELECT item_id, CASE WHEN t = '' AND x = '' THEN 'unknown item' WHEN t = '' THEN x WHEN x = '' THEN t ELSE t || ' ' || x END AS text FROM (SELECT item_id, " + ", ".join(f"trim(regexp_replace(regexp_replace(replace(replace(coalesce({c}, ''), '&quot;', '\"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS {a}" for c, a in (("title", "t"), ("description", "x"))) + " FROM items)")
def feature_text(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.array(X.clean_text(F.col("title")), X.clean_text(F.col("description"))), lambda p: p != "")
    return table(spark, d, "items").select("item_id", F.when(F.size(parts) == 0, "unknown item").otherwise(F.array_join(parts, " ")).alias("text"))


@P.add("SELECT item_id, CASE WHEN price > 50 THEN 'I' ELSE 'O' END AS kind FROM (SELECT item_id, coalesce(try_cast(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE), 0.0) AS price FROM items)")
def item_type_rule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_id", F.when(X.price(F.col("price_text")) > 50, "I").otherwise("O").alias("kind"))


@P.add(I + "SELECT date_trunc('month', to_timestamp(ts)::TIMESTAMP) AS month, count(*) AS n FROM inter GROUP BY 1")
def month_starts(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_trunc("month", F.timestamp_seconds("ts")).cast("timestamp_ntz")
    return V.inter(spark, d).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


@P.add("SELECT event_id, ((h * 60 + m) * 60 + s) AS seconds FROM (SELECT event_id, event_id % 5 AS h, event_id % 60 AS m, (event_id * 7) % 60 AS s FROM events)")
def clock_text_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of h:mm:ss texts."""
    e = F.col("event_id")
    clock = F.format_string("%d:%02d:%02d", e % 5, e % 60, e * 7 % 60)
    p = F.split(clock, ":")
    part = lambda i: F.get(p, F.lit(i)).cast("bigint")
    return table(spark, d, "events").select("event_id", ((part(0) * 60 + part(1)) * 60 + part(2)).alias("seconds"))


@P.add("SELECT row_id, from_json AS sids FROM (SELECT DISTINCT row_id, history_item_sid, history_item_sid::JSON::VARCHAR[] AS from_json FROM title_histories WHERE starts_with(history_item_sid, '[\"') AND ends_with(history_item_sid, '\"]') AND NOT contains(history_item_sid, ''''))")
def list_literal_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "title_histories").select("row_id", "history_item_sid").distinct()
    rows = rows.where(F.startswith("history_item_sid", F.lit('["')) & F.endswith("history_item_sid", F.lit('"]')) & ~F.contains("history_item_sid", F.lit("'")))
    return rows.select("row_id", F.from_json("history_item_sid", "array<string>").alias("sids"))


@P.add("SELECT sample_id, '[' || array_to_string(list_transform(history_item_id, lambda x: '\"' || x || '\"'), ',') || ']' AS canonical FROM (SELECT DISTINCT sample_id, list_filter(history_item_id, lambda x: x IS NOT NULL) AS history_item_id FROM candidate_samples WHERE history_item_id IS NOT NULL)")
def list_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_samples").where("history_item_id IS NOT NULL").select("sample_id", F.array_compact("history_item_id").alias("h")).distinct()
    return rows.select("sample_id", F.to_json(F.transform("h", lambda x: x.cast("string"))).alias("canonical"))


@P.add("SELECT event_id, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE 'x' END AS item FROM (SELECT event_id, round(value)::DOUBLE AS v FROM events)")
def item_id_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = F.round("value")
    return table(spark, d, "events").select("event_id", F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise("x").alias("item"))


@P.add("SELECT vec_id, round(1 / (1 + exp(-least(50, greatest(-50, x)))), 6) AS logistic FROM (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x FROM embeddings)")
def logistic_clip(spark: SparkSession, d: str) -> DataFrame:
    x = F.get("embedding", F.lit(0)).cast("double") * 100
    return table(spark, d, "embeddings").select("vec_id", F.round(F.lit(1.0) / (1 + F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), x)))), 6).alias("logistic"))


@P.add("SELECT candidate_mode, CASE WHEN candidate_mode LIKE 'prefix@%' THEN 'prefix' ELSE coalesce(candidate_mode, 'none') END AS kind, try_cast(regexp_extract(candidate_mode, '@([0-9]+)', 1) AS INT) AS level, count(*) AS n FROM candidate_samples GROUP BY 1, 2, 3")
def alias_parsing(spark: SparkSession, d: str) -> DataFrame:
    mode = F.col("candidate_mode")
    kind = F.when(F.startswith(mode, F.lit("prefix@")), "prefix").otherwise(F.coalesce(mode, F.lit("none")))
    level = F.nullif(F.regexp_extract(mode, "@([0-9]+)", 1), F.lit("")).try_cast("int")
    return table(spark, d, "candidate_samples").groupBy("candidate_mode", kind.alias("kind"), level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@P.add("SELECT DISTINCT sample_id, history_item_id[:-2] AS context, history_item_id[-1] AS held_out FROM candidate_samples WHERE len(history_item_id) >= 2")
def leave_last_out(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("history_item_id")
    return table(spark, d, "candidate_samples").where(F.size(h) >= 2).select("sample_id", F.slice(h, F.lit(1), F.size(h) - 1).alias("context"), F.element_at(h, -1).alias("held_out")).distinct()


# joins and checks


@P.add(Z + f", {V.TRUTH}, s AS (SELECT DISTINCT q FROM z) SELECT count(*) AS n, count_if(s.q IS NULL) AS no_candidates, count_if(t.q IS NULL) AS no_target FROM s FULL JOIN truth t ON s.q = t.q")
def sample_union(spark: SparkSession, d: str) -> DataFrame:
    qs = streams(spark, d).select("q", F.lit(1).alias("c")).distinct()
    rows = qs.join(V.truth(spark, d).select("q", F.lit(1).alias("t")), "q", "full")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c").isNull()).alias("no_candidates"), F.count_if(F.col("t").isNull()).alias("no_target"))


@P.add(H + ", l AS (SELECT user_id, item_id, rating FROM inter QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC) = 1) SELECT h.user_id, h.item_id, h.ts, l.rating FROM hist h LEFT JOIN l ON l.user_id = h.user_id AND l.item_id = h.item_id")
def rating_backfill(spark: SparkSession, d: str) -> DataFrame:
    last = V.inter(spark, d).groupBy("user_id", "item_id").agg(F.max_by("rating", "ts").alias("rating"))
    return V.hist(spark, d).select("user_id", "item_id", "ts").join(last, ["user_id", "item_id"], "left")


@P.add(f"WITH {V.RANKED}, {V.TRUTH} SELECT t.q, target AS positive, item AS negative FROM truth t JOIN ranked r ON r.q = t.q AND stream = 'cf' AND r.item <> target WHERE t.q IN (SELECT r2.q FROM ranked r2 WHERE r2.q = t.q AND r2.item = t.target AND r2.stream = 'cf')")
def positive_negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranked(spark, d).where("stream = 'cf'").join(V.truth(spark, d), "q")
    has = rows.where("item = target").select("q")
    return rows.where("item <> target").join(has, "q", "left_semi").select("q", F.col("target").alias("positive"), F.col("item").alias("negative"))


@P.add(Z + "SELECT a.q, a.item AS direct_item, b.item AS boundary_item, b.cf AS boundary FROM z a JOIN z b ON a.q = b.q AND b.cf BETWEEN 10 AND 19 WHERE a.cf IS NULL")
def boundary_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = streams(spark, d).select("q", "item", "cf", "direct")
    left = rows.where("cf IS NULL").select("q", F.col("item").alias("direct_item"))
    return left.join(rows.where("cf BETWEEN 10 AND 19").select("q", F.col("item").alias("boundary_item"), F.col("cf").alias("boundary")), "q")


@P.add("SELECT matrix_key, count(*) AS n FROM (SELECT md5(array_to_string(list_transform(matrix, lambda x: round(x::DOUBLE * 1000)::BIGINT), ',')) AS matrix_key FROM item_vectors WHERE len(matrix) = 64 AND len(list_filter(matrix, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR abs(x) > 1e6)) = 0) GROUP BY 1 HAVING count(*) > 1")
def duplicate_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that are equal to three decimals: grouped by a digest, no pairs are compared."""
    ok = (F.size("matrix") == 64) & ~F.exists("matrix", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e6))
    digest = F.md5(F.array_join(F.transform("matrix", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string")), ","))
    return table(spark, d, "item_vectors").where(ok).groupBy(digest.alias("matrix_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@P.add("SELECT (SELECT count(*) FROM (SELECT item_id FROM items EXCEPT SELECT item_id FROM item_vectors)) AS without_vector, (SELECT count(*) FROM (SELECT item_id FROM item_vectors WHERE item_id IS NOT NULL EXCEPT SELECT item_id FROM items)) AS without_item")
def set_coverage(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "items").select("item_id"), table(spark, d, "item_vectors").where("item_id IS NOT NULL").select("item_id")
    left = a.subtract(b).agg(F.count(F.lit(1)).alias("without_vector"))
    return left.crossJoin(F.broadcast(b.subtract(a).agg(F.count(F.lit(1)).alias("without_item"))))


@P.add(Z + "SELECT q, item, direct FROM z WHERE cf IS NULL")
def exclusive_items(spark: SparkSession, d: str) -> DataFrame:
    return streams(spark, d).where("cf IS NULL").select("q", "item", "direct")


@P.add("SELECT sample_id, count(*) AS n, count(DISTINCT target_item_id) AS n_targets, max(coalesce(split, '')) AS split FROM samples GROUP BY 1 HAVING count(*) > 1")
def one_to_one_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_item_id").alias("n_targets"), F.max(F.coalesce("split", F.lit(""))).alias("split")).where("n > 1")


@P.add("""WITH a AS (SELECT row_number() OVER (ORDER BY sample_id) AS n, * FROM (SELECT sample_id, arg_min({'s': coalesce(lower(trim(split)), '-'), 't': coalesce(target_item_id, -1), 'h': coalesce(history_item_id, '-')}, ingested_at) AS x FROM samples WHERE sample_id IS NOT NULL GROUP BY 1)),
b AS (SELECT row_number() OVER (ORDER BY sample_id) AS n, * FROM (SELECT sample_id, {'s': max(coalesce(lower(trim(split)), '-')), 't': max(coalesce(target_item_id, -1)), 'h': max(coalesce(history_item_id, '-'))} AS y FROM samples WHERE sample_id IS NOT NULL GROUP BY 1))
SELECT count(*) AS n, count(*) FILTER (WHERE a.sample_id = b.sample_id) AS same_id, count(*) FILTER (WHERE x.s = y.s) AS same_split, count(*) FILTER (WHERE x.t = y.t) AS same_target, count(*) FILTER (WHERE x.h = y.h) AS same_history FROM a FULL JOIN b USING (n)""")
def split_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the samples row by row: the first rows that came in against the largest values of all repeats, field by field."""
    rows = table(spark, d, "samples").where("sample_id IS NOT NULL").select("sample_id", "ingested_at", F.coalesce(F.lower(F.trim("split")), F.lit("-")).alias("s"), F.coalesce("target_item_id", F.lit(-1)).alias("t"), F.coalesce("history_item_id", F.lit("-")).alias("h"))
    first = rows.groupBy("sample_id").agg(F.min_by(F.struct("s", "t", "h"), "ingested_at").alias("x"))
    largest = rows.groupBy("sample_id").agg(F.struct(F.max("s").alias("s"), F.max("t").alias("t"), F.max("h").alias("h")).alias("y"))
    (a, _), (b, _) = global_rank(first, ["sample_id"], "n"), global_rank(largest, ["sample_id"], "n")
    both = a.select("n", F.col("sample_id").alias("i"), "x").join(b.select("n", F.col("sample_id").alias("k"), "y"), "n", "full")
    same = lambda p, q, name: F.count_if(F.coalesce(F.col(p) == F.col(q), F.lit(False))).alias(name)
    return both.agg(F.count(F.lit(1)).alias("n"), same("i", "k", "same_id"), same("x.s", "y.s", "same_split"), same("x.t", "y.t", "same_target"), same("x.h", "y.h", "same_history"))


# aggregates


@P.add(C + f", b AS (SELECT *, {BASE} AS base FROM cat) SELECT 'full' AS grain, count(*) AS n_items, count(DISTINCT sid) AS n_sids FROM b UNION ALL SELECT 'base', count(*), count(DISTINCT base) FROM b")
def collision_grains(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d).select(F.explode(F.array(F.struct(F.lit("full").alias("grain"), F.col("sid").alias("s")), F.struct(F.lit("base").alias("grain"), F.col("base").alias("s")))).alias("x")).select("x.*")
    return rows.groupBy("grain").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("s").alias("n_sids"))


@P.add(C + ", t AS (SELECT unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS level FROM cat) SELECT level, count(DISTINCT token) AS codes, count(*) AS n FROM t GROUP BY 1")
def code_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = V.cat(spark, d).select(F.posexplode("tokens").alias("p", "token"))
    return rows.groupBy((F.col("p") + 1).cast("bigint").alias("level")).agg(F.countDistinct("token").alias("codes"), F.count(F.lit(1)).alias("n"))


@P.add(C + ", m AS (SELECT item_id, max(item_sid) AS sid, max(item_title) AS title FROM title_histories WHERE item_id IS NOT NULL GROUP BY 1) SELECT count(*) AS n, count_if(cat.sid <> m.sid) AS sid_conflicts, count_if(cat.title <> m.title) AS title_conflicts FROM cat JOIN m USING (item_id)")
def source_consistency(spark: SparkSession, d: str) -> DataFrame:
    other = table(spark, d, "title_histories").where("item_id IS NOT NULL").groupBy("item_id").agg(F.max("item_sid").alias("s"), F.max("item_title").alias("t"))
    return V.cat(spark, d).join(other, "item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sid") != F.col("s")).alias("sid_conflicts"), F.count_if(F.col("title") != F.col("t")).alias("title_conflicts"))


@P.add(GEN + ", g2 AS (SELECT q, count(*) AS n, count(DISTINCT item) AS u FROM rw GROUP BY 1) SELECT q, round(u::DOUBLE / n, 6) AS diversity FROM g2")
def group_diversity(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).groupBy("q").agg(F.round(F.countDistinct("item") / F.count(F.lit(1)), 6).alias("diversity"))


@P.add(f"WITH {V.RANKED}, c AS (SELECT q, stream, count(*) AS n FROM ranked GROUP BY 1, 2) SELECT stream, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, bool_and(n = {V.LIST}) AS all_full FROM c GROUP BY 1")
def candidate_count_summary(spark: SparkSession, d: str) -> DataFrame:
    c = V.ranked(spark, d).groupBy("q", "stream").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("stream").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.bool_and(F.col("n") == V.LIST).alias("all_full"))


@P.add(R + ", p AS (SELECT q % 3 AS part, count(*) AS n, sum(CASE WHEN cf < 20 THEN 1 / log2(cf + 2) ELSE 0 END) / count(*) AS ndcg FROM ranks GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(ndcg * n) / sum(n), 6) AS ndcg FROM p")
def weighted_reaggregation(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranks(spark, d).withColumn("k", F.lit(20)).groupBy((F.col("q") % 3).alias("part"))
    parts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(M.within("cf"), M.gain(F.col("cf"))).otherwise(0.0)).alias("x"))
    return parts.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("ndcg"))


@P.add("SELECT i.item_id, row_number() OVER (ORDER BY sha256('42:' || i.item_id), i.item_id) - 1 AS id FROM (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL) i")
def shuffled_ids(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids in an order that a seeded hash shuffles."""
    rows = table(spark, d, "items").select("item_id").where("item_id IS NOT NULL").distinct()
    ranked, _ = global_rank(rows.withColumn("h", F.sha2(F.concat(F.lit("42:"), F.col("item_id").cast("string")), 256)), ["h", "item_id"], "id")
    return ranked.select("item_id", "id")


@P.add("SELECT DISTINCT row_id, CASE WHEN e_token IS NOT NULL THEN e_token ELSE ['[CTX_A]', '[CTX_B]', '[CTX_C]'][row_id % 3 + 1] END AS tag FROM title_histories")
def context_tags(spark: SparkSession, d: str) -> DataFrame:
    """A context tag for each row; where there is none, one chosen by the row's id (the same on every run)."""
    tags = F.array(*[F.lit(x) for x in ("[CTX_A]", "[CTX_B]", "[CTX_C]")])
    return table(spark, d, "title_histories").select("row_id", F.coalesce("e_token", F.get(tags, (F.col("row_id") % 3).cast("int"))).alias("tag")).distinct()


@P.add("SELECT DISTINCT s.sample_id, target_item_id, CASE WHEN n >= target_item_id THEN n + 1 ELSE n END AS negative FROM (SELECT sample_id, target_item_id, (sample_id * 31 + 7) % ((SELECT max(item_id) FROM items) - 1) + 1 AS n FROM candidate_samples WHERE target_item_id IS NOT NULL) s")
def negative_sampling(spark: SparkSession, d: str) -> DataFrame:
    """One item that is not the target for each sample, by a rule on the id instead of a random number."""
    top = table(spark, d, "items").agg(F.max("item_id").alias("top"))
    rows = table(spark, d, "candidate_samples").where("target_item_id IS NOT NULL").crossJoin(F.broadcast(top))
    n = (F.col("sample_id") * 31 + 7) % (F.col("top") - 1) + 1
    return rows.select("sample_id", "target_item_id", F.when(n >= F.col("target_item_id"), n + 1).otherwise(n).alias("negative")).distinct()


# selections and report rules


@P.add(R + f", m AS (SELECT k, count_if(cf < k)::DOUBLE / count(*) AS hr FROM ranks, {KSQL} GROUP BY 1), x AS (SELECT max(hr) AS best FROM m) SELECT min(k) AS k FROM m, x WHERE hr >= 0.9::DOUBLE * best")
def constrained_selection(spark: SparkSession, d: str) -> DataFrame:
    """The smallest k whose hit rate reaches nine tenths of the best."""
    m = M.with_k(V.ranks(spark, d), KS).groupBy("k").agg(F.avg(M.within("cf").cast("double")).alias("hr"))
    return m.crossJoin(F.broadcast(m.agg(F.max("hr").alias("best")))).where(F.col("hr") >= 0.9 * F.col("best")).agg(F.min("k").alias("k"))


@P.add(R + f", m AS (SELECT k, round(avg(CASE WHEN cf < k THEN 1 / log2(cf + 2) ELSE 0 END), 9) AS a, k AS cost FROM ranks, {KSQL} GROUP BY 1) SELECT k FROM m ORDER BY a DESC, cost LIMIT 1")
def config_selection(spark: SparkSession, d: str) -> DataFrame:
    """The setting with the best metric, ties to the smaller cost."""
    m = M.with_k(V.ranks(spark, d), KS).groupBy("k").agg(F.round(F.avg(F.when(M.within("cf"), M.gain(F.col("cf"))).otherwise(0.0)), 9).alias("a"))
    return m.agg(F.max_by("k", F.struct("a", -F.col("k"))).alias("k"))


@P.add(FR + ", c AS (SELECT count_if(cf < 20 OR direct < 20) - count_if(cf < 20) AS gap, count_if(direct < 20 AND coalesce(cf >= 20, true)) AS only_ FROM x) SELECT gap, only_ AS complementary, CASE WHEN gap >= 10 AND only_ > 0 THEN 'rerank' WHEN gap > 0 THEN 'inspect' ELSE 'stop' END AS decision FROM c")
def decision_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = fused_ranks(spark, d).withColumn("k", F.lit(20))
    a, b = M.within("cf"), M.within("direct")
    c = rows.agg((F.count_if(a | b) - F.count_if(a)).alias("gap"), F.count_if(b & ~a).alias("complementary"))
    return c.withColumn("decision", F.when((F.col("gap") >= 10) & (F.col("complementary") > 0), "rerank").when(F.col("gap") > 0, "inspect").otherwise("stop"))


@P.add(FR + "SELECT count_if(cf IS NULL AND direct IS NOT NULL) AS pool_exclusive, count_if(coalesce(cf >= 20, true) AND direct < 20) AS non_top20_direct, count_if(coalesce(cf >= 20, true) AND (cf IS NOT NULL OR direct IS NOT NULL)) AS non_top20_union, count_if(direct IS NOT NULL AND cf IS NULL AND fused IS NOT NULL) AS direct_exclusive FROM x")
def definition_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Targets by four definitions of what only the direct stream brings."""
    rows = fused_ranks(spark, d).withColumn("k", F.lit(20))
    has, none = F.col("direct").isNotNull(), F.col("cf").isNull()
    return rows.agg(
        F.count_if(none & has).alias("pool_exclusive"), F.count_if(~M.within("cf") & M.within("direct")).alias("non_top20_direct"), F.count_if(~M.within("cf") & (has | ~none)).alias("non_top20_union"),
        F.count_if(has & none & F.col("fused").isNotNull()).alias("direct_exclusive"),
    )


@P.add(R + "SELECT CASE WHEN cf < 20 THEN CASE WHEN direct < 20 THEN 'both' ELSE 'cf' END WHEN direct < 20 THEN 'direct' WHEN cf IS NOT NULL OR direct IS NOT NULL THEN 'union_beyond_20' ELSE 'absent' END AS source_group, count(*) AS n FROM ranks GROUP BY 1")
def source_group(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranks(spark, d).withColumn("k", F.lit(20))
    a, b = M.within("cf"), M.within("direct")
    group = F.when(a & b, "both").when(a, "cf").when(b, "direct").when(F.col("cf").isNotNull() | F.col("direct").isNotNull(), "union_beyond_20").otherwise("absent")
    return rows.groupBy(group.alias("source_group")).agg(F.count(F.lit(1)).alias("n"))


@P.add(R + f", x AS (SELECT r.*, h.split FROM ranks r JOIN (SELECT sample_id AS q, any_value(CASE WHEN candidate_mode IS NULL THEN 'none' ELSE candidate_mode END) AS split FROM candidate_samples GROUP BY 1) h USING (q)) SELECT 'mode=' || split AS grp, k, count(*) AS n, round(avg(CASE WHEN cf < k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr FROM x, {KSQL} GROUP BY 1, 2")
def keyed_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    modes = table(spark, d, "candidate_samples").groupBy(F.col("sample_id").alias("q")).agg(F.concat(F.lit("mode="), F.max(F.coalesce("candidate_mode", F.lit("none")))).alias("grp"))
    return M.hr_ndcg(V.ranks(spark, d).join(modes, "q"), "cf", KS, ["grp"]).select("grp", "k", "n", "hr")


@P.add(ZR + f", {V.TRUTH}, p AS (SELECT q, item, rank, 0.5::DOUBLE * fused + 0.1::DOUBLE * greatest(-0.5, least(0.5, coalesce(direct_score, 0) * 10)) AS score FROM f) SELECT q, item, round(score, 9) AS score FROM p")
def clipped_residual_score(spark: SparkSession, d: str) -> DataFrame:
    rows = U.rrf(streams(spark, d))
    residual = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.coalesce("direct_score", F.lit(0.0)) * 10))
    return rows.select("q", "item", F.round(0.5 * F.col("fused") + 0.1 * residual, 9).alias("score"))


@P.add(FR + ", t AS (SELECT unnest(quantile_cont(1.0::DOUBLE / (fused + 1), [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])) AS t FROM x WHERE fused IS NOT NULL) SELECT DISTINCT round(greatest(0, least(1, t)), 6) AS threshold FROM t ORDER BY 1 LIMIT 5")
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds at quantiles of the scores of found targets, within [0, 1], rounded, distinct, the five smallest; 0.5 where there is no score."""
    rows = fused_ranks(spark, d).where("fused IS NOT NULL").select((F.lit(1.0) / (F.col("fused") + 1)).alias("s"))
    cuts = rows.agg(F.coalesce(F.percentile("s", F.array(*[F.lit(p) for p in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)])), F.array(F.lit(0.5))).alias("t"))
    inside = F.array_sort(F.array_distinct(F.transform("t", lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6))))
    return cuts.select(F.explode(F.slice(inside, 1, 5)).alias("threshold"))


@P.add(I + "SELECT CASE WHEN rating >= 4 THEN 'purchase' ELSE 'click' END AS kind, count(*) AS n, round(avg(rating), 6) AS mean FROM inter WHERE rating IS NOT NULL GROUP BY 1")
def reward_kind_split(spark: SparkSession, d: str) -> DataFrame:
    rows = V.inter(spark, d).where("rating IS NOT NULL")
    return rows.groupBy(F.when(F.col("rating") >= 4, "purchase").otherwise("click").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


@P.add(H + POP + ", v AS (SELECT item_id, ln(1 + n) AS weight FROM pop) SELECT h.user_id, h.item_id, h.ts, round(coalesce(weight, 0), 6) AS weight FROM hist h LEFT JOIN v ON v.item_id = h.item_id WHERE split = 'train'")
def value_weights(spark: SparkSession, d: str) -> DataFrame:
    v = popularity(spark, d).select("item_id", F.log1p("n").alias("w"))
    return V.hist(spark, d).where("split = 'train'").join(v, "item_id", "left").select("user_id", "item_id", "ts", F.round(F.coalesce("w", F.lit(0.0)), 6).alias("weight"))


@P.add("SELECT history_item_sid AS prompt, max_by(item_sid, row_id) AS target, count(DISTINCT row_id) AS n FROM title_histories WHERE history_item_sid IS NOT NULL AND item_sid IS NOT NULL GROUP BY 1")
def prompt_targets(spark: SparkSession, d: str) -> DataFrame:
    """The target of each prompt; a later row replaces an earlier one."""
    rows = table(spark, d, "title_histories").where("history_item_sid IS NOT NULL AND item_sid IS NOT NULL")
    return rows.groupBy(F.col("history_item_sid").alias("prompt")).agg(F.max_by("item_sid", "row_id").alias("target"), F.countDistinct("row_id").alias("n"))


@P.add("SELECT 'title2sid' AS task, count(*) AS n FROM items WHERE title IS NOT NULL UNION ALL SELECT 'sid2title', count(*) FROM items WHERE item_sid IS NOT NULL UNION ALL SELECT 'history', count(*) FROM title_histories")
def task_concat(spark: SparkSession, d: str) -> DataFrame:
    """Examples of several tasks in one table, counted by task."""
    items = table(spark, d, "items")
    a = items.where("title IS NOT NULL").select(F.lit("title2sid").alias("task"), F.col("title").alias("source"))
    b = items.where("item_sid IS NOT NULL").select(F.lit("sid2title").alias("task"), F.col("item_sid").alias("source"))
    c = table(spark, d, "title_histories").select(F.lit("history").alias("task"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@P.add(R + "SELECT 'hr20' AS metric, round(avg(CASE WHEN cf < 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS value FROM ranks UNION ALL SELECT 'mrr', round(avg(coalesce(1.0::DOUBLE / (cf + 1), 0)), 6) FROM ranks UNION ALL SELECT 'n', count(*)::DOUBLE FROM ranks")
def final_report(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranks(spark, d).withColumn("k", F.lit(20))
    one = rows.agg(F.round(F.avg(M.within("cf").cast("double")), 6).alias("hr20"), M.mrr(rows, "cf").alias("mrr"), F.count(F.lit(1)).cast("double").alias("n"))
    return one.unpivot([], ["hr20", "mrr", "n"], "metric", "value")


@P.add(R + f", t AS (SELECT CASE WHEN coalesce(cf < 20, false) THEN 'kept' ELSE 'missed' END AS transition, CASE WHEN direct IS NULL THEN 'absent' WHEN direct < 20 THEN 'top20' ELSE 'deeper' END AS direct_group FROM ranks) SELECT transition, direct_group, count(*) AS n FROM t GROUP BY 1, 2")
def focus_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranks(spark, d).withColumn("k", F.lit(20))
    return rows.groupBy(F.when(M.within("cf"), "kept").otherwise("missed").alias("transition"), F.when(F.col("direct").isNull(), "absent").when(M.within("direct"), "top20").otherwise("deeper").alias("direct_group")).agg(F.count(F.lit(1)).alias("n"))


@P.add(f"WITH {V.RANKED}, {V.TRUTH}, h AS (SELECT t.q, min(rank) AS hit FROM truth t LEFT JOIN ranked r ON r.q = t.q AND r.item = t.target AND r.stream = 'cf' GROUP BY 1), x AS (SELECT r.q, count_if(item NOT IN (SELECT item_id FROM items) AND (hit IS NULL OR rank < hit)) AS bad FROM ranked r JOIN h ON h.q = r.q WHERE stream = 'cf' GROUP BY 1) SELECT sum(bad)::BIGINT AS invalid_before_hit, count(*) AS n FROM x")
def legacy_invalid_counter(spark: SparkSession, d: str) -> DataFrame:
    """Unknown items that come before the hit, over all queries."""
    rows = V.ranked(spark, d).where("stream = 'cf'").join(V.truth(spark, d), "q")
    known = table(spark, d, "items").select(F.col("item_id").alias("item"), F.lit(True).alias("known")).distinct()
    rows = U.with_totals(rows, F.min(F.when(F.col("item") == F.col("target"), F.col("rank"))).alias("hit")).join(known, "item", "left")
    bad = F.col("known").isNull() & (F.col("hit").isNull() | (F.col("rank") < F.col("hit")))
    return rows.groupBy("q").agg(F.count_if(bad).alias("b")).agg(F.sum("b").alias("invalid_before_hit"), F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = P.queries, P.oracle
