"""From raw interactions to histories, splits and audits of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histrank.functions import text as X
from histrank.operators.cooccurrence import cooccurrences
from histrank.operators import sequences as S
from histrank.plans.base import Plans
from histrank.session import materialize, table
from histrank.sources import views as V

P = Plans()
LO, HI = 1_500_000_000, 1_530_000_000
H = f"WITH {V.HIST} "
I = f"WITH {V.INTER} "


@P.add("SELECT item_id, t AS title FROM (SELECT item_id, trim(regexp_replace(regexp_replace(replace(replace(title, '&quot;', '\"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM items WHERE title IS NOT NULL AND NOT contains(title, '<span id')) WHERE length(t) > 1 AND len(string_split(t, ' ')) <= 20")
def title_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").where("title IS NOT NULL AND NOT contains(title, '<span id')")
    rows = rows.select("item_id", X.clean_text(F.col("title")).alias("title"))
    return rows.where((F.length("title") > 1) & (F.size(F.split("title", " ")) <= 20))


@P.add("SELECT item_id, trim(regexp_replace(regexp_replace(replace(replace(coalesce(description, ''), '&quot;', '\"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM items")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_id", X.clean_text(F.col("description")).alias("cleaned"))


@P.add("""SELECT item_id, CASE WHEN d = '' THEN coalesce(title, '') ELSE d END AS description FROM (SELECT item_id, title,
 coalesce(list_sort(list_transform(list_filter(string_split(coalesce(description, ''), ';'), lambda x: trim(x) <> ''), lambda x: {'n': -length(trim(x)), 'x': trim(x)}))[1].x, '') AS d FROM items)""")
def description_pick(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_id", X.longest_part(F.split(F.coalesce("description", F.lit("")), ";"), F.coalesce("title", F.lit(""))).alias("description"))


@P.add("SELECT item_id, coalesce(try_cast(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE), 0.0) AS price FROM items")
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_id", X.price(F.col("price_text")).alias("price"))


@P.add("SELECT item_id, price, CASE WHEN p IS NOT NULL THEN coalesce(round((p - min(p) OVER ()) / nullif(max(p) OVER () - min(p) OVER (), 0), 6), 0.5) END AS value FROM (SELECT i.item_id, price, ln(1 + price) + ln(1 + coalesce(n, 0)) AS p FROM (SELECT item_id, coalesce(try_cast(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE), 0.0) AS price FROM items) i LEFT JOIN (SELECT item_id, count(*) AS n FROM interactions GROUP BY 1) c USING (item_id))")
def item_value_minmax(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "interactions").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "items").select("item_id", X.price(F.col("price_text")).alias("price")).join(counts, "item_id", "left")
    rows = rows.withColumn("p", F.log1p("price") + F.log1p(F.coalesce("n", F.lit(0))))
    return S.min_max(rows, "p", "value").select("item_id", "price", F.round("value", 6).alias("value"))


@P.add(I + f"SELECT user_id, item_id, rating, ts FROM inter WHERE ts BETWEEN {LO} AND {HI}")
def time_window_filter(spark: SparkSession, d: str) -> DataFrame:
    return V.inter(spark, d).where(F.col("ts").between(LO, HI))


@P.add(I + ", w AS (SELECT min(y) AS y FROM (SELECT 0 AS y WHERE (SELECT count(DISTINCT item_id) FROM inter WHERE ts >= 1530000000) >= 300 UNION ALL SELECT 1 WHERE (SELECT count(DISTINCT item_id) FROM inter WHERE ts >= 1530000000 - 31536000) >= 300 UNION ALL SELECT 2)) SELECT y AS widened, count(*) AS n_rows, count(DISTINCT item_id) AS n_items FROM inter, w WHERE ts >= 1530000000 - y * 31536000 GROUP BY 1")
def adaptive_time_window(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(V.inter(spark, d).select("item_id", "ts"), "inter")
    for y in range(3):
        inside = rows.where(F.col("ts") >= 1_530_000_000 - y * 31_536_000)
        if y == 2 or inside.select("item_id").distinct().count() >= 300:
            break
    return inside.agg(F.lit(y).alias("widened"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("item_id").alias("n_items"))


@P.add(I + "SELECT user_id, inter.item_id, ts, title, item_sid AS sid FROM inter JOIN items USING (item_id)")
def item_dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "items").select("item_id", "title", F.col("item_sid").alias("sid"))
    return V.inter(spark, d).join(dim, "item_id").select("user_id", "item_id", "ts", "title", "sid")


@P.add("SELECT DISTINCT item_id FROM interactions WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM items WHERE title IS NOT NULL AND trim(title) <> '')")
def anti_join_untitled(spark: SparkSession, d: str) -> DataFrame:
    titled = table(spark, d, "items").where("trim(title) <> ''").select("item_id")
    return table(spark, d, "interactions").where("item_id IS NOT NULL").select("item_id").distinct().join(titled, "item_id", "left_anti")


@P.add(I + "SELECT user_id, item_id, ts, rating FROM inter")
def review_dict(spark: SparkSession, d: str) -> DataFrame:
    return V.inter(spark, d).select("user_id", "item_id", "ts", "rating")


_K = 5
_ROUND = "r{b} AS (SELECT * FROM r{a} WHERE user_id IN (SELECT user_id FROM r{a} GROUP BY 1 HAVING count(*) >= 5) AND item_id IN (SELECT item_id FROM r{a} GROUP BY 1 HAVING count(*) >= 5))"


@P.add(I + ", r0 AS (SELECT * FROM inter), " + ", ".join(_ROUND.format(a=i, b=i + 1) for i in range(14)) + " SELECT user_id, item_id, ts, rating FROM r14")
def kcore(spark: SparkSession, d: str) -> DataFrame:
    return S.kcore(V.inter(spark, d), _K)[0].select("user_id", "item_id", "ts", "rating")


@P.add(I + "SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, round(count(*)::DOUBLE / greatest(1, count(DISTINCT user_id) * count(DISTINCT item_id)), 9) AS density FROM inter")
def dataset_density(spark: SparkSession, d: str) -> DataFrame:
    rows = V.inter(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"))
    return rows.withColumn("density", F.round(F.col("n") / F.greatest(F.lit(1), F.col("n_users") * F.col("n_items")), 9))


@P.add(I + "SELECT user_id, list(item_id ORDER BY ts, item_id) AS items, count(*) AS n FROM inter GROUP BY 1")
def user_sequence(spark: SparkSession, d: str) -> DataFrame:
    return S.user_sequence(V.inter(spark, d))


@P.add(H + "SELECT user_id, item_id, ts, history FROM hist")
def sliding_history(spark: SparkSession, d: str) -> DataFrame:
    return S.sliding_history(V.inter(spark, d))


@P.add(H + "SELECT user_id, item_id, ts, split FROM hist")
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return V.hist(spark, d).select("user_id", "item_id", "ts", "split")


@P.add(I + "SELECT item_id, row_number() OVER (ORDER BY f, item_id) - 1 AS id FROM (SELECT item_id, min(ts) AS f FROM inter GROUP BY 1)")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_ids(V.inter(spark, d), "item_id", ["ts"])


@P.add(I + ", n AS (SELECT count(*) AS n FROM inter), o AS (SELECT user_id, item_id, ts, row_number() OVER (ORDER BY ts, user_id, item_id) AS rn FROM inter) SELECT shard, count(*) AS n_rows, min(ts) AS first_ts FROM (SELECT *, (rn * 7 - 1) // n AS shard FROM o, n) GROUP BY 1")
def row_range_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = S.row_range_shards(V.inter(spark, d), ["ts", "user_id", "item_id"], 7)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"))


@P.add("SELECT user_id, bucket, CASE WHEN bucket < 60 THEN 'fit' WHEN bucket < 80 THEN 'select' ELSE 'gate' END AS split FROM (SELECT user_id, (('0x' || substr(sha256('split:42:' || user_id), 1, 16))::UBIGINT % 100)::INT AS bucket FROM (SELECT DISTINCT user_id FROM interactions WHERE user_id IS NOT NULL))")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return S.hash_split(table(spark, d, "interactions").select("user_id").where("user_id IS NOT NULL").distinct(), F.col("user_id"))


@P.add("SELECT user_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || user_id)) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'fit' ELSE 'select' END AS part FROM (SELECT DISTINCT user_id FROM interactions WHERE user_id IS NOT NULL)")
def hash_order_split(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "interactions").select("user_id").where("user_id IS NOT NULL").distinct()
    return S.hash_order_split(users, F.col("user_id"), 0.7).select("user_id", "part")


POP = """, tc AS (SELECT item_id, count(*) AS n FROM hist WHERE split = 'train' GROUP BY 1), hc AS (SELECT i AS item_id, count(*) AS n FROM (SELECT unnest(history) AS i FROM hist WHERE split = 'train') GROUP BY 1),
pop AS (SELECT coalesce(tc.item_id, hc.item_id) AS item_id, coalesce(tc.n, 0) AS target_n, coalesce(hc.n, 0) AS history_n, coalesce(tc.n, 0) + coalesce(hc.n, 0) AS n FROM tc FULL JOIN hc ON tc.item_id = hc.item_id)"""


def popularity(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, target_n, history_n, n): how often each item is a target or in a history of the training split."""
    rows = V.hist(spark, d).where("split = 'train'")
    targets = rows.select("item_id", F.lit(1).alias("t"), F.lit(0).alias("h"))
    histories = rows.select(F.explode("history").alias("item_id"), F.lit(0).alias("t"), F.lit(1).alias("h"))
    sums = targets.unionByName(histories).groupBy("item_id").agg(F.sum("t").alias("target_n"), F.sum("h").alias("history_n"))
    return sums.withColumn("n", F.col("target_n") + F.col("history_n"))


@P.add(H + POP + " SELECT * FROM pop")
def train_popularity(spark: SparkSession, d: str) -> DataFrame:
    return popularity(spark, d)


GROUPS = ", grp AS (SELECT item_id, n, CASE WHEN rn <= greatest(1, floor(c * 0.2::DOUBLE)) THEN 'head' WHEN rn > c - least(greatest(1, floor(c * 0.2::DOUBLE)), c - greatest(1, floor(c * 0.2::DOUBLE))) THEN 'tail' ELSE 'mid' END AS grp FROM (SELECT i.item_id, coalesce(p.n, 0) AS n, row_number() OVER (ORDER BY coalesce(p.n, 0) DESC, i.item_id) AS rn, count(*) OVER () AS c FROM items i LEFT JOIN pop p ON p.item_id = i.item_id))"


def item_groups(spark: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    known = popularity(spark, d) if counts is None else counts
    counts = table(spark, d, "items").select("item_id").join(known.select("item_id", "n"), "item_id", "left").fillna(0, ["n"])
    return S.popularity_groups(counts, 0.2, 0.2)


@P.add(H + POP + GROUPS + " SELECT item_id, n, grp FROM grp")
def popularity_groups(spark: SparkSession, d: str) -> DataFrame:
    return item_groups(spark, d)


@P.add(H + ", m AS (SELECT quantile_cont(len(history), 0.5) AS m FROM hist) SELECT CASE WHEN len(history) <= m THEN 'short' ELSE 'long' END AS grp, count(*) AS n, min(len(history)) AS shortest, max(len(history)) AS longest FROM hist, m GROUP BY 1")
def history_length_group(spark: SparkSession, d: str) -> DataFrame:
    rows = V.hist(spark, d).select(F.size("history").alias("len"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.percentile("len", 0.5).alias("m"))))
    return rows.groupBy(F.when(F.col("len") <= F.col("m"), "short").otherwise("long").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


@P.add(I + "SELECT user_id, round(avg(rating), 6) AS mean, CASE WHEN avg(rating) > 4.5 THEN 'HIGH' WHEN avg(rating) > 3.5 THEN 'MID' ELSE 'LOW' END AS bucket FROM inter GROUP BY 1")
def user_rating_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = V.inter(spark, d).groupBy("user_id").agg(F.avg("rating").alias("m"))
    return rows.select("user_id", F.round("m", 6).alias("mean"), F.when(F.col("m") > 4.5, "HIGH").when(F.col("m") > 3.5, "MID").otherwise("LOW").alias("bucket"))


@P.add(H + "SELECT user_id, item_id, ts, history FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY len(history) DESC, ts, item_id) = 1")
def longest_history_per_user(spark: SparkSession, d: str) -> DataFrame:
    best = F.min_by(F.struct("item_id", "ts", "history"), F.struct(-F.size("history"), "ts", "item_id"))
    return V.hist(spark, d).groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


@P.add(H + "SELECT split, count(DISTINCT user_id) AS n_users, count(DISTINCT CASE WHEN user_id NOT IN (SELECT user_id FROM hist WHERE split = 'train') THEN user_id END) AS new_users, count(DISTINCT item_id) AS n_targets, count(DISTINCT CASE WHEN item_id NOT IN (SELECT item_id FROM hist WHERE split = 'train') THEN item_id END) AS new_targets FROM hist WHERE split <> 'train' GROUP BY 1")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(V.hist(spark, d).select("user_id", "item_id", "split"), "hist")
    train = rows.where("split = 'train'")
    rest = rows.where("split <> 'train'")
    rest = rest.join(train.select("user_id", F.lit(True).alias("u")).distinct(), "user_id", "left").join(train.select("item_id", F.lit(True).alias("i")).distinct(), "item_id", "left")
    new = lambda c, flag: F.countDistinct(F.when(F.col(flag).isNull(), F.col(c)))
    return rest.groupBy("split").agg(F.countDistinct("user_id").alias("n_users"), new("user_id", "u").alias("new_users"), F.countDistinct("item_id").alias("n_targets"), new("item_id", "i").alias("new_targets"))


@P.add("SELECT count(*) AS n_rows, count_if(user_id IS NULL) AS null_users, count_if(item_id IS NULL) AS null_items, count_if(overall IS NULL) AS null_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, min(unixreviewtime) AS first_ts, max(unixreviewtime) AS last_ts FROM interactions")
def column_inventory(spark: SparkSession, d: str) -> DataFrame:
    null = lambda c: F.count_if(F.col(c).isNull())
    return table(spark, d, "interactions").agg(
        F.count(F.lit(1)).alias("n_rows"), null("user_id").alias("null_users"), null("item_id").alias("null_items"), null("overall").alias("null_ratings"),
        F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), F.min("unixreviewtime").alias("first_ts"), F.max("unixreviewtime").alias("last_ts"),
    )


@P.add(I + "SELECT 'raw' AS kind, overall AS rating, count(*) AS n FROM interactions GROUP BY 2 UNION ALL SELECT 'clean', rating, count(*) FROM inter GROUP BY 2")
def rating_distribution(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "interactions").select(F.lit("raw").alias("kind"), F.col("overall").alias("rating"))
    return raw.unionByName(V.inter(spark, d).select(F.lit("clean").alias("kind"), "rating")).groupBy("kind", "rating").agg(F.count(F.lit(1)).alias("n"))


@P.add(H + ", u AS (SELECT split, unnest([{'metric': 'length', 'value': CASE WHEN len(history) <= 3 THEN 'short' ELSE 'long' END}, {'metric': 'repeat', 'value': CASE WHEN list_contains(history, item_id) THEN 'yes' ELSE 'no' END}]) AS x FROM hist) SELECT split, x.metric AS metric, x.value AS value, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split, x.metric), 6) AS rate FROM u GROUP BY 1, 2, 3")
def split_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = V.hist(spark, d)
    length = F.struct(F.lit("length").alias("metric"), F.when(F.size("history") <= 3, "short").otherwise("long").alias("value"))
    repeat = F.struct(F.lit("repeat").alias("metric"), F.when(F.array_contains("history", F.col("item_id")), "yes").otherwise("no").alias("value"))
    rows = rows.select("split", F.explode(F.array(length, repeat)).alias("x")).groupBy("split", "x.metric", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split", "metric")), 6))


@P.add("SELECT a AS item_a, b AS item_b, count(*) AS n FROM (SELECT DISTINCT x.sample_id, x.i AS a, y.i AS b FROM (SELECT sample_id, unnest(list_append(coalesce(history_item_id, []), target_item_id)) AS i FROM candidate_samples) x JOIN (SELECT sample_id, unnest(list_append(coalesce(history_item_id, []), target_item_id)) AS i FROM candidate_samples) y ON x.sample_id = y.sample_id AND x.i <> y.i) GROUP BY 1, 2")
def cooccurrence_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Items of one basket (history and target of a sample), in both directions."""
    return cooccurrences(baskets(spark, d), "sample_id", "items")


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, items): the history of each sample with its target."""
    whole = F.array_append(F.coalesce("history_item_id", F.array().cast("array<bigint>")), F.col("target_item_id"))
    return table(spark, d, "candidate_samples").select("sample_id", whole.alias("items"))


@P.add("SELECT row_id, user_id, item_id, history AS last3, history[-1] AS last_item FROM (SELECT 0 AS row_id, user_id, item_id, history[-3:] AS history, ts FROM (" + "SELECT user_id, item_id, ts, history FROM (" + H + "SELECT * FROM hist)" + "))")
def last_n_window(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("history")
    return V.hist(spark, d).select(F.lit(0).alias("row_id"), "user_id", "item_id", F.slice(h, F.greatest(-F.size(h), F.lit(-3)), F.lit(3)).alias("last3"), F.element_at(h, -1).alias("last_item"))


@P.add(H + "SELECT user_id, item_id, ts, list_concat(history[-5:], list_resize([]::BIGINT[], 5 - len(history[-5:]), 0)) AS padded FROM hist")
def right_pad(spark: SparkSession, d: str) -> DataFrame:
    tail = F.slice("history", F.greatest(-F.size("history"), F.lit(-5)), F.lit(5))
    return V.hist(spark, d).select("user_id", "item_id", "ts", F.concat(tail, F.array_repeat(F.lit(0).cast("bigint"), 5 - F.size(tail))).alias("padded"))


@P.add(I + ", s AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS x FROM inter GROUP BY 1 HAVING count(*) >= 2) SELECT user_id, x[-11:][:-2] AS inputs, x[-11:][2:] AS targets FROM s")
def shifted_sequence(spark: SparkSession, d: str) -> DataFrame:
    x = F.slice("items", F.greatest(-F.size("items"), F.lit(-11)), F.lit(11))
    return S.user_sequence(V.inter(spark, d)).where("n >= 2").select("user_id", F.slice(x, F.lit(1), F.size(x) - 1).alias("inputs"), F.slice(x, F.lit(2), F.size(x) - 1).alias("targets"))


@P.add(H + "SELECT split, user_id, item_id, ts, row_number() OVER (PARTITION BY split ORDER BY ts, user_id, item_id) - 1 AS ordinal FROM hist")
def split_ordinal(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = S.global_rank(V.hist(spark, d), ["ts", "user_id", "item_id"])
    first = rows.groupBy("split").agg(F.min("rn").alias("first"))
    return rows.join(F.broadcast(first), "split").select("split", "user_id", "item_id", "ts", (F.col("rn") - F.col("first")).alias("ordinal"))


@P.add(H + "SELECT count_if(history[-1] = item_id) AS n_dedup, count_if(len(history) >= 2) AS n_long, count(*) AS n FROM hist")
def history_predicates(spark: SparkSession, d: str) -> DataFrame:
    return V.hist(spark, d).agg(F.count_if(F.element_at("history", -1) == F.col("item_id")).alias("n_dedup"), F.count_if(F.size("history") >= 2).alias("n_long"), F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = P.queries, P.oracle
