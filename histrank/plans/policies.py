"""Policies that order the candidates of the streams, their evaluation side by side, training pairs, and views of one list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histrank.functions import text as X
from histrank.operators import alignment as A
from histrank.operators import fusion as U
from histrank.operators import metrics as M
from histrank.plans.base import Plans
from histrank.plans.data import GROUPS, POP, item_groups, popularity
from histrank.plans.ranking import HG, R, Z, streams
from histrank.session import materialize, table
from histrank.sources import views as V

P = Plans()
# Settings of source-aware fusion, numbers of exclusive items, and positions of the boundary.
WEIGHTS, BONUSES = (0.1, 0.25, 0.5, 0.75, 1.0), (0.0, 0.01)
EXCLUSIVE = {"cf_only": 0, "exclusive_top5": 5, "exclusive_top10": 10, "exclusive_top20": 20, "all_exclusive": 10**12}
GRID = {f"source_aware_rrf_{w}_{b}": (w, b) for w in WEIGHTS for b in BONUSES}
FORBIDDEN = ("target", "label", "is_correct", "post_ranking", "outcome")


def _rrf(z: DataFrame, w: float, b: float) -> DataFrame:
    return U.source_aware_rrf(z, w, b).select("q", "item", "rank", "cf")


def _union(z: DataFrame, n: int) -> DataFrame:
    return U.ordered_union(z, exclusive=n).select("q", "item", "rank", "cf")


#: A function from the streams (q, item, cf, direct, ...) to the order (q, item, rank, cf) for each policy by name; callers may add their own.
POLICIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "direct_only": lambda z: z.where("direct IS NOT NULL").select("q", "item", F.col("direct").alias("rank"), "cf"),
    **{name: lambda z, n=n: _union(z, n) for name, n in EXCLUSIVE.items()},
    **{name: lambda z, w=w, b=b: _rrf(z, w, b) for name, (w, b) in GRID.items()},
}


def policy_order(z: DataFrame, policy: str) -> DataFrame:
    """(q, item, rank, cf) by the policy of that name; an unknown one is an error."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    return POLICIES[policy](z)


def guard_features(names: list[str]) -> list[str]:
    """names, or an error if one tells of the outcome (contains a word of FORBIDDEN)."""
    if bad := [n for n in names if any(part in n.lower() for part in FORBIDDEN)]:
        raise ValueError(f"features that leak the outcome: {bad}")
    return names


@P.add(Z + "SELECT q, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cf NULLS LAST, direct NULLS LAST) - 1 AS rank, count(cf) OVER (PARTITION BY q) AS ncf FROM z) WHERE rank < ncf + 10")
def policy_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return policy_order(streams(spark, d), "exclusive_top10").select("q", "item", "rank")


_CONFIGS = ", ".join(f"('{n}', {x})" for n, x in EXCLUSIVE.items())
_SETTINGS = ", ".join(f"('{n}', {w}::DOUBLE, {b}::DOUBLE)" for n, (w, b) in GRID.items())


@P.add(Z + f""", {V.TRUTH}, cu(config, ex) AS (VALUES {_CONFIGS}), cr(config, w, b) AS (VALUES {_SETTINGS}),
u AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cf NULLS LAST, direct NULLS LAST) - 1 AS rank, count(cf) OVER (PARTITION BY q) AS ncf FROM z),
s AS (SELECT *, coalesce(1.0::DOUBLE / (cf + 61), 0.0::DOUBLE) + coalesce(w / (direct + 61), 0.0::DOUBLE) + CASE WHEN both_ THEN b ELSE 0 END AS fused FROM e, cr),
o AS (SELECT config, q, item, rank, cf FROM u, cu WHERE rank < ncf + ex UNION ALL SELECT 'direct_only', q, item, direct, cf FROM z WHERE direct IS NOT NULL
  UNION ALL SELECT config, q, item, row_number() OVER (PARTITION BY config, q ORDER BY round(fused, 12) DESC, low, item) - 1, cf FROM s),
m AS (SELECT config, count(*) AS n_candidates, count_if(item = target) AS in_pool, count_if(item = target AND rank < 20) AS hits20, count_if(cf IS NULL) AS added, count_if(cf IS NULL AND item = target) AS added_hits,
  count_if(item = target AND rank < 20 AND cf < 20) AS preserved, max(rank) + 1 AS largest FROM o JOIN truth USING (q) GROUP BY 1),
n AS (SELECT count(*) AS n FROM truth), h AS (SELECT count(*) AS cf_hits FROM z JOIN truth USING (q) WHERE item = target AND cf < 20)
SELECT config, n.n AS n, n_candidates, in_pool, hits20, round(hits20::DOUBLE / n.n, 6) AS hr20, round(n_candidates::DOUBLE / n.n, 6) AS mean_size, largest, preserved, cf_hits - preserved AS lost, added, added_hits,
  round(coalesce((n_candidates - in_pool)::DOUBLE / nullif(n_candidates, 0), 0), 6) AS noise, round(coalesce((added - added_hits)::DOUBLE / nullif(added, 0), 0), 6) AS added_noise FROM m, n, h""")
def policy_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every policy's hits, sizes, preserved and lost hits of cf, and shares of candidates that aren't the target."""
    z = materialize(U.either(streams(spark, d)).select("q", "item", "cf", "direct", "both", "low"), "streams")
    truth = V.truth(spark, d)
    grid = list(GRID.values())

    def fused(at: str, w: float, b: float) -> Column:
        score = F.coalesce(F.lit(1.0) / (F.col(f"{at}cf") + 61), F.lit(0.0)) + F.coalesce(F.lit(w) / (F.col(f"{at}direct") + 61), F.lit(0.0)) + F.when(F.col(f"{at}both"), F.lit(b)).otherwise(0.0)
        return F.round(score, 12)

    # An order counts for its size and the target's place only, which is the number of candidates before it: no list is ordered.
    # Merge joins, as the estimated size of z falls short of what a broadcast of it holds in the driver.
    found = z.hint("merge").join(truth.withColumnRenamed("target", "item"), ["q", "item"])
    found = found.select("q", *[F.col(c).alias(f"t_{c}") for c in ("item", "cf", "direct", "both", "low")])
    found = found.select("q", "t_item", "t_cf", "t_direct", "t_low", *[fused("t_", w, b).alias(f"t_{i}") for i, (w, b) in enumerate(grid)])
    rows = z.hint("merge").join(truth.select("q").hint("merge").join(found, "q", "left"), "q")
    new, tie = F.col("cf").isNull(), (F.col("low") < F.col("t_low")) | ((F.col("low") == F.col("t_low")) & (F.col("item") < F.col("t_item")))
    ahead = [F.count_if((fused("", w, b) > F.col(f"t_{i}")) | ((fused("", w, b) == F.col(f"t_{i}")) & tie)).alias(f"p_{i}") for i, (w, b) in enumerate(grid)]
    # by struct(q), as a shuffle of sums after the join lets AQE split a query of many rows
    sums = rows.groupBy(F.struct("q"), "t_item", "t_cf", "t_direct").agg(
        F.count(F.lit(1)).alias("n"), F.count("cf").alias("ncf"), F.count("direct").alias("nd"), F.count_if(new).alias("nx"), F.count_if(new & (F.col("direct") < F.col("t_direct"))).alias("nth"), *ahead
    )
    hit, far = F.col("t_item").isNotNull(), F.coalesce("t_cf", F.col("ncf") + F.col("nth"))

    def policy(name: str, size: Column, added: Column, inside: Column, place: Column) -> Column:
        return F.struct(F.lit(name).alias("config"), size.alias("size"), added.alias("added"), F.coalesce(inside, F.lit(False)).alias("inside"), place.cast("bigint").alias("place"))

    most = {name: F.lit(x).cast("bigint") for name, x in EXCLUSIVE.items()}
    each = [policy(name, F.col("ncf") + F.least("nx", x), F.least("nx", x), hit & (far < F.col("ncf") + x), far) for name, x in most.items()]
    each.append(policy("direct_only", F.col("nd"), F.col("nx"), F.col("t_direct").isNotNull(), F.col("t_direct")))
    each += [policy(name, F.col("n"), F.col("nx"), hit, F.col(f"p_{i}")) for i, name in enumerate(GRID)]
    orders = sums.select("t_cf", F.explode(F.array(*each)).alias("c")).select("t_cf", "c.*")
    hit20, own = F.col("inside") & (F.col("place") < 20), F.coalesce(F.col("t_cf") < 20, F.lit(False))
    m = orders.groupBy("config").agg(
        F.sum("size").alias("n_candidates"), F.count_if("inside").alias("in_pool"), F.count_if(hit20).alias("hits20"), F.sum("added").alias("added"), F.count_if(F.col("inside") & F.col("t_cf").isNull()).alias("added_hits"),
        F.count_if(hit20 & own).alias("preserved"), F.max("size").alias("largest"), F.count_if(own).alias("cf_hits"),
    ).where("n_candidates > 0")
    m = m.crossJoin(F.broadcast(truth.agg(F.count(F.lit(1)).alias("n"))))
    return m.select(
        "config", "n", "n_candidates", "in_pool", "hits20", M.rate(F.col("hits20"), F.col("n")).alias("hr20"), M.rate(F.col("n_candidates"), F.col("n")).alias("mean_size"), "largest", "preserved",
        (F.col("cf_hits") - F.col("preserved")).alias("lost"), "added", "added_hits",
        M.rate(F.col("n_candidates") - F.col("in_pool"), F.col("n_candidates")).alias("noise"), M.rate(F.col("added") - F.col("added_hits"), F.col("added")).alias("added_noise"),
    )


@P.add(Z + f""", {V.TRUTH}, x AS (SELECT t.q, t.target, a.cf, a.direct FROM truth t JOIN z a ON a.q = t.q AND a.item = t.target),
d AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY direct) AS nth FROM z WHERE cf IS NULL)
SELECT x.q, x.target AS direct_item, b.item AS boundary_item, b.cf AS boundary, 1 AS label FROM x JOIN z b ON b.q = x.q AND b.cf BETWEEN 10 AND 19 WHERE x.cf IS NULL
UNION ALL SELECT x.q, d.item, x.target, x.cf, 0 FROM x JOIN d ON d.q = x.q AND nth <= 5 WHERE x.cf < 20""")
def promotion_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs: a target that only the direct stream has against the cf items at places 10 to 19 (label 1), and
    the first five direct-only items against a target within the first 20 of cf (label 0)."""
    z = streams(spark, d).select("q", "item", "cf", "direct")
    x = z.join(V.truth(spark, d), "q").where("item = target").select("q", "target", F.col("cf").alias("own"))
    tail = z.where("cf BETWEEN 10 AND 19").select("q", F.col("item").alias("boundary_item"), F.col("cf").alias("boundary"))
    up = x.where("own IS NULL").join(tail, "q").select("q", F.col("target").alias("direct_item"), "boundary_item", "boundary", F.lit(1).alias("label"))
    few = U.first_places(z.where("cf IS NULL"), 5, F.col("direct")).select("q", F.col("item").alias("direct_item"))
    keep = x.where("own < 20").join(few, "q").select("q", "direct_item", F.col("target").alias("boundary_item"), F.col("own").alias("boundary"), F.lit(0).alias("label"))
    return up.unionByName(keep)


@P.add(f"WITH {V.RANKED} SELECT k, q, item, rank FROM ranked, (SELECT unnest([20, 50, 100]) AS k) WHERE stream = 'direct' AND rank < k")
def prefix_views(spark: SparkSession, d: str) -> DataFrame:
    """The views of 20, 50 and 100 items as prefixes of one list."""
    rows = V.ranked(spark, d).where("stream = 'direct'").select("q", "item", "rank")
    return M.with_k(rows, (20, 50, 100)).where("rank < k").select("k", "q", "item", "rank")


_FAMILIES = "(VALUES ('popularity', 'head'), ('popularity', 'mid'), ('popularity', 'tail'), ('cold_warm', 'cold'), ('cold_warm', 'warm'), ('history_length', 'short'), ('history_length', 'long'))"


@P.add(HG + f""", l AS (SELECT sample_id AS q, max(coalesce(len(history_item_id), 0)) AS len FROM candidate_samples WHERE sample_id IS NOT NULL GROUP BY 1),
x AS (SELECT r.q, r.cf, coalesce(g.grp, CASE WHEN coalesce(p.n, 0) = 0 THEN 'tail' ELSE 'mid' END) AS pg, CASE WHEN coalesce(p.n, 0) = 0 THEN 'cold' ELSE 'warm' END AS cw, coalesce(l.len, 0) AS len
  FROM ranks r LEFT JOIN grp g ON g.item_id = r.target LEFT JOIN pop p ON p.item_id = r.target LEFT JOIN l ON l.q = r.q),
md AS (SELECT quantile_cont(len, 0.5) AS m FROM x),
u AS (SELECT 'popularity' AS family, pg AS grp, cf FROM x UNION ALL SELECT 'cold_warm', cw, cf FROM x UNION ALL SELECT 'history_length', CASE WHEN len <= m THEN 'short' ELSE 'long' END, cf FROM x, md),
f(family, grp) AS {_FAMILIES}
SELECT f.family, f.grp, k, count(u.family) AS n, round(coalesce(count_if(cf < k)::DOUBLE / nullif(count(u.family), 0), 0), 6) AS hr, round(coalesce(sum(CASE WHEN cf < k THEN 1 / log2(cf + 2) ELSE 0 END) / nullif(count(u.family), 0), 0), 6) AS ndcg
FROM f CROSS JOIN (SELECT unnest([1, 5, 10, 20, 50]) AS k) LEFT JOIN u ON u.family = f.family AND u.grp = f.grp GROUP BY 1, 2, 3""")
def group_family_metrics(spark: SparkSession, d: str) -> DataFrame:
    """HR and NDCG by popularity, cold or warm target, and length of the history, with groups that are empty."""
    ks = (1, 5, 10, 20, 50)
    counts = materialize(popularity(spark, d), "popularity")
    groups = item_groups(spark, d, counts)
    lengths = table(spark, d, "candidate_samples").where("sample_id IS NOT NULL").groupBy(F.col("sample_id").alias("q")).agg(F.max(F.coalesce(F.array_size("history_item_id"), F.lit(0))).alias("len"))
    cold = F.coalesce("n", F.lit(0)) == 0
    rows = V.ranks(spark, d).join(groups.select(F.col("item_id").alias("target"), "grp"), "target", "left").join(counts.select(F.col("item_id").alias("target"), "n"), "target", "left").join(lengths, "q", "left")
    rows = materialize(rows.select("cf", F.coalesce("grp", F.when(cold, "tail").otherwise("mid")).alias("pg"), F.when(cold, "cold").otherwise("warm").alias("cw"), F.coalesce("len", F.lit(0)).alias("len")), "grouped")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.percentile("len", 0.5).alias("m"))))
    pair = lambda family, grp: F.struct(F.lit(family).alias("family"), grp.alias("grp"))
    each = F.array(pair("popularity", F.col("pg")), pair("cold_warm", F.col("cw")), pair("history_length", F.when(F.col("len") <= F.col("m"), "short").otherwise("long")))
    long = rows.select("cf", F.explode(each).alias("u")).select("cf", "u.family", "u.grp")
    hit = M.within("cf")
    sums = M.with_k(long, ks).groupBy("family", "grp", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("h"), F.sum(F.when(hit, M.gain(F.col("cf"))).otherwise(0.0)).alias("g"))
    names = [("popularity", g) for g in ("head", "mid", "tail")] + [("cold_warm", g) for g in ("cold", "warm")] + [("history_length", g) for g in ("short", "long")]
    full = M.with_k(spark.createDataFrame(names, "family string, grp string"), ks).join(sums, ["family", "grp", "k"], "left").fillna(0, ["n", "h"]).fillna(0.0, ["g"])
    return full.select("family", "grp", "k", "n", M.rate(F.col("h"), F.col("n")).alias("hr"), M.rate(F.col("g"), F.col("n")).alias("ndcg"))


HIT = "CASE WHEN {r} IS NULL THEN 'missing_or_not_hit' WHEN {r} < 5 THEN 'rank_1_5' WHEN {r} < 10 THEN 'rank_6_10' WHEN {r} < 15 THEN 'rank_11_15' WHEN {r} < 20 THEN 'rank_16_20' ELSE 'rank_over_20' END"


@P.add(R + "SELECT q, " + HIT.format(r="cf") + " AS cf_bucket, " + HIT.format(r="direct") + " AS direct_bucket FROM ranks")
def hit_bucket(spark: SparkSession, d: str) -> DataFrame:
    """The narrower buckets of ranks."""
    return V.ranks(spark, d).select("q", M.hit_bucket(F.col("cf")).alias("cf_bucket"), M.hit_bucket(F.col("direct")).alias("direct_bucket"))


@P.add(f"""WITH {V.INTER}, {V.RANKED}, {V.TRUTH}, w AS (SELECT item_id, CASE WHEN max(rating) >= 4 THEN 'purchase' ELSE 'click' END AS kind, CASE WHEN max(rating) >= 4 THEN 1.0::DOUBLE ELSE 0.2 END AS reward FROM inter GROUP BY 1),
x AS (SELECT t.q, kind, reward, min(r.rank) AS rank FROM truth t JOIN w ON w.item_id = t.target LEFT JOIN ranked r ON r.q = t.q AND r.item = t.target AND r.stream = 'cf' GROUP BY 1, 2, 3)
SELECT kind, k, count(*) AS n, count(*) FILTER (WHERE rank < k) AS hits, round(avg(CASE WHEN rank < k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr, round(avg(CASE WHEN rank < k THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg, round(sum(CASE WHEN rank < k THEN reward ELSE 0 END), 4) AS total_reward
FROM x, (SELECT unnest([5, 10, 20]) AS k) GROUP BY 1, 2""")
def reward_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits and gains apart for targets of the two kinds of reward (0.2 for a click, 1.0 for a purchase), and the reward of the hits.

    An item whose best rating is 4 or more stands for a purchase, as the tables hold no kinds of events for items.
    """
    bought = F.coalesce(F.max("rating") >= 4, F.lit(False))
    kinds = V.inter(spark, d).groupBy(F.col("item_id").alias("target")).agg(F.when(bought, "purchase").otherwise("click").alias("kind"), F.when(bought, 1.0).otherwise(0.2).alias("reward"))
    rows = M.with_k(V.ranks(spark, d).join(kinds, "target"), (5, 10, 20))
    hit = M.within("cf")
    return rows.groupBy("kind", "k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("hr"), F.round(F.avg(F.when(hit, M.gain(F.col("cf"))).otherwise(0.0)), 6).alias("ndcg"),
        F.round(F.sum(F.when(hit, F.col("reward")).otherwise(0.0)), 4).alias("total_reward"),
    )


# strict joins


@P.add(f"WITH {V.TRUTH}, l AS (SELECT sample_id AS q, max(coalesce(len(history_item_id), 0)) AS len FROM candidate_samples WHERE sample_id IS NOT NULL AND target_item_id IS NOT NULL GROUP BY 1) SELECT q, target, len FROM truth JOIN l USING (q)")
def align_streams(spark: SparkSession, d: str) -> DataFrame:
    """Targets and lengths of histories, which must be there for the same queries with the same targets."""
    truth = V.truth(spark, d)
    rows = table(spark, d, "candidate_samples").where("sample_id IS NOT NULL AND target_item_id IS NOT NULL")
    other = rows.groupBy(F.col("sample_id").alias("q")).agg(F.max_by("target_item_id", F.struct("ingested_at", -F.col("target_item_id"))).alias("target"), F.max(F.coalesce(F.array_size("history_item_id"), F.lit(0))).cast("bigint").alias("len"))
    return A.align_strict(truth, other, "q", same=["target"])


@P.add("SELECT a.position, a.item_id, b.asin FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS position, item_id FROM items) a JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS position, asin FROM items) b USING (position)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Row i of one table with row i of another."""
    items = table(spark, d, "items")
    return A.zip_by_position(items.select("item_id"), ["item_id"], items.select(F.col("item_id").alias("k"), "asin"), ["k"]).select("position", "item_id", "asin")


@P.add("SELECT item_id, asin, title FROM items")
def one_to_one_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two tables joined on the first column that is unique in both (item_sid isn't, item_id is)."""
    items = table(spark, d, "items")
    return A.merge_one_to_one(items.select("item_sid", "item_id", "asin"), items.select("item_sid", "item_id", "title"), ["item_sid", "item_id"])[0].select("item_id", "asin", "title")


# cleaning


@P.add("SELECT item_id, array_to_string(list_filter(list_transform(list_concat([coalesce(item_type, '')], string_split(coalesce(title, ''), ' ')), lambda x: trim(x)), lambda x: NOT contains(x, '</span>')), ',') AS categories FROM items")
def category_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested categories (the type of an item, and the words of its title for those below it) as one text."""
    nested = F.array(F.array(F.coalesce("item_type", F.lit(""))), F.split(F.coalesce("title", F.lit("")), " "))
    return table(spark, d, "items").select("item_id", X.flat_categories(nested).alias("categories"))


@P.add("SELECT item_id, coalesce(nullif(asin, ''), nullif(title, ''), item_sid) AS image FROM items WHERE asin IS NOT NULL OR title IS NOT NULL OR item_sid IS NOT NULL")
def image_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """The best of the addresses that each image has (texts of the items stand for them)."""
    images = F.array(F.struct(F.col("asin").alias("hi_res"), F.col("title").alias("large"), F.col("item_sid").alias("thumb")))
    return table(spark, d, "items").where("asin IS NOT NULL OR title IS NOT NULL OR item_sid IS NOT NULL").select("item_id", F.get(X.image_urls(images), F.lit(0)).alias("image"))


@P.add("""SELECT item_id, array_to_string(list_transform(list_filter(list_zip(string_split(title, ' '), range(len(string_split(title, ' ')))), lambda x: ('0x' || substr(sha256(item_id || ':' || x[2]), 1, 8))::BIGINT > floor(0.2 * 4294967296)::BIGINT), lambda x: x[1]), ' ') AS title
FROM items WHERE title IS NOT NULL AND item_id IS NOT NULL""")
def word_drop(spark: SparkSession, d: str) -> DataFrame:
    """Titles less about a fifth of their words, chosen by hashes of item and position."""
    rows = table(spark, d, "items").where("title IS NOT NULL AND item_id IS NOT NULL")
    return rows.select("item_id", X.drop_words(F.col("title"), F.col("item_id"), 0.2).alias("title"))


@P.add("SELECT item_id FROM items WHERE trim(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]+>', '', 'g'), '(\\s|&nbsp;|&#160;|\\x{a0})+', ' ', 'g')) <> ''")
def title_filter_unescaped(spark: SparkSession, d: str) -> DataFrame:
    """Items whose title isn't empty once tags are gone and all entities are resolved."""
    return table(spark, d, "items").where(X.clean_text_unescaped(F.col("title")) != "").select("item_id")


@P.add("SELECT f AS feature, regexp_matches(lower(f), 'target|label|is_correct|post_ranking|outcome') AS leaks FROM (SELECT unnest(['cf_rank', 'Target_item', 'score', 'relabelled', 'outcome_7', 'bucket']) AS f)")
def feature_guard(spark: SparkSession, d: str) -> DataFrame:
    """Which names of features the guard refuses."""
    def refused(name: str) -> bool:
        try:
            return not guard_features([name])
        except ValueError:
            return True

    return spark.createDataFrame([(n, refused(n)) for n in ("cf_rank", "Target_item", "score", "relabelled", "outcome_7", "bucket")], "feature string, leaks boolean")


QUERIES, ORACLE = P.queries, P.oracle
