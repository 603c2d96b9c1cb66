"""Candidates, fusion, reranking and metrics on the streams of the candidates table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histrank.functions import sid as N
from histrank.operators import fusion as U
from histrank.operators import metrics as M
from histrank.plans.base import Plans
from histrank.plans.data import GROUPS, POP, item_groups, popularity
from histrank.session import materialize, table
from histrank.sources import views as V

P = Plans()
KS = (1, 5, 10, 20, 50)
KSQL = "(SELECT unnest([1, 5, 10, 20, 50]) AS k)"
R = f"WITH {V.RANKS} "
Z = f"WITH {V.RANKED}, z AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.item, b.item) AS item, a.rank AS cf, b.rank AS direct, a.source AS cf_source, b.source AS direct_source, a.level AS cf_level, a.bucket AS cf_bucket, b.bucket AS direct_bucket, a.score AS cf_score, b.score AS direct_score FROM (FROM ranked WHERE stream = 'cf') a FULL JOIN (FROM ranked WHERE stream = 'direct') b ON a.q = b.q AND a.item = b.item), e AS (SELECT *, cf IS NOT NULL AND direct IS NOT NULL AS both_, least(coalesce(cf, 1000000000000), coalesce(direct, 1000000000000)) + 1 AS low FROM z) "


def streams(spark: SparkSession, d: str) -> DataFrame:
    return U.both_streams(V.ranked(spark, d))


@P.add(Z + "SELECT q, item, cf, direct FROM z")
def candidate_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return streams(spark, d).select("q", "item", "cf", "direct")


@P.add(f"WITH {V.RANKED}, {V.TRUTH}, a AS (SELECT DISTINCT q FROM ranked WHERE stream = 'cf'), b AS (SELECT DISTINCT q FROM ranked WHERE stream = 'direct') SELECT count(*) AS n, count_if(a.q IS NOT NULL AND b.q IS NOT NULL) AS aligned, count_if(a.q IS NULL) AS no_cf, count_if(b.q IS NULL) AS no_direct FROM truth t LEFT JOIN a USING (q) LEFT JOIN b USING (q)")
def stream_align_strict(spark: SparkSession, d: str) -> DataFrame:
    has = V.ranked(spark, d).groupBy("q").agg(F.max((F.col("stream") == "cf").cast("int")).alias("a"), F.max((F.col("stream") == "direct").cast("int")).alias("b"))
    rows = V.truth(spark, d).join(has, "q", "left").fillna(0, ["a", "b"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") + F.col("b") == 2).alias("aligned"), F.count_if(F.col("a") == 0).alias("no_cf"), F.count_if(F.col("b") == 0).alias("no_direct"))


@P.add(Z + "SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY cf NULLS LAST, direct NULLS LAST) - 1 AS rank FROM z")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    return U.ordered_union(streams(spark, d)).select("q", "item", "rank")


@P.add(Z + ", l AS (SELECT *, row_number() OVER (PARTITION BY q, cf IS NULL ORDER BY direct) AS nth FROM z) SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY cf NULLS LAST, direct NULLS LAST) - 1 AS rank FROM l WHERE cf IS NOT NULL OR nth <= 3")
def ordered_union_limited(spark: SparkSession, d: str) -> DataFrame:
    return U.ordered_union(streams(spark, d), exclusive=3).select("q", "item", "rank")


@P.add(Z + "SELECT q, count_if(both_) AS common, count_if(cf IS NOT NULL AND direct IS NULL) AS cf_only, count_if(cf IS NULL) AS direct_only, round(count_if(both_)::DOUBLE / count(*), 6) AS jaccard FROM e GROUP BY 1")
def candidate_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = U.either(streams(spark, d))
    return rows.groupBy("q").agg(F.count_if("both").alias("common"), F.count_if(F.col("cf").isNotNull() & F.col("direct").isNull()).alias("cf_only"), F.count_if(F.col("cf").isNull()).alias("direct_only"), F.round(F.count_if("both") / F.count(F.lit(1)), 6).alias("jaccard"))


RRF = ", s AS (SELECT *, coalesce({w}::DOUBLE / (60::DOUBLE + cf + 1), 0.0::DOUBLE) + coalesce({v}::DOUBLE / (60::DOUBLE + direct + 1), 0.0::DOUBLE) AS fused FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(fused, 12) DESC, low, both_ DESC, item) - 1 AS rank FROM s) "
ZR = Z + RRF.format(w=0.5, v=0.5)


@P.add(ZR + "SELECT q, item, round(fused, 9) AS score, rank FROM f")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return U.rrf(streams(spark, d)).select("q", "item", F.round("fused", 9).alias("score"), "rank")


@P.add(Z + "SELECT q, item, round(1.0::DOUBLE / low, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY low, both_ DESC, cf NULLS LAST, direct NULLS LAST, item) - 1 AS rank FROM e")
def min_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return U.min_rank(streams(spark, d)).select("q", "item", F.round("fused", 9).alias("score"), "rank")


SA = ", s AS (SELECT *, coalesce(1.0::DOUBLE / (cf + 61), 0.0::DOUBLE) + coalesce({w}::DOUBLE / (direct + 61), 0.0::DOUBLE) + CASE WHEN both_ THEN {b}::DOUBLE ELSE 0 END AS fused FROM e) "


@P.add(Z + SA.format(w=0.5, b=0.02) + "SELECT q, item, round(fused, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY round(fused, 12) DESC, low, item) - 1 AS rank FROM s")
def source_aware_rrf(spark: SparkSession, d: str) -> DataFrame:
    return U.source_aware_rrf(streams(spark, d), 0.5, 0.02).select("q", "item", F.round("fused", 9).alias("score"), "rank")


@P.add(Z + f", {V.TRUTH}" + ", c AS (SELECT w, b FROM (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS w), (SELECT unnest([0.0::DOUBLE, 0.01]) AS b)), s AS (SELECT *, coalesce(1.0::DOUBLE / (cf + 61), 0.0::DOUBLE) + coalesce(w / (direct + 61), 0.0::DOUBLE) + CASE WHEN both_ THEN b ELSE 0 END AS fused FROM e, c), o AS (SELECT *, row_number() OVER (PARTITION BY w, b, q ORDER BY round(fused, 12) DESC, low, item) - 1 AS rank FROM s) SELECT w, b, count(*) AS n, round(avg(CASE WHEN rank < 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr20, round(avg(CASE WHEN rank < 20 THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg20 FROM (SELECT c.w, c.b, t.q, o.rank FROM truth t CROSS JOIN c LEFT JOIN o ON o.q = t.q AND o.item = t.target AND o.w = c.w AND o.b = c.b) GROUP BY 1, 2")
def fusion_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All settings of source-aware fusion in one job: rows of the streams times a fixed list of settings."""
    grid = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(b).alias("b")) for w in (0.1, 0.25, 0.5, 0.75, 1.0) for b in (0.0, 0.01)])
    rows = U.either(streams(spark, d)).withColumn("c", F.explode(grid)).select("*", "c.w", "c.b")
    score = F.coalesce(F.lit(1.0) / (F.col("cf") + 61), F.lit(0.0)) + F.coalesce(F.col("w") / (F.col("direct") + 61), F.lit(0.0)) + F.when(F.col("both"), F.col("b")).otherwise(0.0)
    first = U.first_places(rows, 20, F.desc(F.round(score, 12)), F.col("low"), F.col("item"), by=("w", "b", "q"))
    found = first.select("q", F.col("item").alias("target"), "w", "b", "rank")
    wanted = V.truth(spark, d).withColumn("c", F.explode(grid)).select("q", "target", "c.w", "c.b")
    hit = F.coalesce(F.col("rank") < 20, F.lit(False))
    return wanted.join(found, ["q", "target", "w", "b"], "left").groupBy("w", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("hr20"), F.round(F.avg(F.when(hit, M.gain(F.col("rank"))).otherwise(0.0)), 6).alias("ndcg20"))


@P.add(Z + "SELECT q, item, CASE WHEN p >= o THEN cf_source ELSE direct_source END AS source, CASE WHEN direct_bucket IS NULL THEN cb WHEN cb > 1 THEN least(cb, direct_bucket::DOUBLE) ELSE direct_bucket::DOUBLE END AS bucket FROM (SELECT *, coalesce(cf_bucket::DOUBLE, 1.0) AS cb, CASE WHEN cf_source = 'exact' THEN 3 WHEN cf_source IN ('prefix@4', 'prefix@3') THEN 2 WHEN cf_source IN ('prefix@2', 'prefix@1') THEN 1 WHEN cf_source IS NOT NULL THEN 0 ELSE -1 END AS p, CASE WHEN direct_source IS NULL THEN -1 ELSE 0 END AS o FROM z)")
def best_source(spark: SparkSession, d: str) -> DataFrame:
    return U.best_source(streams(spark, d)).select("q", "item", "source", "bucket")


W = {"reciprocal_text_rank": 1.0, "reciprocal_cf_rank": 0.6, "both_sources": 0.3, "fusion_score": 5.0, "min_source_rank": -0.01}
FEAT = ZR + """, n AS (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM f), m AS (SELECT *, coalesce(cf + 1, n + 1) AS t, coalesce(direct + 1, n + 1) AS c FROM n),
feat AS (SELECT q, item, rank AS fusion_order, (cf IS NOT NULL)::INT::DOUBLE AS text_present, (direct IS NOT NULL)::INT::DOUBLE AS cf_present, both_::INT::DOUBLE AS both_sources, (direct IS NULL)::INT::DOUBLE AS text_only, (cf IS NULL)::INT::DOUBLE AS cf_only, ((cf IS NOT NULL)::INT + (direct IS NOT NULL)::INT)::DOUBLE AS source_count,
 t::DOUBLE AS text_rank_filled, c::DOUBLE AS cf_rank_filled, least(t, c)::DOUBLE AS min_source_rank, (rank + 1)::DOUBLE AS fusion_rank, coalesce(1.0::DOUBLE / (cf + 1), 0) AS reciprocal_text_rank, coalesce(1.0::DOUBLE / (direct + 1), 0) AS reciprocal_cf_rank, 1.0::DOUBLE / least(t, c) AS reciprocal_min_source_rank, 1.0::DOUBLE / (rank + 1) AS reciprocal_fusion_rank, fused AS fusion_score FROM m) """


def features(spark: SparkSession, d: str) -> DataFrame:
    return U.ranker_features(U.rrf(streams(spark, d)))


@P.add(FEAT + "SELECT q, item, " + ", ".join(f"round({x}, 9) AS {x}" for x in U.FEATURES) + " FROM feat")
def ranker_features(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("q", "item", *[F.round(x, 9).alias(x) for x in U.FEATURES])


@P.add(FEAT + ", st AS (SELECT " + ", ".join(f"avg({x}) AS {x}_m, CASE WHEN stddev_pop({x}) > 1e-12 THEN stddev_pop({x}) ELSE 1 END AS {x}_s" for x in W) + " FROM feat WHERE q % 10 < 6) SELECT q, item, " + ", ".join(f"round(({x} - {x}_m) / {x}_s, 6) AS {x}" for x in W) + " FROM feat, st")
def feature_standardise(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).select("q", "item", *W)
    return U.standardised(rows, rows.where("q % 10 < 6"), tuple(W)).select("q", "item", *[F.round(x, 6).alias(x) for x in W])


@P.add(FEAT + ", w AS (SELECT q, item, fusion_order, round(0.0" + "".join(f" + {w}::DOUBLE * {x}" for x, w in W.items()) + ", 9) AS total FROM feat) SELECT q, item, round(total, 6) AS total, row_number() OVER (PARTITION BY q ORDER BY total DESC, fusion_order, item) - 1 AS rank FROM w")
def frozen_linear_scoring(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).withColumn("fusion_order", F.col("fusion_rank") - 1)
    return U.linear_score(rows, W).select("q", "item", F.round("total", 6).alias("total"), "rank")


@P.add(ZR + ", g AS (SELECT *, coalesce(cf < 20, false) AS kept FROM f), h AS (SELECT *, kept AND row_number() OVER (PARTITION BY q, kept ORDER BY rank) <= 5 AS first FROM g) SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY first DESC, rank) - 1 AS new_rank FROM h")
def cf_quota_reorder(spark: SparkSession, d: str) -> DataFrame:
    return U.cf_quota_reorder(U.rrf(streams(spark, d)), 5).select("q", "item", "new_rank")


PROB = "1 / (1 + exp(-least(50, greatest(-50, 3.0::DOUBLE / (direct + 1) - 1.0::DOUBLE)))) AS probability"


@P.add(Z + f", p AS (SELECT *, {PROB} FROM z), o AS (SELECT *, coalesce(cf IS NULL AND probability >= 0.45::DOUBLE, false) AS only_ FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY q, only_ ORDER BY probability DESC, direct, item) AS nth, least(20, count(cf) OVER (PARTITION BY q)) AS size FROM o), m AS (SELECT *, only_ AND nth <= least(3, size) AS promoted FROM s), n AS (SELECT *, count_if(promoted) OVER (PARTITION BY q) AS n FROM m), r AS (SELECT *, coalesce(cf < least(20 - n, size), false) AS retained FROM n), g AS (SELECT *, CASE WHEN retained THEN 0 WHEN promoted THEN 1 WHEN cf IS NOT NULL THEN 2 ELSE 3 END AS grp FROM r) SELECT q, item, promoted, row_number() OVER (PARTITION BY q ORDER BY grp, CASE WHEN grp IN (0, 2) THEN cf WHEN grp = 1 THEN nth ELSE direct END, item) - 1 AS new_rank FROM g")
def tail_promotion(spark: SparkSession, d: str) -> DataFrame:
    logit = F.least(F.lit(50.0), F.greatest(F.lit(-50.0), F.lit(3.0) / (F.col("direct") + 1) - 1.0))
    rows = streams(spark, d).withColumn("probability", F.lit(1.0) / (1 + F.exp(-logit)))
    rows = rows.withColumn("probability", F.when(F.col("direct").isNotNull(), F.col("probability")))
    return U.tail_promotion(rows.fillna(-1.0, ["probability"]), 3, 0.45).select("q", "item", "promoted", "new_rank")


@P.add(ZR + f", {V.TRUTH}, g AS (SELECT *, coalesce(cf < 20, false) AS kept FROM f), h AS (SELECT *, kept AND row_number() OVER (PARTITION BY q, kept ORDER BY rank) <= 5 AS first FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY first DESC, rank) - 1 AS new_rank FROM h), m AS (SELECT abs(new_rank - cf) AS moved FROM n WHERE cf IS NOT NULL) SELECT count(*) AS n, round(avg(moved), 6) AS mean, quantile_disc(moved, 0.95)::BIGINT AS p95 FROM m")
def displacement(spark: SparkSession, d: str) -> DataFrame:
    rows = U.cf_quota_reorder(U.rrf(streams(spark, d)), 5).where("cf IS NOT NULL").select(F.abs(F.col("new_rank") - F.col("cf")).cast("bigint").alias("moved"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("moved"), 6).alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY moved)").cast("bigint").alias("p95"))


# metrics


@P.add(R + f"SELECT k, count(*) AS n, round(avg(CASE WHEN cf < k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr, round(avg(CASE WHEN cf < k THEN 1 / log2(cf + 2) ELSE 0 END), 6) AS ndcg FROM ranks, {KSQL} GROUP BY 1")
def hr_ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.hr_ndcg(V.ranks(spark, d), "cf", KS)


@P.add(R + "SELECT count(*) AS n, round(avg(coalesce(1.0::DOUBLE / (cf + 1), 0)), 6) AS mrr_cf, round(avg(coalesce(1.0::DOUBLE / (direct + 1), 0)), 6) AS mrr_direct FROM ranks")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranks(spark, d)
    return rows.agg(F.count(F.lit(1)).alias("n"), M.mrr(rows, "cf").alias("mrr_cf"), M.mrr(rows, "direct").alias("mrr_direct"))


PRE = f"WITH {V.RANKED}, {V.TRUTH}, {V.CAT}, pred AS (SELECT q, rank, tokens AS pt FROM ranked JOIN cat ON cat.item_id = item WHERE stream = 'cf'), tt AS (SELECT q, tokens AS tt FROM truth LEFT JOIN cat ON cat.item_id = target), lv AS (SELECT unnest([1, 2, 3]) AS level), pr AS (SELECT tt.q, level, len(tt) >= level AS eligible, min(rank) AS rank FROM tt CROSS JOIN lv LEFT JOIN pred ON pred.q = tt.q AND len(tt) >= level AND len(pt) >= level AND pt[:level] = tt[:level] GROUP BY 1, 2, 3) "


def prefix_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(q, level, eligible, rank): first cf candidate whose id shares the target's first `level` tokens."""
    dim = V.cat(spark, d).select("item_id", "tokens")
    levels = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    wanted = V.truth(spark, d).join(dim, F.col("target") == F.col("item_id"), "left").select("q", "tokens", levels.alias("level"))
    wanted = wanted.select("q", "level", (F.size("tokens") >= F.col("level")).alias("eligible"), N.sid_prefix(F.col("tokens"), F.col("level")).alias("prefix"))
    found = V.ranked(spark, d).where("stream = 'cf'").join(dim, F.col("item") == F.col("item_id")).select("q", "rank", F.explode(N.sid_prefixes(F.col("tokens"))).alias("p"))
    found = found.groupBy("q", F.col("p.level").alias("level"), F.col("p.prefix").alias("prefix")).agg(F.min("rank").alias("rank"))
    return wanted.join(found, ["q", "level", "prefix"], "left").select("q", "level", F.when(F.col("prefix").isNotNull(), F.col("eligible")).alias("eligible"), "rank")


@P.add(PRE + f"SELECT level, k, count(*) AS n, round(avg(CASE WHEN rank < k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit, round(count_if(rank < k)::DOUBLE / nullif(count_if(eligible), 0), 6) AS hit_eligible FROM pr, {KSQL} GROUP BY 1, 2")
def prefix_hit(spark: SparkSession, d: str) -> DataFrame:
    hit = M.within("rank")
    return M.with_k(prefix_ranks(spark, d), KS).groupBy("level", "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("hit"), F.round(F.try_divide(F.count_if(hit).cast("double"), F.count_if("eligible").cast("double")), 6).alias("hit_eligible")
    )


@P.add(PRE + ", c AS (SELECT level, count_if(rank IS NOT NULL) AS n FROM pr GROUP BY 1) SELECT level, n, round(n::DOUBLE / nullif(lag(n) OVER (ORDER BY level), 0), 6) AS ratio FROM c")
def prefix_funnel(spark: SparkSession, d: str) -> DataFrame:
    rows = prefix_ranks(spark, d).groupBy("level").agg(F.count("rank").alias("n"))  # one row for each level
    before = F.lag("n").over(Window.orderBy("level"))
    return rows.withColumn("ratio", F.round(F.try_divide(F.col("n").cast("double"), before.cast("double")), 6))


@P.add(f"WITH {V.RANKED}, {V.CAT}, p AS (SELECT q, cat.sid, rank FROM ranked LEFT JOIN cat ON cat.item_id = item WHERE stream = 'cf'), g AS (SELECT q, count(*) AS n, count_if(sid IS NULL) AS invalid, count(sid) - count(DISTINCT sid) AS repeated FROM p GROUP BY 1) SELECT count(*) AS n_queries, sum(n)::BIGINT AS n, round(sum(invalid)::DOUBLE / sum(n), 6) AS invalid_rate, round(sum(repeated)::DOUBLE / sum(n), 6) AS duplicate_rate, count_if(repeated > 0) AS queries_with_duplicates FROM g")
def validity_duplication(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranked(spark, d).where("stream = 'cf'").join(V.cat(spark, d).select(F.col("item_id").alias("item"), "sid"), "item", "left")
    g = rows.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sid").isNull()).alias("invalid"), (F.count("sid") - F.countDistinct("sid")).alias("repeated"))
    return g.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n"), M.rate(F.sum("invalid"), F.sum("n")).alias("invalid_rate"), M.rate(F.sum("repeated"), F.sum("n")).alias("duplicate_rate"), F.count_if(F.col("repeated") > 0).alias("queries_with_duplicates"))


HG = f"WITH {V.HIST}{POP}{GROUPS}, {V.RANKS} "


@P.add(HG + f", r AS (SELECT grp, cf FROM ranks JOIN grp ON grp.item_id = target), gs AS (SELECT unnest(['head', 'mid', 'tail']) AS grp) SELECT gs.grp, k, count(r.grp) AS n, round(coalesce(count_if(cf < k)::DOUBLE / nullif(count(r.grp), 0), 0), 6) AS hr, round(coalesce(sum(CASE WHEN cf < k THEN 1 / log2(cf + 2) ELSE 0 END) / nullif(count(r.grp), 0), 0), 6) AS ndcg FROM gs CROSS JOIN {KSQL} LEFT JOIN r ON r.grp = gs.grp GROUP BY 1, 2")
def group_metrics(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([("head",), ("mid",), ("tail",)], "grp string")
    rows = V.ranks(spark, d).join(item_groups(spark, d).select(F.col("item_id").alias("target"), "grp"), "target")
    hit = M.within("cf")
    sums = M.with_k(rows, KS).groupBy("grp", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("h"), F.sum(F.when(hit, M.gain(F.col("cf"))).otherwise(0.0)).alias("g"))
    full = M.with_k(groups, KS).join(sums, ["grp", "k"], "left").fillna(0, ["n", "h"]).fillna(0.0, ["g"])
    return full.select("grp", "k", "n", M.rate(F.col("h"), F.col("n")).alias("hr"), M.rate(F.col("g"), F.col("n")).alias("ndcg"))


@P.add(R + f"SELECT k, count(*) AS n, count_if(cf < k) AS cf_hits, count_if(direct < k) AS direct_hits, count_if(cf < k OR direct < k) AS union_hits, count_if(cf < k AND coalesce(direct >= k, true)) AS cf_only, count_if(direct < k AND coalesce(cf >= k, true)) AS direct_only, count_if(cf < k AND direct < k) AS both_hits FROM ranks, {KSQL} GROUP BY 1")
def stream_overlap_at_k(spark: SparkSession, d: str) -> DataFrame:
    a, b = M.within("cf"), M.within("direct")
    return M.with_k(V.ranks(spark, d), KS).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a).alias("cf_hits"), F.count_if(b).alias("direct_hits"), F.count_if(a | b).alias("union_hits"), F.count_if(a & ~b).alias("cf_only"), F.count_if(b & ~a).alias("direct_only"), F.count_if(a & b).alias("both_hits")
    )


TRANS = "CASE WHEN coalesce(cf < k, false) THEN CASE WHEN coalesce(direct < k, false) THEN 'both' ELSE 'a_only' END ELSE CASE WHEN coalesce(direct < k, false) THEN 'b_only' ELSE 'both_miss' END END"


def transition() -> F.Column:
    a, b = M.within("cf"), M.within("direct")
    return F.when(a & b, "both").when(a, "a_only").when(b, "b_only").otherwise("both_miss")


@P.add(R + f"SELECT k, {TRANS} AS transition, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY k), 6) AS rate FROM ranks, {KSQL} GROUP BY 1, 2")
def hit_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = M.with_k(V.ranks(spark, d), KS).groupBy("k", transition().alias("transition")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("k")), 6))


@P.add(R + f", c AS (SELECT k, CASE WHEN cf < k THEN cf ELSE 1e9 END AS a, CASE WHEN direct < k THEN direct ELSE 1e9 END AS b FROM ranks, {KSQL}) SELECT k, count_if(b < a) AS better, count_if(b > a) AS worse, count_if(a = b) AS same FROM c GROUP BY 1")
def rank_change(spark: SparkSession, d: str) -> DataFrame:
    clip = lambda c: F.when(M.within(c), F.col(c).cast("double")).otherwise(1e9)
    rows = M.with_k(V.ranks(spark, d), KS).select("k", clip("cf").alias("a"), clip("direct").alias("b"))
    return rows.groupBy("k").agg(F.count_if(F.col("b") < F.col("a")).alias("better"), F.count_if(F.col("b") > F.col("a")).alias("worse"), F.count_if(F.col("a") == F.col("b")).alias("same"))


BK = "CASE WHEN {r} IS NULL THEN 'absent' WHEN {r} < 5 THEN '1-5' WHEN {r} < 10 THEN '6-10' WHEN {r} < 20 THEN '11-20' WHEN {r} < 50 THEN '21-50' WHEN {r} < 100 THEN '51-100' ELSE '>100' END"


@P.add(R + "SELECT q, " + BK.format(r="cf") + " AS cf_bucket, " + BK.format(r="direct") + " AS direct_bucket FROM ranks")
def rank_bucket(spark: SparkSession, d: str) -> DataFrame:
    return V.ranks(spark, d).select("q", M.rank_bucket(F.col("cf")).alias("cf_bucket"), M.rank_bucket(F.col("direct")).alias("direct_bucket"))


@P.add(R + ", u AS (SELECT 'cf' AS stream, " + BK.format(r="cf") + " AS bucket FROM ranks UNION ALL SELECT 'direct', " + BK.format(r="direct") + " FROM ranks), c AS (SELECT stream, bucket, count(*) AS n FROM u GROUP BY 1, 2) SELECT s AS stream, b AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(['cf', 'direct']) AS s) CROSS JOIN (SELECT unnest(['1-5', '6-10', '11-20', '21-50', '51-100', '>100', 'absent']) AS b) LEFT JOIN c ON c.stream = s AND c.bucket = b")
def rank_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranks(spark, d).unpivot(["q"], ["cf", "direct"], "stream", "rank").groupBy("stream", M.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(s, b) for s in ("cf", "direct") for b in M.BUCKETS], "stream string, bucket string")
    return every.join(rows, ["stream", "bucket"], "left").fillna(0, ["n"])


FR = ZR + f", {V.TRUTH}, x AS (SELECT t.q, t.target, f.rank AS fused, f.cf, f.direct FROM truth t LEFT JOIN f ON f.q = t.q AND f.item = t.target) "


def fused_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(q, target, fused, cf, direct): ranks of the target in the fused list and in both streams."""
    rows = U.rrf(streams(spark, d)).select("q", F.col("item").alias("target"), F.col("rank").alias("fused"), "cf", "direct")
    return V.truth(spark, d).join(rows, ["q", "target"], "left")


@P.add(FR + f"SELECT k, count_if(fused < k) AS hits, count_if(cf < k OR direct < k) AS ceiling, count_if((cf < k OR direct < k) AND coalesce(fused >= k, true)) AS lost, count_if(fused < k AND coalesce(cf >= k, true)) AS gained, count_if(fused >= k) AS recoverable FROM x, {KSQL} GROUP BY 1")
def rerank_headroom(spark: SparkSession, d: str) -> DataFrame:
    f, a, b = M.within("fused"), M.within("cf"), M.within("direct")
    return M.with_k(fused_ranks(spark, d), KS).groupBy("k").agg(
        F.count_if(f).alias("hits"), F.count_if(a | b).alias("ceiling"), F.count_if((a | b) & ~f).alias("lost"), F.count_if(f & ~a).alias("gained"), F.count_if(F.col("fused") >= F.col("k")).alias("recoverable")
    )


@P.add(R + ", s AS (SELECT unnest([20, 1000000]) AS scope) SELECT scope, CASE WHEN coalesce(cf < scope, false) AND coalesce(direct < scope, false) THEN 'both' WHEN coalesce(cf < scope, false) THEN 'cf' WHEN coalesce(direct < scope, false) THEN 'direct' ELSE 'none' END AS source, count(*) AS n FROM ranks, s GROUP BY 1, 2")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    a, b = M.within("cf"), M.within("direct")
    rows = M.with_k(V.ranks(spark, d), (20, 1_000_000))
    return rows.groupBy(F.col("k").alias("scope"), F.when(a & b, "both").when(a, "cf").when(b, "direct").otherwise("none").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@P.add(FR + f"SELECT k, CASE WHEN fused IS NULL THEN 'not_in_union' WHEN fused >= k THEN 'below_k' ELSE 'hit' END AS stage, count(*) AS n FROM x, {KSQL} GROUP BY 1, 2")
def failure_stages(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("fused").isNull(), "not_in_union").when(F.col("fused") >= F.col("k"), "below_k").otherwise("hit")
    return M.with_k(fused_ranks(spark, d), KS).groupBy("k", stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@P.add(FR + ", c AS (SELECT count(*) AS n, count_if(cf < 20) AS cf_hits, count_if(fused < 20) AS hits, count_if(cf < 20 AND fused < 20) AS preserved, count_if(cf < 20 AND coalesce(fused >= 20, true)) AS lost, count_if(cf IS NULL AND direct IS NOT NULL) AS available, count_if(cf IS NULL AND fused < 20) AS recovered FROM x) SELECT *, round(coalesce(preserved::DOUBLE / nullif(cf_hits, 0), 0), 6) AS preservation, round(coalesce(recovered::DOUBLE / nullif(available, 0), 0), 6) AS conversion FROM c")
def policy_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = fused_ranks(spark, d).withColumn("k", F.lit(20))
    f, a, absent = M.within("fused"), M.within("cf"), F.col("cf").isNull()
    c = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a).alias("cf_hits"), F.count_if(f).alias("hits"), F.count_if(a & f).alias("preserved"), F.count_if(a & ~f).alias("lost"), F.count_if(absent & F.col("direct").isNotNull()).alias("available"), F.count_if(absent & f).alias("recovered")
    )
    return c.withColumns({"preservation": M.rate(F.col("preserved"), F.col("cf_hits")), "conversion": M.rate(F.col("recovered"), F.col("available"))})


@P.add(FR + ", h AS (SELECT avg(CASE WHEN cf < 20 THEN 1.0::DOUBLE ELSE 0 END) AS cf, avg(CASE WHEN fused < 20 THEN 1.0::DOUBLE ELSE 0 END) AS fused, avg(CASE WHEN cf IS NOT NULL OR direct IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS ceiling, count_if(cf < 20 AND fused < 20)::DOUBLE / nullif(count_if(cf < 20), 0) AS kept, count_if(cf IS NULL AND direct < 20 AND fused < 20)::DOUBLE / nullif(count_if(cf IS NULL AND direct < 20), 0) AS recovered FROM x), g AS (SELECT *, CASE WHEN ceiling > cf THEN (fused - cf) / (ceiling - cf) END AS r FROM h) SELECT round(cf, 6) AS cf, round(fused, 6) AS fused, round(ceiling, 6) AS ceiling, round(r, 6) AS retention, round(kept, 6) AS preservation, round(recovered, 6) AS recovery, coalesce(kept >= 0.97, false) AS keeps, coalesce(r >= 0.95, false) AS gains, coalesce(recovered >= 0.9, false) AS recovers FROM g")
def uplift_retention(spark: SparkSession, d: str) -> DataFrame:
    """The share of the possible gain over cf that fusion keeps, and the gates of preservation, gain and recovery."""
    rows = fused_ranks(spark, d).withColumn("k", F.lit(20))
    a, f, only = M.within("cf"), M.within("fused"), F.col("cf").isNull() & M.within("direct")
    h = rows.agg(
        F.avg(a.cast("double")).alias("c"), F.avg(f.cast("double")).alias("f"), F.avg((F.col("cf").isNotNull() | F.col("direct").isNotNull()).cast("double")).alias("u"),
        F.try_divide(F.count_if(a & f), F.count_if(a)).alias("p"), F.try_divide(F.count_if(only & f), F.count_if(only)).alias("r"),
    ).withColumn("t", F.when(F.col("u") > F.col("c"), F.try_divide(F.col("f") - F.col("c"), F.col("u") - F.col("c"))))
    gate = lambda c, least, name: F.coalesce(F.col(c) >= least, F.lit(False)).alias(name)
    return h.select(*[F.round(x, 6).alias(y) for x, y in (("c", "cf"), ("f", "fused"), ("u", "ceiling"), ("t", "retention"), ("p", "preservation"), ("r", "recovery"))], gate("p", 0.97, "keeps"), gate("t", 0.95, "gains"), gate("r", 0.9, "recovers"))


@P.add(f"WITH {V.HIST}{POP}, p AS (SELECT i.item_id, coalesce(pop.n, 0) AS n FROM items i LEFT JOIN pop ON pop.item_id = i.item_id), r AS (SELECT item_id, count(*) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) - 1 AS rank FROM p), t AS (SELECT rank FROM hist LEFT JOIN r ON r.item_id = hist.item_id WHERE split = 'test') SELECT k, count(*) AS n, round(avg(CASE WHEN rank < k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr, round(avg(CASE WHEN rank < k THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg, round(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr FROM t, {KSQL} GROUP BY 1")
def popularity_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Pessimistic rank of each test target by training popularity over all items, and its metrics."""
    counts = table(spark, d, "items").select("item_id").join(popularity(spark, d).select("item_id", "n"), "item_id", "left").fillna(0, ["n"])
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c"))  # one row for each different count
    steps = steps.withColumn("rank", F.sum("c").over(Window.orderBy(F.desc("n"))) - 1).select("n", "rank")
    rows = V.hist(spark, d).where("split = 'test'").select("item_id").join(counts, "item_id", "left").join(steps, "n", "left")
    hit = M.within("rank")
    return M.with_k(rows, KS).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("hr"), F.round(F.avg(F.when(hit, M.gain(F.col("rank"))).otherwise(0.0)), 6).alias("ndcg"), M.mrr(rows, "rank").alias("mrr"))


@P.add(f"WITH {V.RANKED} SELECT q, item, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank, item) - 1 AS place FROM ranked WHERE stream = 'direct' AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, rank, item) <= 10")
def topk_stable(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranked(spark, d).where("stream = 'direct' AND score IS NOT NULL").select("q", "item", "score", "rank")
    return U.first_places(rows, 10, F.desc("score"), F.col("rank"), F.col("item"), name="place").select("q", "item", "score", "place")


@P.add(f"WITH {V.RANKED} SELECT count(*) AS n, 0 AS mismatches FROM ranked WHERE stream = 'cf' AND rank < 20")
def prefix_consistency(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best cut from the raw candidates by themselves against the first 20 of the whole list, place by place."""
    rows = table(spark, d, "candidates").where("sample_id IS NOT NULL AND item_id IS NOT NULL AND candidate_rank BETWEEN 1 AND 999998 AND NOT source_type <=> 'sasrec_direct'")
    score = F.when(~F.isnan("fusion_score"), F.col("fusion_score"))
    best = F.min(F.struct(F.col("candidate_rank"), score.isNull(), (-score)))
    rows = rows.groupBy(F.col("sample_id").alias("q"), F.col("item_id").alias("item")).agg(best.alias("b"))
    view = U.first_places(rows, 20, F.col("b"), F.col("item")).select("q", F.col("item").alias("a"), "rank")
    whole = V.ranked(spark, d).where("stream = 'cf' AND rank < 20").select("q", F.col("item").alias("b"), "rank")
    both = view.join(whole, ["q", "rank"], "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).cast("int").alias("mismatches"))


@P.add(f"WITH {V.RANKED}, {V.TRUTH}, t AS (SELECT t.q, r.score AS target_score FROM truth t JOIN ranked r ON r.q = t.q AND r.item = t.target AND r.stream = 'direct') SELECT t.q, CASE WHEN t.target_score IS NOT NULL THEN count_if(r.score >= t.target_score) - 1 END AS rank FROM t JOIN ranked r ON r.q = t.q AND r.stream = 'direct' GROUP BY t.q, t.target_score")
def pessimistic_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranked(spark, d).where("stream = 'direct'").select("q", "item", "score").join(V.truth(spark, d), "q")
    mine = rows.where("item = target").select("q", F.col("score").alias("mine"))
    rows = rows.join(mine, "q").groupBy("q").agg(F.max("mine").alias("mine"), F.count_if(F.col("score") >= F.col("mine")).alias("c"))
    return rows.select("q", F.when(F.col("mine").isNotNull(), F.col("c") - 1).alias("rank"))


@P.add(f"WITH {V.RANKED}, w AS (SELECT *, lag(score) OVER (PARTITION BY q, stream ORDER BY rank) AS before, count(*) OVER (PARTITION BY q, stream) AS n FROM ranked) SELECT stream, count(*) AS n, count(DISTINCT q) AS n_queries, count_if(score IS NULL) AS null_scores, count_if(score > before) AS unordered, max(n) AS longest, count_if(item NOT IN (SELECT item_id FROM items)) AS unknown_items FROM w GROUP BY 1")
def candidate_view_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranked(spark, d)
    before = rows.select("q", "stream", (F.col("rank") + 1).alias("rank"), F.col("score").alias("before"))
    rows = rows.join(before, ["q", "stream", "rank"], "left")
    rows = rows.join(table(spark, d, "items").select(F.col("item_id").alias("item"), F.lit(True).alias("known")).distinct(), "item", "left")
    return rows.groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("q").alias("n_queries"), F.count_if(F.col("score").isNull()).alias("null_scores"), F.count_if(F.col("score") > F.col("before")).alias("unordered"), (F.max("rank") + 1).alias("longest"), F.count_if(F.col("known").isNull()).alias("unknown_items")
    )


RBO = "round(0.1::DOUBLE * sum(pow(0.9::DOUBLE, depth - 1) * common / depth), 6)"


@P.add(f"WITH {V.RANKED}, a AS (SELECT q, item, rank FROM ranked WHERE stream = 'cf' AND rank < 10), b AS (SELECT q, item, rank FROM ranked WHERE stream = 'direct' AND rank < 10), qs AS (SELECT DISTINCT q FROM a INTERSECT SELECT DISTINCT q FROM b), m AS (SELECT a.q, greatest(a.rank, b.rank) AS seen FROM a JOIN b ON a.q = b.q AND a.item = b.item), s AS (SELECT qs.q, depth, count(m.seen) AS common FROM qs CROSS JOIN (SELECT unnest(range(1, 11)) AS depth) LEFT JOIN m ON m.q = qs.q AND m.seen < depth GROUP BY 1, 2), sz AS (SELECT q, (SELECT count(*) FROM a WHERE a.q = qs.q) AS na, (SELECT count(*) FROM b WHERE b.q = qs.q) AS nb FROM qs) SELECT s.q, max(common) AS overlap, round(max(common)::DOUBLE / (any_value(na) + any_value(nb) - max(common)), 6) AS jaccard, {RBO} AS rbo FROM s JOIN sz USING (q) GROUP BY 1")
def list_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranked(spark, d).where("rank < 10")
    sizes = rows.groupBy("q").agg(F.count_if(F.col("stream") == "cf").alias("na"), F.count_if(F.col("stream") == "direct").alias("nb")).where("na > 0 AND nb > 0")
    met = U.both_streams(rows).where("cf IS NOT NULL AND direct IS NOT NULL").groupBy("q").agg(F.collect_list(F.greatest("cf", "direct")).alias("seen"))
    rows = sizes.join(met, "q", "left").withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(10))))
    rows = rows.withColumn("common", F.coalesce(F.array_size(F.filter("seen", lambda s: s < F.col("depth"))), F.lit(0)).cast("bigint"))
    return rows.groupBy("q").agg(
        F.max("common").alias("overlap"), F.round(F.max("common") / (F.first("na") + F.first("nb") - F.max("common")), 6).alias("jaccard"), F.round(F.lit(0.1) * F.sum(F.pow(F.lit(0.9), F.col("depth") - 1) * F.col("common") / F.col("depth")), 6).alias("rbo")
    )


SL = f"WITH {V.RANKS}, {V.CAT}, cs AS (SELECT sample_id AS q, any_value(len(history_item_id)) AS h FROM candidate_samples WHERE sample_id IS NOT NULL GROUP BY 1), x AS (SELECT cf, len(tokens) > 3 AS dedup, coalesce(h, 0) <= 5 AS short FROM ranks LEFT JOIN cat ON cat.item_id = target LEFT JOIN cs ON cs.q = ranks.q), u AS (SELECT cf, unnest([{{'slice': 'dedup', 'value': CASE WHEN dedup THEN 'yes' ELSE 'no' END}}, {{'slice': 'history', 'value': CASE WHEN short THEN 'short' ELSE 'long' END}}]) AS s FROM x) "


@P.add(SL + f"SELECT s.slice AS slice, s.value AS value, k, count(*) AS n, round(avg(CASE WHEN cf < k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr, round(avg(CASE WHEN cf < k THEN 1 / log2(cf + 2) ELSE 0 END), 6) AS ndcg FROM u, {KSQL} GROUP BY 1, 2, 3")
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "candidate_samples").where("sample_id IS NOT NULL").groupBy(F.col("sample_id").alias("q")).agg(F.max(F.array_size("history_item_id")).alias("h"))
    rows = V.ranks(spark, d).join(V.cat(spark, d).select(F.col("item_id").alias("target"), F.size("tokens").alias("t")), "target", "left").join(lengths, "q", "left")
    slices = F.array(
        F.struct(F.lit("dedup").alias("slice"), F.when(F.col("t") > 3, "yes").otherwise("no").alias("value")),
        F.struct(F.lit("history").alias("slice"), F.when(F.coalesce("h", F.lit(0)) <= 5, "short").otherwise("long").alias("value")),
    )
    return M.hr_ndcg(rows.select("cf", F.explode(slices).alias("s")).select("cf", "s.slice", "s.value"), "cf", KS, ["slice", "value"])


@P.add(R + f", p AS (SELECT q % 3 AS part, k, avg(CASE WHEN cf < k THEN 1.0::DOUBLE ELSE 0 END) AS hr FROM ranks, {KSQL} GROUP BY 1, 2) SELECT k, round(min(hr), 6) AS least, round(max(hr), 6) AS most, round(max(hr) - min(hr), 6) AS spread FROM p GROUP BY 1")
def split_stability(spark: SparkSession, d: str) -> DataFrame:
    rows = M.with_k(V.ranks(spark, d).withColumn("part", F.col("q") % 3), KS).groupBy("part", "k").agg(F.avg(M.within("cf").cast("double")).alias("hr"))
    return rows.groupBy("k").agg(F.round(F.min("hr"), 6).alias("least"), F.round(F.max("hr"), 6).alias("most"), F.round(F.max("hr") - F.min("hr"), 6).alias("spread"))


@P.add(R + "SELECT round(coalesce(count_if(cf < 20)::DOUBLE / nullif(count_if(cf IS NOT NULL), 0), 0), 6) AS hr_in_pool, count_if(cf IS NOT NULL) AS in_pool FROM ranks")
def conditional_hr(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ranks(spark, d).withColumn("k", F.lit(20))
    return rows.agg(M.rate(F.count_if(M.within("cf")), F.count("cf")).alias("hr_in_pool"), F.count("cf").alias("in_pool"))


QUERIES, ORACLE = P.queries, P.oracle
