"""Vectors, expansion of predicted ids, feature reranking, rewards and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histrank.functions import vector as A
from histrank.operators import fusion as U
from histrank.operators import metrics as M
from histrank.operators import quantize as K
from histrank.operators import rewards as G
from histrank.operators.cooccurrence import cooccurrences, ppmi as ppmi_of
from histrank.operators.expansion import expand
from histrank.plans.base import Plans
from histrank.plans.data import POP, baskets, popularity
from histrank.plans.ranking import W, features
from histrank.plans.sids import BASE, base
from histrank.session import table
from histrank.sources import views as V
from histrank.streaming import streams as T

P = Plans()

VEC = """iv AS (SELECT item_id, list_transform(matrix, lambda x: CASE WHEN isnan(x) OR isinf(x) OR x IS NULL THEN 0.0::DOUBLE ELSE x::DOUBLE END) AS v FROM item_vectors WHERE len(matrix) = 64 AND item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY row_index) = 1),
uv AS (SELECT item_id, CASE WHEN n > 1e-12 THEN list_transform(v, lambda x: x / n) ELSE list_transform(v, lambda x: 0.0::DOUBLE) END AS u FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM iv))"""


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, u): the first exported vector of each item, bad elements as 0, divided by its length."""
    rows = table(spark, d, "item_vectors").where((F.size("matrix") == 64) & F.col("item_id").isNotNull())
    return rows.groupBy("item_id").agg(F.min_by("matrix", "row_index").alias("m")).select("item_id", A.l2_normalize(A.finite(F.col("m"))).alias("u"))


@P.add(f"WITH {VEC} SELECT item_id, list_transform(u, lambda x: round(x, 6)) AS u FROM uv")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return unit_vectors(spark, d).select("item_id", F.transform("u", lambda x: F.round(x, 6)).alias("u"))


@P.add(f"WITH {VEC} SELECT count(*) AS n, round(min(n), 5) AS least, round(avg(n), 5) AS mean, round(max(n), 5) AS most FROM (SELECT sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM iv)")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "item_vectors").where((F.size("matrix") == 64) & F.col("item_id").isNotNull())
    rows = rows.groupBy("item_id").agg(A.finite(F.min_by("matrix", "row_index")).alias("v")).select(F.sqrt(A.dot(F.col("v"), F.col("v"))).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("n"), 5).alias("least"), F.round(F.avg("n"), 5).alias("mean"), F.round(F.max("n"), 5).alias("most"))


PAIR = ", pr AS (SELECT DISTINCT target_item_id AS a, history_item_id[-1] AS b FROM candidate_samples WHERE target_item_id IS NOT NULL AND history_item_id[-1] IS NOT NULL)"


@P.add(f"WITH {VEC}{PAIR} SELECT a, b, coalesce(round(list_sum(list_transform(list_zip(x.u, y.u), lambda z: z[1] * z[2])), 5), 0.0) AS cosine FROM pr LEFT JOIN uv x ON x.item_id = a LEFT JOIN uv y ON y.item_id = b")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_samples").select(F.col("target_item_id").alias("a"), F.try_element_at("history_item_id", F.lit(-1)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    u = unit_vectors(spark, d)
    rows = rows.join(u.select(F.col("item_id").alias("a"), F.col("u").alias("x")), "a", "left").join(u.select(F.col("item_id").alias("b"), F.col("u").alias("y")), "b", "left")
    return rows.select("a", "b", F.coalesce(F.round(A.dot(F.col("x"), F.col("y")), 5), F.lit(0.0)).alias("cosine"))


CO = "co AS (SELECT a AS item_a, b AS item_b, count(*) AS n FROM (SELECT DISTINCT x.sample_id, x.i AS a, y.i AS b FROM (SELECT sample_id, unnest(list_append(coalesce(history_item_id, []), target_item_id)) AS i FROM candidate_samples) x JOIN (SELECT sample_id, unnest(list_append(coalesce(history_item_id, []), target_item_id)) AS i FROM candidate_samples) y ON x.sample_id = y.sample_id AND x.i <> y.i) GROUP BY 1, 2)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrences(baskets(spark, d), "sample_id", "items")


@P.add(f"WITH {CO}, s AS (SELECT item_a AS i, sum(n) AS s FROM co GROUP BY 1), t AS (SELECT sum(n) AS t FROM co) SELECT * FROM (SELECT item_a, item_b, round(ln(n::DOUBLE * t / (a.s::DOUBLE * b.s)), 6) AS ppmi FROM co JOIN s a ON a.i = item_a JOIN s b ON b.i = item_b, t) WHERE ppmi > 0")
def ppmi(spark: SparkSession, d: str) -> DataFrame:
    return ppmi_of(_pairs(spark, d))


@P.add(f"WITH {CO} SELECT count(*) AS nnz, count(DISTINCT item_a) AS n_items, round(1 - count(*)::DOUBLE / (count(DISTINCT item_a) * count(DISTINCT item_a)), 6) AS sparsity FROM co WHERE n >= 2")
def cooccurrence_sparsity(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).where("n >= 2").agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("item_a").alias("n_items"))
    return rows.withColumn("sparsity", F.round(1 - F.col("nnz") / (F.col("n_items") * F.col("n_items")), 6))


EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@P.add(f"WITH {EMB}, m AS (SELECT label, list(x ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS i FROM e) GROUP BY 1, 2) GROUP BY 1), f AS (SELECT vec_id, list_transform(list_zip(v, centre), lambda z: 0.7::DOUBLE * z[1] + (1.0::DOUBLE - 0.7::DOUBLE) * z[2]) AS w FROM e JOIN m USING (label)) SELECT vec_id, list_transform(w, lambda x: round(x / sqrt(list_sum(list_transform(w, lambda y: y * y))), 5)) AS fused FROM f")
def embedding_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", A.finite(F.col("embedding")).alias("v"))
    fused = rows.join(F.broadcast(_centres(rows)), "label").select("vec_id", A.mix(F.col("v"), F.col("centre"), 0.7).alias("f"))
    return fused.select("vec_id", F.transform("f", lambda x: F.round(x, 5)).alias("fused"))


def _centres(rows: DataFrame) -> DataFrame:
    """(label, centre): the mean vector of each label; there is a fixed number of labels."""
    each = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


@P.add(f"WITH {EMB}, m AS (SELECT label AS code, list(x ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS i FROM e) GROUP BY 1, 2) GROUP BY 1), p AS (SELECT vec_id, code, round(list_sum(list_transform(list_zip(v, centre), lambda z: pow(z[1] - z[2], 2))), 6) AS dist FROM e CROSS JOIN m) SELECT vec_id, code FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", A.finite(F.col("embedding")).alias("v"))
    return K.nearest_centroid(rows, "vec_id", "v", _centres(rows).withColumnRenamed("label", "code")).select("vec_id", "code")


@P.add(f"WITH {EMB}, warm AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(64)) AS i FROM e WHERE label <> 0) GROUP BY 1), c AS (SELECT list(x ORDER BY i) AS centre FROM warm) SELECT vec_id, list_transform(w, lambda x: round(x / sqrt(list_sum(list_transform(w, lambda y: y * y))), 5)) AS filled FROM (SELECT vec_id, CASE WHEN label = 0 THEN centre ELSE v END AS w FROM e, c)")
def cold_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in which cold rows (label 0) get the mean of the warm ones."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", A.finite(F.col("embedding")).alias("v"))
    mean = _centres(rows.where("label <> 0").withColumn("label", F.lit(0))).select("centre")
    filled = rows.crossJoin(F.broadcast(mean)).select("vec_id", A.l2_normalize(F.when(F.col("label") == 0, F.col("centre")).otherwise(F.col("v"))).alias("f"))
    return filled.select("vec_id", F.transform("f", lambda x: F.round(x, 5)).alias("filled"))


@P.add()
def residual_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return K.residual_kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", levels=3, k=8)


@P.add()
def balanced_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Codes of at most n / 10 + 1 vectors each: distances to the label centres, filled greedily."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", A.finite(F.col("embedding")).alias("v"))
    centres = _centres(rows).orderBy("label").collect()  # a fixed number of labels
    book = [F.array(*[F.lit(float(x)) for x in c["centre"]]) for c in centres]
    far = F.array(*[F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for c in book])
    return K.balanced_codes(rows.select("vec_id", far.alias("d")), "vec_id", "d", rows.count() // max(1, len(book)) + 1)


@P.add()
def ppmi_svd(spark: SparkSession, d: str) -> DataFrame:
    return K.truncated_svd(ppmi_of(_pairs(spark, d)), 8)


# expansion

EXP = f"WITH {V.RANKED}, {V.CAT}, dim AS (SELECT item_id AS item, tokens[:3] AS tokens, {BASE} AS sid FROM cat), sz AS (SELECT sid, count(*) AS bucket FROM dim GROUP BY 1), items2 AS (SELECT dim.*, bucket FROM dim JOIN sz USING (sid)), pred AS (SELECT q, rank AS sid_rank, sid, tokens FROM ranked JOIN dim USING (item) WHERE stream = 'cf') "
ORD = "row_number() OVER (PARTITION BY q ORDER BY sid_rank, stage, sid, item) - 1"


def _expanded(spark: SparkSession, d: str, levels: tuple[int, ...]) -> DataFrame:
    dim = base(spark, d).select(F.col("item_id").alias("item"), F.slice("tokens", 1, 3).alias("tokens"), F.col("base").alias("sid"))
    pred = V.ranked(spark, d).where("stream = 'cf'").join(dim, "item").select("q", F.col("rank").alias("sid_rank"), "sid", "tokens")
    return expand(pred, dim, levels)


@P.add(EXP + f", x AS (SELECT q, sid_rank, 0 AS stage, p.sid, i.item, 'exact' AS source, len(p.tokens) AS level, bucket FROM pred p JOIN items2 i ON i.sid = p.sid QUALIFY row_number() OVER (PARTITION BY q, i.item ORDER BY sid_rank, p.sid) = 1) SELECT * FROM (SELECT q, item, {ORD} AS place, source, level, bucket, sid_rank FROM x)")
def exact_expand(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d, ()).drop("sources")


PX = EXP + f", u AS (SELECT q, sid_rank, 0 AS stage, p.sid, i.item, 'exact' AS source, len(p.tokens) AS level, bucket FROM pred p JOIN items2 i ON i.sid = p.sid UNION ALL SELECT q, sid_rank, 1, i.sid, i.item, 'prefix@2', 2, bucket FROM pred p JOIN items2 i ON len(p.tokens) >= 2 AND len(i.tokens) >= 2 AND i.tokens[:2] = p.tokens[:2]), ss AS (SELECT q, item, list_sort(list(DISTINCT source)) AS sources FROM u GROUP BY 1, 2), x AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY q, item ORDER BY sid_rank, stage, sid) = 1), o AS (SELECT *, {ORD} AS place FROM x), px AS (SELECT o.q, o.item, place, source, level, bucket, sid_rank, sources FROM o JOIN ss ON ss.q = o.q AND ss.item = o.item) "


@P.add(PX + "SELECT * FROM px")
def prefix_expand(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d, (2,))


@P.add(PX + f", {V.TRUTH} SELECT count(DISTINCT px.q) AS n_queries, count(*) AS n_candidates, count_if(source = 'exact') AS first_exact, count_if(list_contains(sources, 'prefix@2')) AS with_prefix, round(count_if(item = target)::DOUBLE / count(DISTINCT px.q), 6) AS pool_recall, round(avg(CASE WHEN item = target THEN place END), 6) AS mean_rank FROM px JOIN truth t ON t.q = px.q")
def candidate_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _expanded(spark, d, (2,)).join(V.truth(spark, d), "q")
    hit = F.col("item") == F.col("target")
    return rows.agg(
        F.countDistinct("q").alias("n_queries"), F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("source") == "exact").alias("first_exact"), F.count_if(F.array_contains("sources", "prefix@2")).alias("with_prefix"),
        F.round(F.count_if(hit) / F.countDistinct("q"), 6).alias("pool_recall"), F.round(F.avg(F.when(hit, F.col("place"))), 6).alias("mean_rank"),
    )


# reranking with history

RER = (
    f"WITH {V.HIST}{POP}, {V.RANKED}, {VEC}, cs AS (SELECT sample_id AS q, history_item_id AS h FROM candidate_samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC) = 1), "
    "hx AS (SELECT q, unnest(h) AS hi, unnest(range(1, len(h) + 1)) AS pos, len(h) AS n FROM cs), c AS (SELECT q, item, rank, source, level, bucket FROM ranked WHERE stream = 'cf'), "
    "sim AS (SELECT c.q, c.item, max(coalesce(list_sum(list_transform(list_zip(x.u, y.u), lambda z: z[1] * z[2])), 0)) AS best, max(CASE WHEN pos = n THEN coalesce(list_sum(list_transform(list_zip(x.u, y.u), lambda z: z[1] * z[2])), 0) END) AS recent FROM c JOIN hx ON hx.q = c.q LEFT JOIN uv x ON x.item_id = c.item LEFT JOIN uv y ON y.item_id = hx.hi GROUP BY 1, 2), "
    "mp AS (SELECT max(ln(1 + n)) AS m FROM pop), s AS (SELECT c.q, c.item, c.rank, 1.0::DOUBLE / (c.rank + 1) + 0.5::DOUBLE * CASE WHEN source = 'exact' THEN 1.0::DOUBLE ELSE greatest(0, least(1, coalesce(level / 4.0::DOUBLE, 0))) END + 0.2::DOUBLE * ln(1 + coalesce(p.n, 0)) / m + 0.8::DOUBLE * coalesce(best, 0) + 0.4::DOUBLE * coalesce(recent, 0) - 0.05::DOUBLE * ln(1 + greatest(coalesce(bucket, 1), 1)) AS score FROM c LEFT JOIN sim ON sim.q = c.q AND sim.item = c.item LEFT JOIN pop p ON p.item_id = c.item, mp) "
)


def history_raw(spark: SparkSession, d: str) -> DataFrame:
    """(q, item, rank, the eleven features of candidate and history)."""
    rows = V.ranked(spark, d).where("stream = 'cf'").select("q", "item", "rank", "source", "level", "bucket")
    h = table(spark, d, "candidate_samples").where("sample_id IS NOT NULL").groupBy(F.col("sample_id").alias("q")).agg(F.max_by("history_item_id", "ingested_at").alias("h"))
    u = unit_vectors(spark, d)
    each = h.select("q", F.size("h").alias("n"), F.posexplode("h").alias("pos", "hi")).join(u.select(F.col("item_id").alias("hi"), F.col("u").alias("y")), "hi")
    # one row of vectors for each query, so that candidates aren't multiplied by the history
    known = each.groupBy("q").agg(F.collect_list(F.struct("pos", "y")).alias("near"))
    past = h.where(F.size("h") > 0).select("q", F.size("h").alias("n")).join(known, "q", "left")
    met = rows.select("q", "item").join(u.select(F.col("item_id").alias("item"), F.col("u").alias("x")), "item").join(past, "q")
    cosines = F.transform(F.coalesce("near", F.array().cast(known.schema["near"].dataType)), lambda e: F.struct(e["pos"].alias("pos"), A.dot(F.col("x"), e["y"]).alias("c")))
    met = met.select("q", "item", "n", cosines.alias("cs"))
    unknown = F.when(F.size("cs") < F.col("n"), F.lit(0.0))  # an item of the history without a vector counts as 0
    best = F.greatest(F.array_max(F.transform("cs", lambda e: e["c"])), unknown)
    recent = F.get(F.transform(F.filter("cs", lambda e: e["pos"] == F.col("n") - 1), lambda e: e["c"]), F.lit(0))
    met = met.select("q", "item", best.alias("best"), recent.alias("recent"))
    pop = popularity(spark, d).select(F.col("item_id").alias("item"), "n")
    rows = rows.join(met, ["q", "item"], "left").join(pop, "item", "left").crossJoin(F.broadcast(pop.agg(F.max(F.log1p("n")).alias("m"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    penalty = F.log1p(F.greatest(F.coalesce("bucket", F.lit(1)), F.lit(1)))
    rows = rows.select(
        "q", "item", "rank", (F.lit(1.0) / (F.col("rank") + 1)).alias("sid_rank_score"), U.source_score(F.col("source"), F.col("level")).cast("double").alias("source_score"), (F.log1p(F.coalesce("n", F.lit(0))) / F.col("m")).alias("popularity_score"),
        zero("best").alias("history_cosine"), zero("recent").alias("recent_cosine"), penalty.alias("bucket_penalty"), penalty.alias("bucket_size_log"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("level") / 4.0, F.lit(0.0)))).alias("expansion_level_score"),
        F.coalesce((F.col("source") == "exact").cast("double"), F.lit(0.0)).alias("exact_source"), F.coalesce(F.startswith("source", F.lit("prefix@")).cast("double"), F.lit(0.0)).alias("prefix_source"),
    )
    score = F.col("sid_rank_score") + 0.5 * F.col("source_score") + 0.2 * F.col("popularity_score") + 0.8 * F.col("history_cosine") + 0.4 * F.col("recent_cosine") - 0.05 * F.col("bucket_penalty")
    return rows.withColumn("heuristic_score", score)


@P.add(RER + "SELECT q, item, round(score, 5) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 5) DESC, rank, item::VARCHAR) - 1 AS place FROM s")
def heuristic_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Order by a weighted sum of rank, source, popularity and similarity to the history, less a penalty for large buckets."""
    rows = history_raw(spark, d).select("q", "item", "rank", F.round("heuristic_score", 5).alias("score"), F.col("item").cast("string").alias("name"))
    return U.place(rows, F.desc("score"), F.col("rank"), F.col("name"), name="place").select("q", "item", "score", "place")


_LEVEL = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(level / 4.0::DOUBLE, 0)))"


@P.add(RER + f"""SELECT c.q, c.item, round(1.0::DOUBLE / (c.rank + 1), 5) AS sid_rank_score, round(CASE WHEN source = 'exact' THEN 1.0::DOUBLE ELSE {_LEVEL} END, 5) AS source_score, round(ln(1 + coalesce(p.n, 0)) / m, 5) AS popularity_score,
round(coalesce(best, 0), 4) AS history_cosine, round(coalesce(recent, 0), 4) AS recent_cosine, round(ln(1 + greatest(coalesce(bucket, 1), 1)), 5) AS bucket_penalty, round(ln(1 + greatest(coalesce(bucket, 1), 1)), 5) AS bucket_size_log, round({_LEVEL}, 5) AS expansion_level_score,
CASE WHEN source = 'exact' THEN 1.0::DOUBLE ELSE 0 END AS exact_source, CASE WHEN source LIKE 'prefix@%' THEN 1.0::DOUBLE ELSE 0 END AS prefix_source, round(s.score, 5) AS heuristic_score
FROM c JOIN s ON s.q = c.q AND s.item = c.item LEFT JOIN sim ON sim.q = c.q AND sim.item = c.item LEFT JOIN pop p ON p.item_id = c.item, mp""")
def history_features(spark: SparkSession, d: str) -> DataFrame:
    """The eleven features of a candidate and the history of its query."""
    rows = history_raw(spark, d).drop("rank")
    return rows.select("q", "item", *[F.round(c, 4 if c.endswith("cosine") else 5).alias(c) for c in rows.columns[2:]])


@P.add()
def pairwise_ranker(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a linear ranker learnt from targets and all other candidates of each query."""
    rows = features(spark, d).join(V.truth(spark, d), "q")
    hit = F.col("item") == F.col("target")
    weights = K.pairwise_ranker(rows.where(hit), rows.where(~hit), tuple(W))
    return spark.createDataFrame(sorted(weights.items()), "feature string, weight double")


@P.add()
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Probability of each direct-only candidate to be the target, by a class-balanced logistic model."""
    rows = features(spark, d).where("cf_only = 1").join(V.truth(spark, d), "q").withColumn("label", (F.col("item") == F.col("target")).cast("int"))
    return K.balanced_logistic(rows.select("q", "item", "label", *W), tuple(W), "label").select("q", "item", F.col("score").alias("probability"))


# rewards

GEN = f"WITH {V.RANKED}, {V.TRUTH}, g AS (SELECT r.q, r.rank AS i, r.item, r.item = target AS hit, target FROM ranked r JOIN truth t ON t.q = r.q WHERE stream = 'cf' AND rank < 16), w AS (SELECT *, 1 / log2(i + 2) AS s FROM g), rw AS (SELECT q, i, item, target, hit::INT::DOUBLE AS rule, CASE WHEN max(hit::INT) OVER (PARTITION BY q) = 0 OR hit THEN 0.0 ELSE -s / sum(s) OVER (PARTITION BY q) END AS ndcg FROM w) "


def generations(spark: SparkSession, d: str) -> DataFrame:
    """(q, i, item, target, hit): the first sixteen cf candidates of each query as its generations."""
    rows = V.ranked(spark, d).where("stream = 'cf' AND rank < 16").join(V.truth(spark, d), "q")
    return rows.select("q", F.col("rank").alias("i"), "item", "target", (F.col("item") == F.col("target")).alias("hit"))


@P.add(GEN + "SELECT q, i, rule, round(ndcg, 6) AS ndcg FROM rw")
def rule_reward(spark: SparkSession, d: str) -> DataFrame:
    return G.rule_reward(generations(spark, d)).select("q", "i", "rule", F.round("ndcg", 6).alias("ndcg"))


@P.add(GEN + "SELECT q, i, round((rule - avg(rule) OVER w) / (coalesce(stddev_samp(rule) OVER w, 0) + 1e-4::DOUBLE), 5) AS advantage FROM rw WINDOW w AS (PARTITION BY q)")
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    return G.rule_reward(generations(spark, d)).select("q", "i", F.round(G.group_advantage("rule"), 5).alias("advantage"))


@P.add(GEN + f", {V.CAT} SELECT q, i, CASE WHEN len(a.tokens) >= 3 AND len(b.tokens) >= 3 AND a.tokens[:3] = b.tokens[:3] THEN 1.0 WHEN len(a.tokens) >= 2 AND len(b.tokens) >= 2 AND a.tokens[:2] = b.tokens[:2] THEN 0.5 WHEN len(a.tokens) >= 1 AND len(b.tokens) >= 1 AND a.tokens[:1] = b.tokens[:1] THEN 0.2 ELSE 0.0 END::DOUBLE AS reward FROM rw LEFT JOIN cat a ON a.item_id = rw.item LEFT JOIN cat b ON b.item_id = rw.target")
def hepo_reward(spark: SparkSession, d: str) -> DataFrame:
    dim = V.cat(spark, d)
    rows = generations(spark, d).join(dim.select(F.col("item_id").alias("item"), F.col("tokens").alias("a")), "item", "left").join(dim.select(F.col("item_id").alias("target"), F.col("tokens").alias("b")), "target", "left")
    return rows.select("q", "i", G.prefix_reward(F.col("a"), F.col("b")).alias("reward"))


@P.add(GEN.replace("WITH ", f"WITH {VEC}, ", 1) + "SELECT q, i, round(coalesce(list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])), 0), 4) AS reward FROM rw LEFT JOIN uv a ON a.item_id = rw.item LEFT JOIN uv b ON b.item_id = rw.target")
def semantic_reward(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each generation's vector and the target's; 0 where one has none."""
    u = unit_vectors(spark, d)
    rows = generations(spark, d).join(u.select(F.col("item_id").alias("item"), F.col("u").alias("x")), "item", "left").join(u.select(F.col("item_id").alias("target"), F.col("u").alias("y")), "target", "left")
    return rows.select("q", "i", F.round(F.coalesce(A.dot(F.col("x"), F.col("y")), F.lit(0.0)), 4).alias("reward"))


@P.add(GEN + ", r AS (SELECT unnest(range(1, 3)) AS copy) SELECT q, i, copy FROM rw, r WHERE i < 2")
def repeat_sampler(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).where("i < 2").select("q", "i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("copy"))


@P.add(f"WITH {V.HIST}{POP}, t AS (SELECT sum(n + 1) AS t FROM pop) SELECT item_id, round(pow((n + 1)::DOUBLE / t, 0.05), 6) AS propensity FROM pop, t")
def propensity(spark: SparkSession, d: str) -> DataFrame:
    rows = popularity(spark, d)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum(F.col("n") + 1).alias("t")))).select("item_id", F.round(F.pow((F.col("n") + 1) / F.col("t"), F.lit(0.05)), 6).alias("propensity"))


@P.add(f"WITH {V.RANKED} SELECT q, item, rank, round(1.0::DOUBLE / (rank + 1), 6) AS reciprocal, round((score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w > 1e-9 THEN stddev_pop(score) OVER w ELSE 1 END, 5) AS z, round(max(score) OVER w - score, 6) AS margin, round(score - avg(score) FILTER (rank < 100) OVER w, 11) AS minus_mean FROM ranked WHERE stream = 'direct' WINDOW w AS (PARTITION BY q)")
def score_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the direct scores; a flat list has the deviation 1.  z goes over the whole list, minus_mean over its first hundred."""
    rows = V.ranked(spark, d).where("stream = 'direct'")
    rows = U.with_totals(rows, F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), F.max("score").alias("most"), F.avg(F.when(F.col("rank") < 100, F.col("score"))).alias("top"))
    z = (F.col("score") - F.col("mean")) / F.when(F.col("deviation") > 1e-9, F.col("deviation")).otherwise(1.0)
    return rows.select("q", "item", "rank", F.round(F.lit(1.0) / (F.col("rank") + 1), 6).alias("reciprocal"), F.round(z, 5).alias("z"), F.round(F.col("most") - F.col("score"), 6).alias("margin"), F.round(F.col("score") - F.col("top"), 11).alias("minus_mean"))


# streams and their batch twins

@P.add(f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_popularity(spark: SparkSession, d: str) -> DataFrame:
    return T.stream_counts(spark, d)


@P.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return T.stream_windows(spark, d, "1 hour")


@P.add("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return T.stream_windows(spark, d, "1 hour", "30 minutes")


@P.add("SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return T.stream_sessions(spark, d, "6 hours")


@P.add("SELECT user_id, event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM events QUALIFY len(history) > 0")
def stream_history(spark: SparkSession, d: str) -> DataFrame:
    return T.stream_histories(spark, d, 3)


QUERIES, ORACLE = P.queries, P.oracle
