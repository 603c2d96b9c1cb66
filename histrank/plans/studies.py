"""Finer studies: slices, transitions, code usage, rewards' samplers, list texts, and the chain of leakage rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histrank.functions import sid as N
from histrank.functions import vector as A
from histrank.operators import metrics as M
from histrank.operators import quantize as K
from histrank.operators.packed import TITLES, packed_values
from histrank.operators import sequences as Q
from histrank.operators.sequences import global_rank
from histrank.plans.base import Plans
from histrank.plans.data import POP, popularity
from histrank.plans.learning import GEN, VEC, _centres, generations, unit_vectors
from histrank.plans.policies import HIT
from histrank.plans.sids import BASE, C, base
from histrank.session import materialize, table
from histrank.sources import files as S
from histrank.sources import views as V

P = Plans()

_HISTORY = "l AS (SELECT sample_id AS q, max(coalesce(len(history_item_id), 0)) AS len FROM candidate_samples WHERE sample_id IS NOT NULL GROUP BY 1)"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_samples").where("sample_id IS NOT NULL")
    return rows.groupBy(F.col("sample_id").alias("q")).agg(F.max(F.coalesce(F.array_size("history_item_id"), F.lit(0))).alias("len"))


@P.add(f"""WITH {V.HIST}{POP}, {V.RANKS}, {V.CAT}, {_HISTORY}, pb AS (SELECT array_to_string(tokens[:3], '') AS p, count(*) AS b FROM cat WHERE len(tokens) >= 3 GROUP BY 1),
tf AS (SELECT i, t, count(*) AS f FROM (SELECT unnest(tokens) AS t, unnest(range(1, len(tokens) + 1)) AS i FROM cat) GROUP BY 1, 2),
mf AS (SELECT item_id, min(f) AS f FROM (SELECT item_id, unnest(tokens) AS t, unnest(range(1, len(tokens) + 1)) AS i FROM cat) x JOIN tf ON tf.i = x.i AND tf.t = x.t GROUP BY 1),
x AS (SELECT r.cf, r.direct, CASE WHEN len(c.tokens) > 3 THEN 'yes' ELSE 'no' END AS a, CASE WHEN pb.b IS NULL THEN 'none' WHEN pb.b = 1 THEN '1' WHEN pb.b <= 5 THEN '2-5' ELSE '>5' END AS b, CASE WHEN mf.f IS NULL THEN 'none' WHEN mf.f < 5 THEN '<5' WHEN mf.f < 20 THEN '5-19' ELSE '>=20' END AS c,
  CASE WHEN coalesce(p.n, 0) = 0 THEN '0' WHEN p.n < 10 THEN '1-9' WHEN p.n < 50 THEN '10-49' ELSE '>=50' END AS e, CASE WHEN coalesce(l.len, 0) <= 5 THEN '<=5' WHEN l.len <= 10 THEN '6-10' ELSE '>10' END AS f, CASE WHEN coalesce(p.n, 0) = 0 THEN 'cold' ELSE 'warm' END AS g
  FROM ranks r LEFT JOIN cat c ON c.item_id = r.target LEFT JOIN pb ON pb.p = array_to_string(c.tokens[:3], '') AND len(c.tokens) >= 3 LEFT JOIN mf ON mf.item_id = r.target LEFT JOIN pop p ON p.item_id = r.target LEFT JOIN l ON l.q = r.q),
u AS (SELECT cf, direct, unnest(['dedup', 'prefix_bucket', 'token_frequency', 'popularity', 'history', 'cold']) AS slice, unnest([a, b, c, e, f, g]) AS value FROM x)
SELECT slice, value, count(*) AS n, round(avg(CASE WHEN cf < 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr20, round(avg(CASE WHEN cf < 20 THEN 1 / log2(cf + 2) ELSE 0 END), 6) AS ndcg20, round(avg(CASE WHEN cf IS NOT NULL OR direct IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS pool FROM u GROUP BY 1, 2""")
def six_slices(spark: SparkSession, d: str) -> DataFrame:
    """HR, NDCG and pool rate of the target by suffix, bucket of its prefix of three, rarest token, popularity, history and coldness."""
    cat = V.cat(spark, d).select(F.col("item_id").alias("target"), "tokens")
    prefix = N.sid_prefix(F.col("tokens"), 3)
    buckets = cat.select(prefix.alias("p")).where("p IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("b"))
    each = cat.select("target", F.posexplode("tokens").alias("i", "t"))
    rarest = each.join(each.groupBy("i", "t").agg(F.count(F.lit(1)).alias("f")), ["i", "t"]).groupBy("target").agg(F.min("f").alias("f"))
    pop = popularity(spark, d).select(F.col("item_id").alias("target"), F.col("n").alias("pop"))
    rows = V.ranks(spark, d).join(cat.withColumn("p", prefix), "target", "left").join(buckets, "p", "left").join(rarest, "target", "left").join(pop, "target", "left").join(_lengths(spark, d), "q", "left")
    n, b, f, h = F.coalesce("pop", F.lit(0)), F.col("b"), F.col("f"), F.coalesce("len", F.lit(0))
    values = {
        "dedup": F.when(F.size("tokens") > 3, "yes").otherwise("no"), "prefix_bucket": F.when(b.isNull(), "none").when(b == 1, "1").when(b <= 5, "2-5").otherwise(">5"),
        "token_frequency": F.when(f.isNull(), "none").when(f < 5, "<5").when(f < 20, "5-19").otherwise(">=20"), "popularity": F.when(n == 0, "0").when(n < 10, "1-9").when(n < 50, "10-49").otherwise(">=50"),
        "history": F.when(h <= 5, "<=5").when(h <= 10, "6-10").otherwise(">10"), "cold": F.when(n == 0, "cold").otherwise("warm"),
    }
    u = rows.select("cf", "direct", F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), v.alias("value")) for k, v in values.items()])).alias("s")).select("cf", "direct", "s.*", F.lit(20).alias("k"))
    hit = M.within("cf")
    return u.groupBy("slice", "value").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("hr20"), F.round(F.avg(F.when(hit, M.gain(F.col("cf"))).otherwise(0.0)), 6).alias("ndcg20"),
        F.round(F.avg((F.col("cf").isNotNull() | F.col("direct").isNotNull()).cast("double")), 6).alias("pool"),
    )


@P.add(f"""WITH {V.RANKS}, {V.CAT}, px AS (SELECT t.q, min(r.rank) AS prefix_rank FROM truth t JOIN cat a ON a.item_id = t.target AND len(a.tokens) >= 2 JOIN ranked r ON r.q = t.q AND r.stream = 'direct' JOIN cat b ON b.item_id = r.item AND b.tokens[:2] = a.tokens[:2] GROUP BY 1),
x AS (SELECT CASE WHEN coalesce(cf < 20, false) AND coalesce(direct < 20, false) THEN 'both_hit' WHEN cf < 20 THEN 'first_only' WHEN direct < 20 THEN 'second_only' ELSE 'both_miss' END AS transition, {HIT.format(r='cf')} AS a, {HIT.format(r='direct')} AS b,
  CASE WHEN coalesce(direct >= 20, true) AND coalesce(prefix_rank < 20, false) THEN 'yes' ELSE 'no' END AS c FROM ranks LEFT JOIN px ON px.q = ranks.q)
SELECT transition, u.field, u.value, count(*) AS n FROM (SELECT transition, unnest([{{'field': 'first_rank', 'value': a}}, {{'field': 'second_rank', 'value': b}}, {{'field': 'prefix_kept_exact_lost', 'value': c}}]) AS u FROM x) GROUP BY 1, 2, 3""")
def transition_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per transition from the cf to the direct list: ranks in both, and whether a prefix of two is kept though the item is lost."""
    cat = V.cat(spark, d).select("item_id", N.sid_prefix(F.col("tokens"), 2).alias("p")).where("p IS NOT NULL")
    wanted = V.truth(spark, d).join(cat.select(F.col("item_id").alias("target"), "p"), "target").select("q", "p")
    listed = V.ranked(spark, d).where("stream = 'direct'").select("q", F.col("item").alias("item_id"), "rank").join(cat, "item_id")
    kept = wanted.join(listed, ["q", "p"]).groupBy("q").agg(F.min("rank").alias("prefix_rank"))
    rows = V.ranks(spark, d).join(kept, "q", "left").withColumn("k", F.lit(20))
    a, b = M.within("cf"), M.within("direct")
    transition = F.when(a & b, "both_hit").when(a, "first_only").when(b, "second_only").otherwise("both_miss")
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    u = F.array(pair("first_rank", M.hit_bucket(F.col("cf"))), pair("second_rank", M.hit_bucket(F.col("direct"))), pair("prefix_kept_exact_lost", F.when(~b & M.within("prefix_rank"), "yes").otherwise("no")))
    return rows.select(transition.alias("transition"), F.explode(u).alias("u")).groupBy("transition", "u.field", "u.value").agg(F.count(F.lit(1)).alias("n"))


@P.add(f"""WITH {V.HIST}{POP}, {V.CAT}, t AS (SELECT unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS level, coalesce(n, 0) > 0 AS warm FROM cat LEFT JOIN pop USING (item_id)), c AS (SELECT level, token, count(*) AS n, count(*) FILTER (WHERE warm) AS w FROM t GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY level) AS total FROM c)
SELECT level, count(*) AS codes, sum(n)::BIGINT AS n, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(pow(2, -sum(n / total * log2(n / total))), 6) AS effective, count(*) FILTER (WHERE w > 0) AS warm_codes, count(*) FILTER (WHERE w < n) AS cold_codes, count(*) FILTER (WHERE w = 0) AS cold_only FROM s GROUP BY 1""")
def assignment_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Per level: codes, items per code, effective codes (two to the entropy), and the codes that warm and cold items use."""
    pop = popularity(spark, d).select("item_id", (F.col("n") > 0).alias("warm"))
    t = V.cat(spark, d).join(pop, "item_id", "left").select(F.posexplode("tokens").alias("p", "token"), F.coalesce("warm", F.lit(False)).alias("warm"))
    c = t.groupBy((F.col("p") + 1).cast("bigint").alias("level"), "token").agg(F.count(F.lit(1)).alias("n"), F.count_if("warm").alias("w"))
    c = c.join(F.broadcast(c.groupBy("level").agg(F.sum("n").alias("total"))), "level")
    share = F.col("n") / F.col("total")
    return c.groupBy("level").agg(
        F.count(F.lit(1)).alias("codes"), F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.pow(F.lit(2.0), -F.sum(share * F.log2(share))), 6).alias("effective"),
        F.count_if(F.col("w") > 0).alias("warm_codes"), F.count_if(F.col("w") < F.col("n")).alias("cold_codes"), F.count_if(F.col("w") == 0).alias("cold_only"),
    )


@P.add(C + f", b AS (SELECT *, {BASE} AS base, array_to_string(tokens[:3], '') AS p3 FROM cat), " + "g AS (SELECT unnest(['full', 'base', 'prefix3']) AS grain, unnest([sid, base, CASE WHEN len(tokens) >= 3 THEN p3 END]) AS s FROM b), c AS (SELECT grain, s, count(*) AS n FROM g WHERE s IS NOT NULL GROUP BY 1, 2) SELECT grain, sum(n)::BIGINT AS n_items, count(*) AS n_sids, round(1 - count(*)::DOUBLE / sum(n), 6) AS collision_rate, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS collided_items FROM c GROUP BY 1")
def structural_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Collisions of whole ids, of ids without suffix, and of prefixes of three."""
    rows = base(spark, d)
    grains = F.array(*[F.struct(F.lit(g).alias("grain"), c.alias("s")) for g, c in (("full", F.col("sid")), ("base", F.col("base")), ("prefix3", N.sid_prefix(F.col("tokens"), 3)))])
    c = rows.select(F.explode(grains).alias("x")).select("x.*").where("s IS NOT NULL").groupBy("grain", "s").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("grain").agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_sids"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("collision_rate"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("collided_items"))


@P.add(GEN + ", r AS (SELECT unnest(range(1, 5)) AS copy), o AS (SELECT q, i, row_number() OVER (ORDER BY sha256('42:' || q || ':' || i), q, i) - 1 AS n FROM rw) SELECT n * 4 + copy - 1 AS place, q, i, copy FROM o, r")
def repeat_sampler_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """All generations in an order that a seeded hash shuffles, each four times in a row."""
    rows = generations(spark, d).select("q", "i").withColumn("h", F.sha2(F.concat_ws(":", F.lit("42"), "q", "i"), 256))
    placed, _ = global_rank(rows, ["h", "q", "i"], "n")
    return placed.select("n", "q", "i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("copy")).select((F.col("n") * 4 + F.col("copy") - 1).alias("place"), "q", "i", "copy")


@P.add("SELECT row_id, regexp_extract_all(history_item_sid, '(?:<[A-Za-z]_[0-9]+>)+') AS sids FROM (SELECT DISTINCT row_id, history_item_sid FROM title_histories WHERE history_item_sid IS NOT NULL)")
def list_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lists of semantic ids in any notation: JSON, Python literals, or values between delimiters."""
    rows = table(spark, d, "title_histories").where("history_item_sid IS NOT NULL").select("row_id", "history_item_sid").distinct()
    return rows.select("row_id", packed_values(F.col("history_item_sid"), TITLES).alias("v")).select("row_id", F.col("v.item_value").alias("sids"))


_RAW = "CASE event_id % 6 WHEN 0 THEN event_id || '.0' WHEN 1 THEN ' ' || event_id || ' ' WHEN 2 THEN event_id || '.5' WHEN 3 THEN 'true' WHEN 4 THEN 'B0' || event_id ELSE '-' || event_id || '.00' END"


@P.add(f"SELECT event_id, CASE WHEN regexp_full_match(r, '-?[0-9]+[.]0+') THEN regexp_replace(r, '[.]0+$', '') ELSE r END AS item FROM (SELECT event_id, trim({_RAW}) AS r FROM events)")
def item_ids_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Item ids written as whole and broken numbers, with blanks, as words and codes, in one form."""
    return table(spark, d, "events").select("event_id", N.normalise_id(F.expr(_RAW)).alias("item"))


@P.add(f"WITH {V.INTER} SELECT user_id, item_id, ts, items, ratings, times, titles FROM (SELECT user_id, inter.item_id, ts, list(inter.item_id) OVER w AS items, list(coalesce(rating, -1)) OVER w AS ratings, list(ts) OVER w AS times, list(coalesce(title, '')) OVER w AS titles FROM inter LEFT JOIN items USING (item_id) WINDOW w AS (PARTITION BY user_id ORDER BY ts, inter.item_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE len(items) > 0")
def sliding_lists(spark: SparkSession, d: str) -> DataFrame:
    """Up to ten earlier items of each interaction with their ratings (-1: none), times and titles, as lists of equal length."""
    w = Window.partitionBy("user_id").orderBy("ts", "item_id").rowsBetween(-10, -1)
    rows = V.inter(spark, d).join(table(spark, d, "items").select("item_id", "title"), "item_id", "left")
    each = F.collect_list(F.struct("item_id", F.coalesce("rating", F.lit(-1.0)).alias("rating"), "ts", F.coalesce("title", F.lit("")).alias("title"))).over(w)
    rows = rows.select("user_id", "item_id", "ts", each.alias("h")).where(F.size("h") > 0)
    return rows.select("user_id", "item_id", "ts", F.col("h.item_id").alias("items"), F.col("h.rating").alias("ratings"), F.col("h.ts").alias("times"), F.col("h.title").alias("titles"))


@P.add("""SELECT item_type, u.metric, u.value FROM (SELECT item_type, unnest([{'metric': 'counts.rows', 'value': count(*)::VARCHAR}, {'metric': 'counts.titles.filled', 'value': count(title)::VARCHAR}, {'metric': 'counts.titles.missing', 'value': (count(*) - count(title))::VARCHAR}, {'metric': 'first_ids', 'value': '[' || min(item_id) || ']'}]) AS u FROM items GROUP BY 1)""")
def nested_report(spark: SparkSession, d: str) -> DataFrame:
    """A nested report as long rows: paths joined by dots, lists as JSON."""
    one = table(spark, d, "items").groupBy("item_type").agg(F.count(F.lit(1)).alias("rows"), F.count("title").alias("t"), F.array(F.min("item_id")).alias("first_ids"))
    nested = one.select("item_type", F.struct("rows", F.struct(F.col("t").alias("filled"), (F.col("rows") - F.col("t")).alias("missing")).alias("titles")).alias("counts"), "first_ids")
    return S.flatten_nested(nested, ["item_type"])


@P.add(f"""WITH {V.HIST}, v AS (SELECT DISTINCT item_id FROM hist WHERE split <> 'train' EXCEPT (SELECT item_id FROM hist WHERE split = 'train' UNION SELECT unnest(history) FROM hist WHERE split = 'train')), r AS (SELECT count(*) AS n FROM hist WHERE split = 'train'),
c AS (SELECT (SELECT count(*) FROM v JOIN item_vectors USING (item_id) WHERE list_sum(list_transform(matrix, lambda x: abs(x))) > 0 AND list_sum(list_transform(matrix, lambda x: abs(x))) < 'Infinity'::FLOAT) AS nonzero, (SELECT n FROM r) > 0 AS rows_match)
SELECT nonzero, rows_match, CASE WHEN nonzero > 0 THEN 'POSSIBLE_LEAKAGE' WHEN rows_match THEN 'CLEAN_TRAIN_ONLY' ELSE 'UNKNOWN' END AS verdict FROM c""")
def leakage_rules(spark: SparkSession, d: str) -> DataFrame:
    """The chain of rules: items seen outside training only must have no vector that tells of interactions."""
    h = materialize(V.hist(spark, d).select("item_id", "history", "split"), "hist")
    train = h.where("split = 'train'")
    seen = train.select("item_id").union(train.select(F.explode("history")))
    new = h.where("split <> 'train'").select("item_id").distinct().join(seen.distinct(), "item_id", "left_anti")
    size = F.aggregate("matrix", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    nonzero = table(spark, d, "item_vectors").withColumn("size", size).where("size > 0 AND size < double('Infinity') AND NOT isnan(size)").join(new, "item_id", "left_semi").agg(F.count(F.lit(1)).alias("nonzero"))
    checks = nonzero.crossJoin(F.broadcast(train.agg((F.count(F.lit(1)) > 0).alias("rows_match"))))
    return checks.select("nonzero", "rows_match", verdict(F.lit(None).cast("boolean"), F.col("nonzero"), [F.col("rows_match"), F.col("nonzero") == 0]).alias("verdict"))


def verdict(says_clean: Column, nonzero: Column, signals: list[Column]) -> Column:
    """CONFIRMED_LEAKAGE where the report itself says so, POSSIBLE_LEAKAGE where new items have vectors, CLEAN_TRAIN_ONLY where all
    signals are true, UNKNOWN where one is null and none false, else POSSIBLE_LEAKAGE."""
    every, unknown = F.lit(True), F.lit(False)
    for s in signals:
        every, unknown = every & F.coalesce(s, F.lit(False)), unknown | s.isNull()
    return F.when(~says_clean, "CONFIRMED_LEAKAGE").when(nonzero > 0, "POSSIBLE_LEAKAGE").when(every, "CLEAN_TRAIN_ONLY").when(unknown, "UNKNOWN").otherwise("POSSIBLE_LEAKAGE")


# vectors


@P.add(f"""WITH {VEC}, h AS (SELECT sample_id AS q, any_value(history_item_id) AS h FROM candidate_samples WHERE sample_id % 100 = 0 GROUP BY 1 HAVING count(DISTINCT history_item_id) <= 1),
e AS (SELECT q, u, i FROM (SELECT q, unnest(h) AS item_id, 1 AS i FROM h) JOIN uv USING (item_id)), m AS (SELECT q, j, avg(x) AS x FROM (SELECT q, unnest(u) AS x, unnest(range(64)) AS j FROM e) GROUP BY 1, 2), v AS (SELECT q, list(x ORDER BY j) AS x FROM m GROUP BY 1)
SELECT q, item, score FROM (SELECT q, item_id AS item, round(list_sum(list_transform(list_zip(x, u), lambda z: z[1] * z[2])), 5) + 0.0 AS score FROM v, uv) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, item) <= 20""")
def direct_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The 20 items whose vectors score best against the mean vector of the history, for samples whose id is divisible by 100."""
    u = unit_vectors(spark, d)
    rows = table(spark, d, "candidate_samples").where("sample_id % 100 = 0").groupBy(F.col("sample_id").alias("q")).agg(F.first("history_item_id", ignorenulls=True).alias("h"), F.countDistinct("history_item_id").alias("n")).where("n <= 1")
    each = rows.select("q", F.explode("h").alias("item_id")).join(u, "item_id").select("q", F.posexplode("u").alias("j", "x"))
    means = each.groupBy("q", "j").agg(F.avg("x").alias("x")).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("x"))
    return K.best_scores(means, u.select(F.col("item_id").alias("item"), "u"), 20)


@P.add()
def collision_reassignment(spark: SparkSession, d: str) -> DataFrame:
    """Residual codes of three levels whose last one moves on where several items share all of them."""
    rows = K.residual_kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", levels=2, k=8).select("vec_id", F.col("codes").alias("prefix"))
    vectors = table(spark, d, "embeddings").select("vec_id", "label", A.finite(F.col("embedding")).alias("v"))
    centres = _centres(vectors).orderBy("label").collect()  # a fixed number of labels
    far = F.array(*[F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in c["centre"]]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for c in centres])
    return K.reassigned(rows.join(vectors.select("vec_id", far.alias("distances")), "vec_id"), "vec_id")


@P.add("SELECT count(*) AS n, count(DISTINCT vec_id) AS n_keys, (SELECT count(DISTINCT label) FROM embeddings) AS n_codes, true AS within_capacity FROM embeddings")
def sinkhorn_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Vectors mapped to the label centres by entropic transport: all are placed, and no code holds more than its capacity."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label", A.finite(F.col("embedding")).alias("v"))
    centres = _centres(vectors).orderBy("label").collect()  # a fixed number of labels
    far = F.array(*[F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in c["centre"]]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for c in centres])
    capacity = -(-vectors.count() // max(1, len(centres)))
    codes = materialize(K.sinkhorn_codes(vectors.select("vec_id", far.alias("d")), "vec_id", "d", capacity), "codes")
    sizes = codes.groupBy("code").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n_codes"), (F.max("c") <= capacity).alias("within_capacity"))
    return codes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_keys")).crossJoin(F.broadcast(sizes))


@P.add()
def adaptive_kcore_window(spark: SparkSession, d: str) -> DataFrame:
    """The core of the interactions from a start on that moves back year by year until enough items are left."""
    return Q.adaptive_core(V.inter(spark, d), k=5, start=1_530_000_000, first=820_454_400, least=300)[0]


@P.add("SELECT count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples, count(*) FILTER (WHERE history_item_id IS NULL) AS null_histories, count(*) FILTER (WHERE len(history_item_id) = 0) AS empty_histories, min(len(history_item_id)) AS shortest, max(len(history_item_id)) AS longest, round(avg(len(history_item_id)), 6) AS mean, count(DISTINCT target_item_id) AS n_targets, count(*) FILTER (WHERE target_item_id IS NULL) AS null_targets FROM candidate_samples")
def history_inventory(spark: SparkSession, d: str) -> DataFrame:
    n = F.array_size("history_item_id")
    return table(spark, d, "candidate_samples").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sample_id").alias("n_samples"), F.count_if(F.col("history_item_id").isNull()).alias("null_histories"), F.count_if(n == 0).alias("empty_histories"),
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.countDistinct("target_item_id").alias("n_targets"), F.count_if(F.col("target_item_id").isNull()).alias("null_targets"),
    )


QUERIES, ORACLE = P.queries, P.oracle
