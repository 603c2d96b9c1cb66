"""Micro fixtures with values worked out by hand, metamorphic checks, and parity of all core queries on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from histrank.functions.sid import codes_to_sid, sid_prefixes, sid_tokens
from histrank.operators import fusion as U
from histrank.operators import metrics as M
from histrank.operators import quantize as K
from histrank.operators import rewards as G
from histrank.operators import sequences as S
from histrank.plans import data, extra, files, general, learning, policies, ranking, sids, studies
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
MODULES = [general, data, sids, ranking, policies, learning, files, extra, studies]


def test_metrics(spark):
    df = spark.createDataFrame([(0,), (2,), (None,), (19,)], "rank int")
    got = {r["k"]: (r["hr"], r["ndcg"]) for r in M.hr_ndcg(df, "rank", (1, 3, 20)).collect()}
    assert got == {1: (0.25, 0.25), 3: (0.5, 0.375), 20: (0.75, 0.431918)}
    assert df.agg(M.mrr(df, "rank")).first()[0] == 0.345833


def _streams(spark, a, b):
    out = [(1, x, s, i, 1.0, "exact", 3, 1) for s, items in (("cf", a), ("direct", b)) for i, x in enumerate(items)]
    return U.both_streams(spark.createDataFrame(out, "q int, item int, stream string, rank int, score double, source string, level int, bucket int"))


def test_fusion(spark):
    z = _streams(spark, [1, 2, 3], [3, 8, 2])
    got = [(r["item"], round(r["fused"], 9)) for r in U.rrf(z).orderBy("rank").collect()]
    assert got == [(3, 0.016133229), (2, 0.016001024), (1, 0.008196721), (8, 0.008064516)]
    got = [(r["item"], round(r["fused"], 9)) for r in U.source_aware_rrf(z, 1.0, 0.0).orderBy("rank").collect()]
    assert got == [(3, 0.032266458), (2, 0.032002048), (1, 0.016393443), (8, 0.016129032)]
    assert [r["item"] for r in U.ordered_union(z).orderBy("rank").collect()] == [1, 2, 3, 8]
    assert [r["item"] for r in U.ordered_union(z, exclusive=0).orderBy("rank").collect()] == [1, 2, 3]


def test_promotion_keeps_the_cf_order(spark):
    z = _streams(spark, list(range(25)), [100, 3, 101, 102]).withColumn("probability", F.when(F.col("direct").isNotNull(), 1 / (F.col("direct") + 1.0)).otherwise(-1.0))
    order = [(r["item"], r["promoted"]) for r in U.tail_promotion(z, 2, 0.3).orderBy("new_rank").collect()]
    assert [x for x, _ in order[:20]] == [*range(18), 100, 101]
    assert [x for x, _ in order[20:]] == [18, 19, 20, 21, 22, 23, 24, 102]


def test_rewards(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, False), (1, 3, False), (2, 0, True), (2, 1, False), (2, 2, False), (2, 3, False)], "q int, i int, hit boolean")
    got = {(r["q"], r["i"]): round(r["ndcg"], 6) for r in G.rule_reward(df).collect()}
    assert [got[1, i] for i in range(4)] == [0.0] * 4
    assert [got[2, i] for i in range(4)] == [0.0, -0.246302, -0.195190, -0.168128]
    got = [round(r[0], 4) for r in G.rule_reward(df).where("q = 2").select(G.group_advantage("rule")).collect()]
    assert sorted(got) == [-0.4999, -0.4999, -0.4999, 1.4997]


def test_sids(spark):
    df = spark.createDataFrame([("<a_1> <b_22><c_3>",), ("<a_1>x",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(sid_tokens(F.col("s"))).collect()] == [["<a_1>", "<b_22>", "<c_3>"], [], [], []]
    assert [len(r[0]) for r in df.select(sid_prefixes(sid_tokens(F.col("s")))).collect()] == [3, 0, 0, 0]
    assert spark.range(1).select(codes_to_sid(F.array(F.lit(4), F.lit(0)))).first()[0] == "<a_4><b_0>"


def test_sequences(spark):
    df = spark.createDataFrame([("u", 10, 1), ("u", 11, 2), ("u", 12, 3), ("v", 10, 9)], "user_id string, item_id int, ts int")
    assert rows(S.sliding_history(df).select("history", "item_id")) == [([10, 11], 12), ([10], 11)]
    split = {r["split"]: r["count"] for r in S.chronological_split(spark.range(57).select(F.col("id").alias("ts")), ["ts"]).groupBy("split").count().collect()}
    assert split == {"train": 45, "valid": 6, "test": 6}
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",)], "u string")
    assert all(r["split"] == ("fit" if r["bucket"] < 60 else "select" if r["bucket"] < 80 else "gate") for r in S.hash_split(users, F.col("u")).collect())
    shards = Counter(r["shard"] for r in S.row_range_shards(spark.range(10), ["id"], 3).collect())
    assert [shards[i] for i in range(3)] == [3, 3, 4]
    core, rounds = S.kcore(df, 2)
    assert core.count() == 0 and rounds >= 2
    assert S.global_rank(df.where("false"), ["ts"])[0].count() == 0


def test_quantisation(spark):
    df = spark.createDataFrame([(i, [float(i % 3) + 0.01 * (i % 5), float(i % 2)]) for i in range(60)], "id int, v array<double>")
    one = K.residual_kmeans(df, "id", "v", 1, 4).agg(F.sum("residual")).first()[0]
    two = K.residual_kmeans(df, "id", "v", 2, 4)
    assert two.agg(F.sum("residual")).first()[0] <= one + 1e-9
    assert all(0 <= c < 4 for r in two.collect() for c in r["codes"])
    d = spark.createDataFrame([(i, [float(i), 1.0, 5.0]) for i in range(9)], "id int, d array<double>")
    got = rows(K.balanced_codes(d, "id", "d", 3))
    assert len(got) == 9 and set(Counter(c for _, c in got).values()) == {3}


def test_svd_and_retrieval(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    b = rng.normal(size=(12, 3))
    m = b @ b.T
    pairs = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12)], "item_a bigint, item_b bigint, ppmi double")
    f = np.array([r["factor"] for r in K.truncated_svd(pairs, 3).orderBy("item_a").collect()])
    assert np.allclose(f @ f.T, m, atol=1e-6)
    assert K.truncated_svd(pairs, 5).count() == 12 and K.truncated_svd(pairs.where("false"), 2).count() == 0
    u, x = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "item bigint, u array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q bigint, x array<double>")
    s = np.round(x @ u.T, 5)
    want = sorted((i, int(j), float(s[i, j])) for i in range(7) for j in np.lexsort((np.arange(50), -s[i]))[:5])
    assert sorted(tuple(r) for r in K.best_scores(queries, items, 5, block=8).collect()) == want


def test_collisions_move_on(spark):
    df = spark.createDataFrame([(i, [0], [1.0 + i, 2.0, 3.0]) for i in range(4)], "id int, prefix array<int>, distances array<double>")
    got = {r["id"]: r["code"] for r in K.reassigned(df, "id").collect()}
    assert got[0] == 0 and set(got.values()) == {0, 1, 2}  # four rows, three codes


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(n for m in MODULES for n in m.ORACLE))
def test_parity(spark, duck, name):
    query = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    sql = next(m.ORACLE[name] for m in MODULES if name in m.ORACLE)
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(_norm, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(_norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(n for m in MODULES for n in m.QUERIES if n not in m.ORACLE))
def test_runs(spark, name):
    query = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    assert query(spark, SF).count() >= 0


def test_nothing_imports_the_subpackage():
    root = Path(general.__file__).resolve().parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "histrank.llm" in p.read_text()]
