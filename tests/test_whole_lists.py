"""Queries on ranked lists keep whole lists: places across partitions, and parity with SQL that cuts nothing."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from histrank.operators import fusion as U
from histrank.operators.sequences import group_rank
from histrank.plans import extra, learning, ranking
from histrank.sources import views as V
from tests.conftest import rows
from tests.test_engine import SF, _norm, duck  # noqa: F401

MODULES = [ranking, learning, extra]
LONG = SF.replace("sf0.001", "sf0.01")  # sf0.001 has no list of more than V.LIST
NAMES = [
    "candidate_full_outer", "ordered_union", "ordered_union_limited", "candidate_overlap", "rrf_fusion", "min_rank_fusion", "source_aware_rrf", "fusion_sweep", "ranker_features", "cf_quota_reorder", "tail_promotion",
    "mrr", "rank_distribution", "topk_stable", "pessimistic_rank", "candidate_view_audit", "score_features", "legacy_invalid_counter",
]


def test_group_rank_across_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id") % 9 + 2).alias("q"), ((F.col("id") * 7919) % 3001).alias("x"))
        got = rows(group_rank(df, ["q"], [F.desc("x")]))
        assert len({r["_part"] for r in df.repartitionByRange("q", "x").select(F.spark_partition_id().alias("_part")).distinct().collect()}) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = {}
    for q, x in rows(df):
        groups.setdefault(q, []).append(x)
    assert got == sorted(((q, x, i) for q, xs in groups.items() for i, x in enumerate(sorted(xs, reverse=True))), key=repr)


def test_lists_beyond_fifty(spark):
    out = [(1, x, s, i, 1.0, "exact", 3, 1) for s, n in (("cf", 120), ("direct", 70)) for i, x in enumerate(range(n))]
    z = U.both_streams(spark.createDataFrame(out, "q int, item int, stream string, rank int, score double, source string, level int, bucket int"))
    assert [r["item"] for r in U.ordered_union(z).orderBy("rank").collect()] == list(range(120))
    assert U.rrf(z).agg(F.max("rank")).first()[0] == 119


@pytest.mark.parametrize("name", NAMES)
def test_whole_parity(spark, name):
    query, sql = next((m.QUERIES[name], m.ORACLE[name]) for m in MODULES if name in m.QUERIES)
    assert not re.search(r"WHERE rank < \d+\)", sql)
    con = duckdb.connect()
    for p in Path(LONG).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}')")
    df = query(spark, LONG)
    columns = sorted(df.columns)
    got = Counter(tuple(map(_norm, r)) for r in df.select(*columns).collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert got == Counter(tuple(_norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["exact_expand", "prefix_expand", "candidate_report"])
def test_whole_expansion(spark, duck, name):  # noqa: F811
    """All predicted ids and all items they bring, as in the SQL, which has no cut at a number of ids or items."""
    sql = learning.ORACLE[name]
    assert not re.search(r"rank < \d+\)|place < \d+", sql)
    df = learning.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(_norm, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert got == Counter(tuple(_norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_all_negatives_are_learnt_from(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(learning.K, "pairwise_ranker", lambda positives, negatives, names: seen.update(p=positives.count(), n=negatives.count()) or {x: 0.0 for x in names})
    learning.pairwise_ranker(spark, SF)
    every = U.both_streams(V.ranked(spark, SF)).join(V.truth(spark, SF), "q")
    assert seen == {"p": every.where("item = target").count(), "n": every.where("item <> target").count()}
