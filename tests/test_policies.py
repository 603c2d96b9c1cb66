"""Policies side by side: places counted from the candidates before the target, and no candidates in the driver."""

from collections import Counter

import duckdb
import pytest

from histrank.plans import policies
from tests.test_engine import SF, _norm

TABLES = ("candidates", "candidate_samples")


def _check(spark, d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{d}/{t}.parquet')")
    df = policies.policy_comparison(spark, d)
    cursor = con.execute(policies.ORACLE["policy_comparison"])
    names = [c[0] for c in cursor.description]
    got = Counter(tuple(map(_norm, r)) for r in df.select(*names).collect())
    assert got == Counter(tuple(map(_norm, r)) for r in cursor.fetchall())
    return df, sum(got.values())


def test_policy_comparison_keeps_candidates_out_of_the_driver(spark):
    df, n = _check(spark, SF.replace("sf0.001", "sf0.01"))
    assert n == 16
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("case", ["mixed", "no_direct", "no_cf", "no_candidates"])
def test_policy_comparison_on_odd_tables(spark, tmp_path, case):
    con = duckdb.connect()
    kinds = {"mixed": "CASE WHEN i % 3 = 0 THEN 'sasrec_direct' ELSE 'exact' END", "no_direct": "'exact'", "no_cf": "'sasrec_direct'", "no_candidates": "'exact'"}
    con.execute(f"""COPY (SELECT i AS candidate_id, CASE WHEN i % 2 = 0 THEN 1 ELSE i % 40 + 1 END AS sample_id, (i * 7919) % 211 AS item_id, {kinds[case]} AS source_type, (i * 31) % 97 + 1 AS candidate_rank,
        CASE WHEN i % 11 = 0 THEN NULL WHEN i % 13 = 0 THEN 'nan'::DOUBLE ELSE (i % 7) / 7.0::DOUBLE END AS fusion_score, 3 AS cf_expansion_level, 2::BIGINT AS cf_bucket_size, TIMESTAMP '2024-01-01' AS ingested_at
        FROM range({0 if case == "no_candidates" else 3000}) t(i)) TO '{tmp_path}/candidates.parquet'""")
    con.execute(f"""COPY (SELECT i % 50 AS sample_id, CASE WHEN i % 17 = 0 THEN NULL ELSE (i * 13) % 300 END AS target_item_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ingested_at FROM range(120) t(i))
        TO '{tmp_path}/candidate_samples.parquet'""")
    assert _check(spark, str(tmp_path))[1] == {"mixed": 16, "no_direct": 15, "no_cf": 15, "no_candidates": 0}[case]
