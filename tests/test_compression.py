"""Value-frequency compression against brute force, with a key that holds most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from histrank.operators import compression as C
from tests.conftest import rows


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    out = [(1 if rng.random() < 0.6 else rng.randint(2, 9), rng.choice([None, float("nan"), *map(float, range(40))])) for _ in range(3000)]
    return [*out, (None, 1.0), (77, None), (78, float("nan")), (79, 5.0)]


def test_counts_modes_percentiles(spark, data):
    df = spark.createDataFrame(data, "k int, v double").withColumn("key", F.lit("clash")).withColumn("value", F.lit(0))
    w = C.compress(df, F.col("k"), F.col("v"))
    by = {}
    for k, v in data:
        if k is not None:
            by.setdefault(k, []).append(v)
    for k, n, m in rows(C.key_counts(w)):
        assert (n, m) == (len(by[k]), len({"nan" if v != v else v for v in by[k] if v is not None}))
    got = {(k, p): v for k, p, v in rows(C.key_percentiles(w, [0.0, 0.5, 0.95, 1.0]))}
    for k, vs in by.items():
        real = sorted(v for v in vs if v is not None and v == v)
        for p in (0.0, 0.5, 0.95, 1.0):
            assert got.get((k, p)) == (real[max(1, math.ceil(p * len(real))) - 1] if real else None)
    modes = {k: (m, n) for k, m, n in rows(C.key_modes(w))}
    assert 77 not in modes and modes[79] == (5.0, 1)


def test_heavy_keys_and_empty(spark, data):
    df = spark.createDataFrame(data, "k int, v double").where("v IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    w = C.compress(df, F.col("k"), F.col("id"))
    assert [r[0] for r in rows(C.heavy_keys(w, 0.3, disjoint=False))] == [1]
    none = C.compress(df.where("false"), F.col("k"), F.col("v"))
    assert rows(C.key_counts(none)) == rows(C.key_modes(none)) == rows(C.key_percentiles(none, [0.5])) == rows(C.heavy_keys(none, 0.1, True)) == []
