"""Fixtures with values worked out by hand: cases that the tables don't hold."""

import os
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from histrank.functions import text as X
from histrank.operators import alignment as A
from histrank.operators import quantize as K
from histrank.operators import sequences as S
from histrank.operators.cooccurrence import cooccurrences
from histrank.operators.expansion import expand
from histrank.plans import policies
from histrank.session import shared_dir
from histrank.streaming import streams as T
from tests.conftest import rows


def test_flat_values_are_scaled_to_a_half(spark):
    assert rows(S.min_max(spark.createDataFrame([(1, 3.0), (2, 3.0), (3, None)], "id int, v double"), "v", "x")) == [(1, 3.0, 0.5), (2, 3.0, 0.5), (3, None, None)]
    assert rows(S.min_max(spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 4.0)], "id int, v double"), "v", "x").select("id", "x")) == [(1, 0.0), (2, 1.0), (3, 0.5)]


def test_invalid_ids_are_expanded_only_on_request(spark):
    dim = spark.createDataFrame([(1, "ab", ["a", "b"]), (2, "ac", ["a", "c"])], "item bigint, sid string, tokens array<string>")
    pred = spark.createDataFrame([(7, 0, "ax", ["a", "x"])], "q int, sid_rank int, sid string, tokens array<string>")
    assert expand(pred, dim, (1,)).count() == 0
    assert [r["item"] for r in expand(pred, dim, (1,), invalid=True).orderBy("place").collect()] == [1, 2]
    good = pred.withColumns({"sid": F.lit("ab"), "tokens": F.array(F.lit("a"), F.lit("b"))})
    assert [(r["item"], r["source"]) for r in expand(good, dim, (1,)).orderBy("place").collect()] == [(1, "exact"), (2, "prefix@1")]


def test_strict_alignment_fails_with_counts(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "k int, t int, v string")
    assert rows(A.align_strict(a, b, "k", ["t"])) == [(1, 5, "x"), (2, 6, "y")]
    for wrong in (b.where("k = 1"), b.unionByName(b), b.withColumn("t", F.lit(5)), b.withColumn("k", F.nullif("k", F.lit(2)))):
        with pytest.raises(ValueError, match="align"):
            A.align_strict(a, wrong, "k", ["t"])
    with pytest.raises(ValueError, match="zipped"):
        A.zip_by_position(a, ["k"], b.where("k = 1"), ["k"])
    assert A.merge_one_to_one(a, b.withColumn("t", F.lit(5)), ["t", "k"])[1] == "k"
    with pytest.raises(ValueError, match="unique"):
        A.merge_one_to_one(a, b.unionByName(b), ["t", "k"])


def test_targets_belong_to_the_basket(spark):
    df = spark.createDataFrame([(1, [2, None, 3, 3])], "b int, items array<bigint>")
    assert rows(cooccurrences(df, "b", "items")) == [(2, 3, 1), (3, 2, 1)]


def test_policies_and_guard(spark):
    with pytest.raises(ValueError, match="unknown policy"):
        policies.policy_order(spark.range(1), "none")
    with pytest.raises(ValueError, match="leak"):
        policies.guard_features(["cf_rank", "Target_score"])
    assert policies.guard_features(["cf_rank"]) == ["cf_rank"]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "<b>A&nbsp;&eacute;</b> &amp;amp;  x"), (2, None), (3, "&nbsp;")], "id int, t string")
    assert rows(df.select("id", X.clean_text_unescaped(F.col("t")))) == [(1, "A é &amp; x"), (2, ""), (3, "")]
    nested = F.array(F.array(F.lit(" a "), F.lit("x</span>")), F.array(F.lit("b")))
    assert df.select(X.flat_categories(nested)).first()[0] == "a,b"
    images = F.array(F.struct(F.lit("").alias("hi_res"), F.lit(None).cast("string").alias("large"), F.lit("t").alias("thumb")))
    assert df.select(X.image_urls(images)).first()[0] == ["t"]


def test_late_events_are_dropped(spark):
    """An event of a later batch doesn't reopen a window that an earlier batch has closed."""
    path = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    seen = set()
    for i, times in enumerate((["2024-01-01 00:10:00", "2024-01-05 00:00:00"], ["2024-01-06 00:00:00"], ["2024-01-01 00:20:00", "2024-01-09 00:00:00"])):
        spark.createDataFrame([(t, "a") for t in times], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(path)
        for f in {*Path(path).glob("*.parquet")} - seen:  # the stream reads files in order of their times
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
            seen.add(f)
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(path)
    got = rows(T._closed(T.window_counts(stream, F.window("ts", "1 hour"), "event_type")).select(F.col("start").cast("string"), "n"))
    assert got == [("2024-01-01 00:00:00", 1), ("2024-01-05 00:00:00", 1), ("2024-01-06 00:00:00", 1)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        applicationId = "none"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_sinkhorn_fills_codes_evenly(spark):
    d = spark.createDataFrame([(i, [float(i), 4.0 + (i % 2), 9.0 - i]) for i in range(9)], "id int, d array<double>")
    got = K.sinkhorn_codes(d, "id", "d", 3).collect()
    assert sorted(r["id"] for r in got) == list(range(9)) and {c: [r["code"] for r in got].count(c) for c in range(3)} == {0: 3, 1: 3, 2: 3}
    assert {r["id"]: r["code"] for r in got}[0] == 0 and {r["id"]: r["code"] for r in got}[8] == 2
    assert K.sinkhorn_codes(d.where("false"), "id", "d", 3).count() == 0


def test_the_window_moves_back_until_there_are_items(spark):
    """Two items a year, each with two users: three items need two years."""
    rows_ = [(u, 10 * y + i, y * 100 + i) for y in range(4) for i in range(2) for u in ("a", "b")]
    df = spark.createDataFrame(rows_, "user_id string, item_id bigint, ts bigint")
    core, start = S.adaptive_core(df, k=2, start=300, first=0, least=3, year=100)
    assert start == 200 and {r["item_id"] for r in core.collect()} == {20, 21, 30, 31}
    core, start = S.adaptive_core(df, k=2, start=300, first=0, least=99, year=100)
    assert start == 0 and core.count() == 16


def test_too_few_rows_are_an_error(spark):
    assert rows(S.first_rows(spark.range(5), ["id"], 2)) == [(0,), (1,)]
    with pytest.raises(ValueError, match="5 there"):
        S.first_rows(spark.range(5), ["id"], 6)
