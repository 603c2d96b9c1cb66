"""Pair mining, top N and cross-split overlaps against brute force."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from histrank.llm import overlap, pairs, topn
from tests.conftest import rows


def test_pairs(spark):
    rng = random.Random(2)
    data = [(i, [rng.choice([1, 1, 1, 2, 3, 4, 5, 6, None]) for _ in range(rng.randint(0, 6))] if i % 9 else None) for i in range(200)]
    data += [(i, [50, 51, 1]) for i in range(300, 312)] + [(300, [50, 51, 1]), (301, [52]), (None, [50, 51])]
    data += [(400, list(range(60, 260)))]  # a long basket
    df = spark.createDataFrame(data, "b int, x array<int>").withColumns({"items": F.lit(1), "weight": F.lit(2), "n": F.lit(3)})
    sets = {}
    for b, x in data:
        if b is not None and x:
            sets.setdefault(b, set()).update(i for i in x if i is not None)
    sets = {b: s for b, s in sets.items() if s}
    n, one, two = len(sets), Counter(), Counter()
    for s in sets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    for support, lift in ((8, 4.0), (3, 1.0), (1, 2.0)):
        want = {(a, b): (c, one[a], one[b], n) for (a, b), c in two.items() if c >= support and c * n >= lift * one[a] * one[b]}
        got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in pairs.item_pairs(df, "b", "x", support, lift).collect()}
        assert got == want
    assert pairs.item_pairs(df.where("false"), "b", "x", 1, 1.0).count() == 0


def test_top_n(spark):
    rng = random.Random(3)
    scores = [None, float("nan"), float("inf"), float("-inf"), 0.0, -1e-300, 1e300, 0.5, 0.5000000001, 0.25]
    data = [(rng.choice([1, 1, 1, 2, None]), i, rng.randint(1, 4), rng.choice(scores)) for i in range(-300, 300)]
    data += [(3, 7, 1, 1.0), (4, 1, 2, None), (4, 2**62, 2, None), (4, -(2**62), 2, None)] + [(5, i, 9, 0.5) for i in range(40)]
    df = spark.createDataFrame(data, "grp int, item bigint, r bigint, s double").withColumns({"code": F.lit(1), "g": F.lit(2), "part": F.lit(0), "need": F.lit(0)})
    code = [*topn.long_words(F.col("r")), *topn.descending_words(F.col("s")), *topn.long_words(F.col("item"))]
    want = []
    for g in (1, 2, 3, 4, 5):
        key = lambda x: (x[2], x[3] is None or x[3] != x[3], -x[3] if x[3] is not None and x[3] == x[3] else 0, x[1])
        want += [(g, x[1]) for x in sorted((x for x in data if x[0] == g), key=key)[:5]]
    assert rows(topn.top_n(df, "grp", 5, code, ["item"])) == sorted(want, key=repr)
    assert topn.top_n(df.where("false"), "grp", 5, code, ["item"]).count() == 0


def test_no_pair_is_lost(spark):
    """All pairs of sets of 4 to 9 of 9 items with a similarity of 0.6 or more share a fingerprint."""
    sets = [tuple(str(i) for i in range(9) if code >> i & 1) for code in range(512) if code.bit_count() >= 4]
    df = spark.createDataFrame([(f"{s}{i}", s, 1, list(x)) for i, x in enumerate(sets) for s in ("train", "eval")], "class string, side string, target int, items array<string>")
    want = {(f"train{i}", f"eval{j}") for i, x in enumerate(sets) for j, y in enumerate(sets) if 10 * len({*x} & {*y}) >= 6 * len({*x} | {*y})}
    assert {(r["train"], r["eval"]) for r in overlap.class_overlaps(df, 0.6).collect()} == want


@pytest.mark.parametrize(("seed", "salt"), [(1, 5_000), (2, 3)])
def test_overlap(spark, monkeypatch, seed, salt):
    monkeypatch.setattr(overlap, "SALT_ROWS", salt)
    rng = random.Random(seed)
    data = []
    for i in range(260):
        base = [str(rng.randint(1, 12)) for _ in range(rng.randint(0, 9))]
        data.append((i, rng.choice(["train", " TRAIN", "test", "valid", None]), rng.choice([1, 1, 1, 2, None]), base if i % 17 else None))
    data += [data[5], (None, "test", 1, ["1", "2", "3", "4"]), (900, "train", 3, [str(x) for x in range(3000)]), (901, "test", 3, [str(x) for x in range(2500)])]
    df = spark.createDataFrame(data, "id int, split string, target int, items array<string>")
    records = df.withColumn("side", overlap.side_of(F.col("split"))).withColumns({"class": F.lit("x"), "m": F.lit(0), "pos": F.lit(0)})
    want = set()
    sets = {(i, "train" if s.strip().lower() == "train" else "eval", t, frozenset(x)) for i, s, t, x in data if i is not None and s is not None and t is not None and x and len(set(x)) >= 4}
    for i, s, t, x in sets:
        for j, s2, t2, y in sets:
            if s == "train" and s2 == "eval" and t == t2 and i != j and 10 * len(x & y) >= 6 * len(x | y):
                want.add((i, j))
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_pairs(records, 0.6, 4).collect()}
    assert got == want and (900, 901) in got
    share = {}
    for i, s, t, x in sets:
        for j, s2, t2, y in sets:
            if (i, j) in want and s == "train" and s2 == "eval" and t == t2 and 10 * len(x & y) >= 6 * len(x | y):
                share[j] = max(share.get(j, 0), len(x & y) / len(y))
    of = overlap.record_coverage(records.withColumn("source", F.lit("s")), 0.6, 4).collect()
    assert {r["id"] for r in of} == {j for _, j in want}
    assert all(r["train_source"] == "s" and abs(r["coverage"] - share[r["id"]]) < 1e-9 for r in of)
    assert overlap.cross_split_pairs(records.where("false"), 0.6, 4).count() == 0
