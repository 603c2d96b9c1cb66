"""Graph search and Markov clustering against brute force on small sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from histrank.llm import clusters, graph, vectors
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    out = []
    for i in range(400):
        v = (centres[i % 12] + 0.25 * rng.normal(size=16)) if i % 3 else rng.normal(size=16)
        out.append((1000 + i, [float(x) for x in v * rng.choice([1e-3, 1.0, 1e3])]))
    out += [(2000 + i, out[7][1]) for i in range(30)]  # copies
    out += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0] * 15 + [float("inf")]), (3005, [1.0] * 17), (3006, [None] + [1.0] * 15), (None, [1.0] * 16)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id bigint, v array<float>").withColumns({c: F.lit(1) for c in ("row", "copy", "rep", "members")})


def usable(data):
    ok = [(i, v) for i, v in data if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ok.sort()
    return np.array([i for i, _ in ok]), vectors.unit(np.array([v for _, v in ok], np.float32))


def test_nearest(spark, data, monkeypatch):
    ids, u = usable(data)
    cos = np.round(u @ u.T, 6)
    want = set()
    for i in range(len(ids)):
        near = [j for j in np.lexsort((ids, -cos[i])) if j != i and cos[i, j] >= 0.8][:5]
        want |= {(int(ids[i]), int(ids[j])) for j in near}
    for shard in (100_000, 150):  # one shard, several shards
        monkeypatch.setattr(vectors, "SHARD", shard)
        monkeypatch.setattr(vectors, "CELL", shard)
        got = {(r["row"], r["other"]) for r in vectors.nearest_rows(frame(spark, data), "id", "v", 16, 5, 0.8).collect()}
        assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)
        assert {p for p in got if p[0] >= 2000} == {p for p in want if p[0] >= 2000}  # ties of copies go to the smaller rows


def test_clusters(spark, data):
    ids, u = usable(data)
    cos = np.round(u @ u.T, 6)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(cos >= 0.8, 1))):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(int(ids[i]))
    want = {(min(g), i, len(g)) for g in groups.values() if len(g) >= 4 for i in g}
    got = {(r["first"], r["row"], r["n_rows"]) for r in clusters.similarity_clusters(frame(spark, data), "id", "v", 16, 0.8, 4).collect()}
    assert got == want


def test_empty(spark, data):
    none = frame(spark, data).where("false")
    assert vectors.nearest_rows(none, "id", "v", 16, 5, 0.8).count() == 0
    assert clusters.similarity_clusters(none, "id", "v", 16, 0.8, 4).count() == 0
    one = frame(spark, [(1, [1.0] * 16), (2, None)])
    assert vectors.nearest_rows(one, "id", "v", 16, 5, 0.8).count() == 0


def test_united(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(rows(clusters.united(spark.createDataFrame(edges, "u bigint, v bigint")).select("node", "root")))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    links, entries = graph.build(x)
    assert links.shape == (3000, graph.DEGREE) and (links[np.arange(3000)] != np.arange(3000)[:, None]).all()
    found, dist = graph.beam_search(x[:300], x, links, entries, 40)
    assert (np.diff(np.where(np.isfinite(dist), dist, 9), axis=1) >= 0).all()
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(t)) / 10 for f, t in zip(found.tolist(), true.tolist())]) > 0.9
