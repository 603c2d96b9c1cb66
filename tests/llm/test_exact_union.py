"""Dense groups fill each other's beams; the exact step unites them all the same."""

import numpy as np
import pytest

from histrank.llm import clusters, vectors


def dense_groups(cosine):
    """Two groups of 200 different vectors, about 0.99 alike within a group, with the given cosine between their centres."""
    rng = np.random.default_rng(3)
    a, b = np.eye(64)[0], cosine * np.eye(64)[0] + np.sqrt(1 - cosine**2) * np.eye(64)[1]
    m = np.concatenate([c + 0.0125 * rng.normal(size=(200, 64)) for c in (a, b)]).astype(np.float32)
    return m, vectors.unit(m)


@pytest.mark.parametrize("cosine, groups", [(0.87, 1), (0.7, 2)])
@pytest.mark.parametrize("shard", [100_000, 150])
def test_dense_groups(spark, monkeypatch, cosine, groups, shard):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "CELL", shard)
    m, u = dense_groups(cosine)
    cross = u[:200] @ u[200:].T
    assert (cross >= 0.8).all() if groups == 1 else (cross < 0.8).all()
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<float>")
    got = {(r["first"], r["n_rows"]) for r in clusters.similarity_clusters(df, "id", "v", 64, 0.8, 4).collect()}
    assert got == ({(0, 400)} if groups == 1 else {(0, 200), (200, 200)})
