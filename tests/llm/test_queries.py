"""Queries of the subpackage: SQL where there is some, shape where not."""

from collections import Counter

import pytest

from histrank.llm import queries
from tests.test_engine import SF, _norm, duck  # noqa: F401

COLUMNS = {
    "p2_found": ["item_a", "item_b"], "p3_found": ["row_index_a", "row_index_b"], "p4_found": ["cluster_first", "row_index"], "p5_found": ["sample_id", "item_id"],
    "p6_found": ["sample_id_a", "sample_id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_parity(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(_norm, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(queries.ORACLE[name])
    names = [c[0] for c in cursor.description]
    want = Counter(tuple(_norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns and got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_shape(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() == df.distinct().count()
