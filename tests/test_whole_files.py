"""The JSON map and set hold the whole table, in objects of bounded size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from histrank.plans import files
from histrank.sources import files as S
from tests.conftest import rows

SF = "/root/testdata/sf0.01"
WANT = {"json_map_scan": "SELECT item_id::VARCHAR, item_sid FROM items WHERE item_id IS NOT NULL", "json_set_scan": "SELECT DISTINCT item_sid FROM items WHERE item_sid IS NOT NULL"}


@pytest.mark.parametrize("name", sorted(WANT))
def test_whole_table(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW items AS FROM read_parquet('{SF}/items.parquet')")
    want = sorted(con.execute(WANT[name]).fetchall(), key=repr)
    assert len(want) > 499
    assert rows(files.QUERIES[name](spark, SF)) == want


def test_chunks_are_bounded(spark):
    sizes = [r[0] for r in S.json_chunks(spark.range(25, numPartitions=2), F.collect_list("id"), 4).select(F.json_array_length("value")).collect()]
    assert sum(sizes) == 25 and max(sizes) == 4
