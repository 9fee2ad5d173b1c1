"""Queries over whole tables, at a size that a subset would not reach."""

import pytest

from stratalog import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", ["json_flatten_roundtrip", "json_key_table", "json_key_orders", "json_presence", "json_key_statistics", "json_value_dictionary"])
def test_json_of_all_events(spark, name):
    assert "event_id < " not in SQL[name]
    compare(QUERIES[name](spark, SF), connect(SF), SQL[name])


@pytest.mark.parametrize("name", ["xor_window", "xor_bucket_window"])
def test_similar_lines_of_all_events(spark, name):
    found = QUERIES[name](spark, SF).select("line_no").collect()
    assert sorted(r[0] for r in found) == sorted(r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect())


@pytest.mark.parametrize("name", ["json_semantic_verify", "file_roundtrip", "generators"])
def test_reports_of_all_rows(spark, name):
    compare(QUERIES[name](spark, SF), connect(SF), SQL[name])
