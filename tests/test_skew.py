"""The queries that group, join or move rows, with a third of all rows on one key."""

import pytest
from compare import TABLES, difference, duckdb_with

import __spark_entry__ as contract

SOURCE = "/root/testdata/sf0.001"

# Column and value that a third of a table's rows get.
HOT = {
    "customer": ("c_nationkey", 3),
    "orders": ("o_custkey", 5),
    "lineitem": ("l_orderkey", 7),
    "events": ("user_id", 1),
}

QUERIES = [
    "slot_source", "register_view", "materialize", "json_sorted_counts", "spread", "map_isolated",
    "distribute", "distribute_eval", "map_partitions_tagged", "partition_reports",
    "report_index_partitions", "child_reports", "overlay", "overlay_unique", "settings_layers",
    "run_cell", "sql_script", "sql_join_multi", "sql_semi_anti", "sql_rollup", "sql_window_rank",
    "sql_topk", "sql_setops", "publish_run", "publish_fixed_append", "script_order",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    connection = duckdb_with(SOURCE)
    for name in TABLES:
        columns = "*"
        if name in HOT:
            column, value = HOT[name]
            hot = f"CASE WHEN row_number() OVER () % 3 = 0 THEN {value} ELSE {column} END"
            kind = connection.execute(f"SELECT typeof({column}) FROM {name}").fetchall()[0][0]
            columns = f"* REPLACE (CAST({hot} AS {kind}) AS {column})"
        if name == "orders":
            missing = "CASE WHEN row_number() OVER () % 10 <> 0 THEN o_orderstatus END"
            columns = columns.replace("REPLACE (", f"REPLACE ({missing} AS o_orderstatus, ")
        connection.execute(f"COPY (SELECT {columns} FROM {name}) TO '{folder}/{name}.parquet'")
    return folder


def test_a_third_of_the_rows_is_on_one_key(skewed):
    connection = duckdb_with(skewed)
    for name, (column, value) in HOT.items():
        share = f"SELECT avg(CAST({column} = {value} AS INTEGER)) FROM {name}"
        assert connection.execute(share).fetchall()[0][0] > 0.33


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_on_skewed_tables(spark, skewed, name):
    df = contract.queries()[name](spark, skewed)
    assert difference(df, duckdb_with(skewed), contract.oracle_sql()[name]) is None
