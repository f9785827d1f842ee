"""The plans of the operators: what is scanned, shuffled and handed to Python."""

import re

import pytest
from pyspark.sql import functions as F

from foliospark.operators import overlay, preview, report_index, spread
from foliospark.queries import QUERIES
from foliospark.queries.fanout import checked_events, revenue_by_partition

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n?", plan(df) + "\n")
    return [[field.split(":")[0] for field in schema.split(",")] for schema in schemas]


@pytest.mark.parametrize(
    "name", ["json_doubles", "json_ints", "json_ints_truncated", "parse_json", "json_sorted",
             "json_rooted", "map_eval_column", "typed_rows", "sql_filter_project", "sql_scalar_fn"],
)
def test_row_functions_neither_shuffle_nor_leave_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "Exchange" not in text and "Python" not in text and "MapInArrow" not in text


def test_filters_and_columns_reach_the_scan(spark):
    df = QUERIES["sql_filter_project"](spark, SF_DIR)
    assert "GreaterThanOrEqual(l_shipdate" in plan(df) and "LessThan(l_quantity" in plan(df)
    assert scanned(QUERIES["parse_json"](spark, SF_DIR)) == [["event_id", "props"]]
    assert scanned(QUERIES["slot_source"](spark, SF_DIR)) == [["l_orderkey", "l_quantity"]]


def test_fan_out_reads_what_the_function_names_and_does_not_shuffle(spark):
    isolated = checked_events(spark, SF_DIR, "run")
    assert "Exchange" not in plan(isolated)
    assert scanned(isolated) == [["event_id", "event_type", "value"]]
    tagged = revenue_by_partition(spark, SF_DIR, "run")
    assert "Exchange" not in plan(tagged)
    assert scanned(tagged) == [["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]]
    assert scanned(QUERIES["map_eval_function"](spark, SF_DIR)) == [["o_orderkey"]]


def test_the_index_of_unique_children_needs_no_shuffle(spark):
    isolated = checked_events(spark, SF_DIR, "run")
    assert "Exchange" not in plan(report_index(isolated, distinct=False))
    assert "partial" not in plan(report_index(isolated, distinct=False))
    assert "Exchange hashpartitioning(child_id" in plan(report_index(isolated))


def test_spread_is_round_robin(spark):
    assert "RoundRobinPartitioning(12)" in plan(spread(spark.range(5), 12))


def test_overlay_aggregates_before_its_only_shuffle(spark):
    layers = spark.range(100).select(
        (F.col("id") % 7).alias("key"), F.lit(0).alias("depth"), F.lit("x").alias("value")
    )
    text = plan(overlay(layers, ["key"]))
    assert text.index("functions=[max_by") < text.index("Exchange") < text.index("partial_max_by")
    assert text.count("Exchange") == 1


def test_unique_overlay_leaves_the_outermost_layer_in_place(spark):
    low = spark.range(100).withColumn("value", F.lit("low"))
    high = spark.range(10).withColumn("value", F.lit("high"))
    text = plan(overlay([low, high], ["id"], unique=True))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "hashpartitioning" not in text


def test_previews_stop_at_the_limit(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    assert plan(preview(orders)).lstrip().startswith("CollectLimit 100")
    assert plan(preview(orders.orderBy("o_orderkey"))).lstrip().startswith("TakeOrderedAndProject")


def test_line_items_are_not_shuffled_by_customer(spark):
    """Without broadcasts, the customers' segments reach the orders before these meet the line items."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = plan(QUERIES["sql_join_multi"](spark, SF_DIR))
    finally:
        spark.conf.set(key, before)
    lines = text.splitlines()
    by_customer = [i for i, line in enumerate(lines) if re.search(r"hashpartitioning\((o|c)_custkey", line)]
    assert by_customer
    for i in by_customer:
        depth = re.search(r"Exchange", lines[i]).start()
        below = []
        for line in lines[i + 1 :]:
            if len(line) - len(line.lstrip(" :|+-")) <= depth - 3:
                break
            below.append(line)
        assert not any("l_extendedprice" in line for line in below)
