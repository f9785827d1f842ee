"""Published reports and child reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.queries.fanout import checked_events, revenue_by_partition
from foliospark.queries.inputs import table
from foliospark.shared_storage import fresh_folder
from foliospark.sinks import child_report, publish_fixed, publish_run, write_child_reports


def publish_run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one archive, each in its own folder."""
    archive = fresh_folder(spark, "archive")
    orders = table(spark, sf_dir, "orders")
    first = publish_run(orders.where("o_orderstatus = 'O'"), archive, "orders", "run-1")
    second = publish_run(orders.where("NOT (o_orderstatus <=> 'O')"), archive, "orders", "run-2")
    return spark.read.parquet(first, second)


def publish_fixed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = fresh_folder(spark, "archive")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    publish_fixed(orders.where("o_orderstatus = 'F'"), archive, overwrite=True)
    folder = publish_fixed(orders.where("NOT (o_orderstatus <=> 'F')"), archive, overwrite=False)
    return spark.read.parquet(folder)


def publish_fixed_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = fresh_folder(spark, "archive")
    customers = table(spark, sf_dir, "customer")
    publish_fixed(customers, archive, overwrite=True)
    folder = publish_fixed(customers.where("c_acctbal < 0"), archive, overwrite=True)
    return spark.read.parquet(folder)


def publish_fixed_from_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report replaced by what is computed from the report that is there."""
    archive = fresh_folder(spark, "archive")
    folder = publish_fixed(table(spark, sf_dir, "customer"), archive, overwrite=True)
    rest = spark.read.parquet(folder).where("c_acctbal >= 0").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    return spark.read.parquet(publish_fixed(rest, archive, overwrite=True))


def child_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every event, read back from the archive."""
    archive = fresh_folder(spark, "archive")
    write_child_reports(checked_events(spark, sf_dir, "child_reports"), archive)
    written = "key bigint, child_id string, status string, error string, lines array<string>"
    reports = spark.read.schema(written + ", child_prefix string").json(archive)
    return reports.withColumn("lines", F.concat_ws("; ", "lines"))


def child_reports_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all partitions together account for every line item."""
    archive = fresh_folder(spark, "archive")
    tagged = revenue_by_partition(spark, sf_dir, "child_reports")
    write_child_reports(tagged, archive)
    reports = spark.read.schema("child_id string, part int, lines array<string>").json(archive)
    return reports.agg(
        F.sum(F.element_at("lines", 1).cast("bigint")).alias("n_rows"),
        (F.count("*") == F.count_distinct("child_id")).alias("one_report_each"),
    )


def child_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out of the archive of all events' reports, that of the last event."""
    archive = fresh_folder(spark, "archive")
    write_child_reports(checked_events(spark, sf_dir, "child_report"), archive)
    last = table(spark, sf_dir, "events").agg(F.md5(F.concat(F.lit("child_report:"), F.max("event_id"))))
    found = child_report(spark, archive, last.first()[0])
    return found.select("key", "child_id", "status", F.concat_ws("; ", "lines").alias("lines"))


QUERIES = {
    "publish_run": publish_run_query,
    "publish_fixed_append": publish_fixed_append,
    "publish_fixed_overwrite": publish_fixed_overwrite,
    "publish_fixed_from_itself": publish_fixed_from_itself,
    "child_reports": child_reports,
    "child_reports_partitions": child_reports_partitions,
    "child_report": child_report_query,
}

ORACLES = {
    "publish_fixed_from_itself": """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal * 2 AS c_acctbal, c_mktsegment
        FROM customer WHERE c_acctbal >= 0
    """,
    "publish_run": "SELECT * FROM orders",
    "publish_fixed_append": "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders",
    "publish_fixed_overwrite": "SELECT * FROM customer WHERE c_acctbal < 0",
    "child_reports": """
        SELECT event_id AS key, md5('child_reports:' || event_id) AS child_id,
               left(md5('child_reports:' || event_id), 2) AS child_prefix,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN event_type = 'error'
                    THEN 'ValueError: event ' || event_id || ' is an error' END AS error,
               'Event ' || event_id
                   || CASE WHEN event_type = 'error' THEN '' ELSE '; is a ' || event_type END
                   AS lines
        FROM events
    """,
    "child_report": """
        SELECT CAST(event_id AS VARCHAR) AS key, md5('child_report:' || event_id) AS child_id,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
               'Event ' || event_id
                   || CASE WHEN event_type = 'error' THEN '' ELSE '; is a ' || event_type END
                   AS lines
        FROM events WHERE event_id = (SELECT max(event_id) FROM events)
    """,
    "child_reports_partitions": """
        SELECT count(*) AS n_rows, true AS one_report_each FROM lineitem
    """,
}
