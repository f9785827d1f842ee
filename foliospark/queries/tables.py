"""Sources, views, warehouse tables and materialized results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.queries.inputs import table
from foliospark.shared_storage import fresh_folder
from foliospark.sinks import materialize, register_view, save_table
from foliospark.sources import guid_source, slot_source, typed_rows, warehouse_table

SLOTS = 64


def guids_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    guids = guid_source(spark, table(spark, sf_dir, "orders").count())
    valid = F.col("guid").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return guids.agg(
        F.count("*").alias("n"),
        F.count_distinct("guid").alias("n_distinct"),
        F.count_if(valid).alias("n_valid"),
    )


def typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = (
        "p_partkey bigint, p_name string, p_brand string, p_type string, "
        "p_size bigint, p_retailprice double"
    )
    return typed_rows(spark, table(spark, sf_dir, "part"), schema)


def slot_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the line items fall on the slots, empty slots included."""
    slot = F.pmod("l_orderkey", F.lit(SLOTS)).alias("id")
    shares = (
        table(spark, sf_dir, "lineitem")
        .groupBy(slot)
        .agg(
            F.count("*").alias("n_lines"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
        )
    )
    return (
        slot_source(spark, SLOTS)
        .join(shares, "id", "left")
        .select("id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "quantity")
    )


def warehouse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One name, so that no call leaves another table in the catalog.
    name = "folio_warehouse_orders"
    folder = fresh_folder(spark, "warehouse")
    save_table(table(spark, sf_dir, "orders"), name, folder, mode="overwrite")
    return warehouse_table(spark, name)


def register_view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_view(table(spark, sf_dir, "orders"), "folio_register_view")
    return spark.sql(
        """
        SELECT o_orderpriority, o_orderstatus, count(*) AS n_orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM folio_register_view
        GROUP BY o_orderpriority, o_orderstatus
        """
    )


def materialize_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second builder must not run: the table of the first is there."""
    path = fresh_folder(spark, "materialize")

    def spending(session):
        return (
            table(session, sf_dir, "orders")
            .groupBy("o_custkey")
            .agg(
                F.count("*").alias("n_orders"),
                F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"),
            )
        )

    def never(session):
        raise RuntimeError("the table is there already")

    materialize(spark, path, spending)
    return materialize(spark, path, never)


QUERIES = {
    "guid_source": guids_per_order,
    "typed_rows": typed_parts,
    "slot_source": slot_shares,
    "warehouse_roundtrip": warehouse_roundtrip,
    "register_view": register_view_query,
    "materialize": materialize_once,
}

ORACLES = {
    "guid_source": "SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_valid FROM orders",
    "typed_rows": """
        SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice
        FROM part
    """,
    "slot_source": """
        SELECT s.id, count(l_orderkey) AS n_lines,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
        FROM (SELECT range AS id FROM range(64)) s LEFT JOIN lineitem ON l_orderkey % 64 = s.id
        GROUP BY s.id
    """,
    "warehouse_roundtrip": "SELECT * FROM orders",
    "register_view": """
        SELECT o_orderpriority, o_orderstatus, count(*) AS n_orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM orders GROUP BY o_orderpriority, o_orderstatus
    """,
    "materialize": """
        SELECT o_custkey, count(*) AS n_orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
        FROM orders GROUP BY o_custkey
    """,
}
