"""Layered settings and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import overlay
from foliospark.queries.inputs import table
from foliospark.shared_storage import fresh_folder
from foliospark.sinks import apply_layer, save_layer, save_overlay, save_table, saved_overlay
from foliospark.sources import settings_in_force, settings_layers, settings_tree, warehouse_table


def customer_layers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Every customer's contact and tier: region default, nation's, the customer's own.

    Customers in debt have their own tier, NULL, and that overrides as well.
    """
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    located = customers.join(nations, "c_nationkey").join(regions, "n_regionkey")
    by_region = located.select(
        "c_custkey", F.col("r_name").alias("contact"), F.lit("standard").alias("tier")
    )
    by_nation = located.where(F.col("n_name").rlike("[02468]$")).select(
        "c_custkey", F.col("n_name").alias("contact"), F.lit("national").alias("tier")
    )
    by_customer = customers.where("c_acctbal < 0 OR c_acctbal > 9000").select(
        "c_custkey",
        F.col("c_name").alias("contact"),
        F.when(F.col("c_acctbal") > 9000, "gold").alias("tier"),
    )
    return [by_region, by_nation, by_customer]


def overlay_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay(customer_layers(spark, sf_dir), ["c_custkey"])


def overlay_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layers, known to hold every customer once at most."""
    return overlay(customer_layers(spark, sf_dir), ["c_custkey"], unique=True)


def overlay_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layers, saved in buckets of the customers: overlaying them shuffles nothing."""
    saved = []
    for depth, layer in enumerate(customer_layers(spark, sf_dir)):
        name = f"folio_layer_{depth}"
        save_table(layer, name, fresh_folder(spark, "layer"), "overwrite", ["c_custkey"], 16)
        saved.append(warehouse_table(spark, name))
    return overlay(saved, ["c_custkey"], unique=True, not_null=True)


def overlay_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost layer is saved, the deeper ones are laid over it where it is."""
    path = fresh_folder(spark, "overlay")
    first, *deeper = customer_layers(spark, sf_dir)
    save_overlay(first, path, ["c_custkey"], 16)
    for layer in deeper:
        apply_layer(layer, path, ["c_custkey"])
    return saved_overlay(spark, path)


def settings_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of settings per nation, written, read back and resolved.

    Every customer is a key of its nation's settings; deeper layers replace the
    market segment, or take it away.
    """
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("nations/"), F.col("c_nationkey").cast("string")).alias("scope"),
        F.col("c_name").alias("key"),
        "c_mktsegment",
        "c_acctbal",
    )
    folders = [fresh_folder(spark, f"settings-{depth}") for depth in range(3)]
    save_layer(customers.select("scope", "key", F.col("c_mktsegment").alias("value")), folders[0])
    rich = customers.where("c_acctbal > 5000")
    save_layer(rich.select("scope", "key", F.lit("RICH").alias("value")), folders[1])
    building = customers.where("c_mktsegment = 'BUILDING'")
    gone = F.lit(None).cast("string").alias("value")
    save_layer(building.select("scope", "key", gone), folders[2])
    return overlay(settings_layers(spark, folders), ["scope", "key"])


def settings_of_every_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of settings files (all, region, nation, some customers), and what is in force for each customer."""
    root = fresh_folder(spark, "settings-tree")
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "nation")
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "region")
    regions = regions.join(nations.withColumnRenamed("n_regionkey", "region"), "region")
    customers = table(spark, sf_dir, "customer").withColumnsRenamed({"c_nationkey": "nation", "c_custkey": "customer"})
    customers = customers.join(regions, "nation")

    def written(rows: DataFrame, steps: list[str], **settings) -> None:
        value = F.to_json(F.struct(*[v.alias(k) for k, v in settings.items()]), {"ignoreNullFields": "false"})
        rows = rows.select(*steps, value.alias("value"))
        if steps:  # a file takes its time however small it is, so all cores write, and tasks put theirs in place
            rows = rows.repartition(spark.sparkContext.defaultParallelism, *steps)
        files = rows.distinct().write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        files.mode("append").partitionBy(*steps).text(root)

    everywhere = regions.select(F.lit("standard").alias("tier"))
    written(everywhere, [], tier=F.col("tier"), contact=F.lit("head office"))
    written(regions, ["region"], contact=F.col("r_name"))
    even = regions.where(F.col("n_name").rlike("[02468]$"))
    written(even, ["region", "nation"], contact=F.col("n_name"), tier=F.lit("national"))
    owners = customers.where("c_acctbal > 9500")
    written(owners, ["region", "nation", "customer"], tier=F.lit("gold"), owner=F.col("c_name"))
    debtors = customers.where("c_acctbal < -900")
    written(debtors, ["region", "nation", "customer"], tier=F.lit(None).cast("string"))
    steps = [F.concat(F.lit(f"{step}="), F.col(step)) for step in ("region", "nation", "customer")]
    asked = customers.select("customer", F.concat_ws("/", *steps).alias("folder"))
    found = settings_in_force(settings_tree(spark, root, "part-*"), asked)
    return found.select(F.regexp_extract("folder", r"customer=(\d+)", 1).cast("bigint").alias("c_custkey"), "key", "value", "scope")


_CUSTOMER_ORACLE = """
        WITH located AS (
            SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey
        ), layers AS (
            SELECT 0 AS depth, c_custkey, r_name AS contact, 'standard' AS tier FROM located
            UNION ALL
            SELECT 1, c_custkey, n_name, 'national' FROM located
            WHERE right(n_name, 1) IN ('0', '2', '4', '6', '8')
            UNION ALL
            SELECT 2, c_custkey, c_name, CASE WHEN c_acctbal > 9000 THEN 'gold' END FROM customer
            WHERE c_acctbal < 0 OR c_acctbal > 9000
        )
        SELECT c_custkey, contact, tier FROM layers
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY depth DESC) = 1
"""

QUERIES = {
    "overlay": overlay_customers,
    "overlay_unique": overlay_unique,
    "overlay_bucketed": overlay_bucketed,
    "overlay_applied": overlay_applied,
    "settings_layers": settings_in_files,
    "settings_tree": settings_of_every_customer,
}

ORACLES = {
    "settings_tree": """
        WITH located AS (
            SELECT *, 'region=' || n_regionkey AS r, 'region=' || n_regionkey || '/nation=' || n_nationkey AS n,
                   'region=' || n_regionkey || '/nation=' || n_nationkey || '/customer=' || c_custkey AS c
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        ), layers AS (
            SELECT 0 AS depth, c_custkey, '' AS scope, 'tier' AS key, 'standard' AS value FROM located
            UNION ALL SELECT 0, c_custkey, '', 'contact', 'head office' FROM located
            UNION ALL SELECT 1, c_custkey, r, 'contact', r_name FROM located
            UNION ALL SELECT 2, c_custkey, n, 'contact', n_name FROM located WHERE right(n_name, 1) IN ('0', '2', '4', '6', '8')
            UNION ALL SELECT 2, c_custkey, n, 'tier', 'national' FROM located WHERE right(n_name, 1) IN ('0', '2', '4', '6', '8')
            UNION ALL SELECT 3, c_custkey, c, 'tier', 'gold' FROM located WHERE c_acctbal > 9500
            UNION ALL SELECT 3, c_custkey, c, 'owner', c_name FROM located WHERE c_acctbal > 9500
            UNION ALL SELECT 3, c_custkey, c, 'tier', NULL FROM located WHERE c_acctbal < -900
        )
        SELECT c_custkey, key, value, scope FROM layers
        QUALIFY row_number() OVER (PARTITION BY c_custkey, key ORDER BY depth DESC) = 1
    """,
    "overlay": _CUSTOMER_ORACLE,
    "overlay_unique": _CUSTOMER_ORACLE,
    "overlay_bucketed": _CUSTOMER_ORACLE,
    "overlay_applied": _CUSTOMER_ORACLE,
    "settings_layers": """
        WITH layers AS (
            SELECT 0 AS depth, 'nations/' || c_nationkey AS scope, c_name AS key,
                   c_mktsegment AS value
            FROM customer
            UNION ALL
            SELECT 1, 'nations/' || c_nationkey, c_name, 'RICH' FROM customer WHERE c_acctbal > 5000
            UNION ALL
            SELECT 2, 'nations/' || c_nationkey, c_name, NULL FROM customer
            WHERE c_mktsegment = 'BUILDING'
        )
        SELECT scope, key, value FROM layers
        QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY depth DESC) = 1
    """,
}
