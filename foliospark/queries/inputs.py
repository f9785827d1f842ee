"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.sinks import register_view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, prefix: str, *names: str) -> None:
    """Register tables as ``<prefix>_<table>``, apart from other queries' views."""
    for name in names:
        register_view(table(spark, sf_dir, name), f"{prefix}_{name}")
