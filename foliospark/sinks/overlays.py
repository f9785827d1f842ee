"""Resolved layers that are kept, and changed by further layers in part."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.overlay import overlay
from foliospark.shared_storage import literal_path


def save_overlay(df: DataFrame, path: str, keys: list[str], parts: int = 1024) -> None:
    """Write a resolved overlay (one row per key) below ``path`` in ``parts`` folders by a hash of ``keys``.

    It is what ``apply_layer`` changes. A folder is the smallest piece that is rewritten: choose ``parts`` so
    that one has some hundred MB. The number is part of the folders' names, so it need not be
    given again. What is at ``path`` already is an error.
    """
    name = f"part_of_{parts}"
    _written(df.withColumn(name, _part(keys, parts)), name).mode("errorifexists").parquet(path)


def saved_overlay(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``save_overlay`` and ``apply_layer`` have left at ``path``."""
    found = spark.read.parquet(literal_path(path))
    return found.drop(_part_column(found))


def apply_layer(layer: DataFrame, path: str, keys: list[str]) -> list[int]:
    """Lay ``layer`` over the overlay saved at ``path``; returns the folders that were rewritten.

    ``layer`` has the columns of the saved rows and their types, in any order, and each key once at most; a key given
    twice fails the write. ``keys`` are those of ``save_overlay``. Only folders that a key of the layer falls into are
    read and written; the files of all others stay as they are. An empty layer changes nothing.

    The layer is computed once for its folders (numbers, as many as there are folders at most) and once for
    the write. A write that fails leaves the old rows. When it is done, Spark exchanges the
    folders one after the other, so a driver lost in that moment leaves some of them old; applying the layer again mends that.
    """
    spark = layer.sparkSession
    saved = spark.read.parquet(literal_path(path))
    name = _part_column(saved)
    columns = [c for c in saved.columns if c != name]
    # the same key as another type has another hash
    if sorted(layer.dtypes) != sorted(saved.drop(name).dtypes):
        raise ValueError(f"the layer has the columns {layer.dtypes}, the saved rows {saved.drop(name).dtypes}")
    layer = _once(layer.select(*columns), keys).withColumn(name, _part(keys, int(name.rsplit("_", 1)[1])))
    touched = sorted(row[0] for row in layer.select(name).distinct().collect())
    if touched:
        rows = overlay([saved.where(F.col(name).isin(touched)), layer], keys, unique=True)
        _written(rows, name).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched


def _part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{key}`") for key in keys]), F.lit(parts)).cast("int")


def _part_column(df: DataFrame) -> str:
    if not df.columns or not re.fullmatch(r"part_of_[0-9]+", df.columns[-1]):
        raise ValueError("this is no saved overlay")
    return df.columns[-1]


def _once(layer: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in layer.columns if c not in keys]
    given = layer.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(0).alias("_there"), *values)).alias("_values"))
    twice = F.concat(F.lit("DUPLICATED_KEY: "), F.to_json(F.struct(*keys)))
    once = F.when(F.col("_n") > 1, F.raise_error(twice).cast("boolean")).otherwise(True)
    return given.where(once).select(*keys, *[f"_values.{c}" for c in values]).select(*layer.columns)


def _written(df: DataFrame, name: str):
    return df.hint("rebalance", name).write.partitionBy(name)
