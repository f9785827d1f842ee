"""Views, warehouse tables and results that are computed once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.shared_storage import Claim, has_folder, literal_path, path_exists


def register_view(df: DataFrame, name: str) -> None:
    """Publish ``df`` under ``name`` for later SQL in the same session."""
    df.createOrReplaceTempView(name)


def save_table(
    df: DataFrame,
    name: str,
    path: str | None = None,
    mode: str = "errorifexists",
    bucket_by: list[str] | None = None,
    buckets: int = 200,
) -> None:
    """Write ``df`` as the Parquet warehouse table ``name``, its files below ``path``.

    ``bucket_by`` deals the rows out to ``buckets`` files by a hash of these columns and sorts them in each.
    Tables with the same buckets are joined, grouped and overlaid (``overlay(unique=True, not_null=True)``)
    by these columns without a shuffle. The write shuffles once; choose ``buckets`` so that a file fits
    a task's memory, as all rows of a key are in one of them.
    """
    if bucket_by:
        # a task holds one bucket, so that each has one file and not one per task
        df = df.repartition(buckets, *[F.col(f"`{column}`") for column in bucket_by])
    writer = df.write.format("parquet").mode(mode)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def materialize(
    spark: SparkSession,
    path: str,
    builder: Callable[[SparkSession], DataFrame],
    lease: float = 60,
    wait: float = 1,
) -> DataFrame:
    """The table at ``path``; ``builder`` computes it only if it is not there yet.

    The table counts as there once its write was committed (``_SUCCESS``). What a lost
    job left behind (it has a ``_temporary`` folder) is replaced; anything else at ``path``
    is somebody's data, and an error. A different builder does not replace a table that
    is there.

    Of several sessions that ask for it at a time one builds and the others wait, looking again
    every ``wait`` seconds. The builder holds a claim, the file ``<path>.claim``, which it renews. If it
    fails, the next one builds; if it is lost, one of those that wait takes over ``lease`` seconds later.
    """
    folder = path.rstrip("/")
    claim = Claim(spark, f"{folder}.claim", lease)
    while not path_exists(spark, f"{folder}/_SUCCESS"):
        if not claim.take():
            time.sleep(wait)
            continue
        try:
            if path_exists(spark, f"{folder}/_SUCCESS"):
                break  # the one before was just done
            if has_folder(spark, path) and not path_exists(spark, f"{folder}/_temporary"):
                raise FileExistsError(f"{path} holds data that no finished write left there")
            builder(spark).write.mode("overwrite").parquet(path)
        finally:
            claim.release()
    return spark.read.parquet(literal_path(path))
