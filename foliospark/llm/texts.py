"""Helpers of the operators: Arrow batches of texts, names that cannot clash, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of about so many bytes are worked on at a time; a longer text is a slice by itself.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Just the columns that an operator needs, under the operator's own names.

    ``columns`` has the new name by the name in ``df``. Names are quoted, so dots
    and other signs in them do no harm.
    """
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES):
    """The batches cut so that the texts of each piece take about ``limit`` bytes at most."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker goes on with other tasks


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES):
    """The batches in slices, each with the UTF-8 bytes of its texts."""
    for batch in slices(batches, column, limit):
        yield batch, bytes_of(batch, column)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that no column of ``df`` starts with."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as the empty text."""
    return batch.column(column).fill_null("").to_pylist()


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of the texts of a batch, null as none."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new path on storage that driver and executors share.

    It is below ``spark.checkpoint.dir``; where that is unset, below the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df``, written to shared storage once and read from there.

    What comes after does not compute them anew, also when executors were lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_remainder(column, modulus: int):
    """crc32 of a value's text, modulo ``modulus``; of null as of the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
