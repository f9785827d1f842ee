"""Published reports: where they go and how they are written."""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.shared_storage import delete_folder, replace_folder, restore_folder

# The folder of run archives, a host that stands for none, and the
# schemes whose addresses are complete without a host.
_ARCHIVES = "reports"
_NO_HOST = "null"
_SCHEMES_WITHOUT_HOST = {"", "file", "hdfs", "viewfs"}


def new_archive(base: str) -> str:
    """A new archive for one run: ``<base>/reports/<uuid>/``."""
    return f"{base.rstrip('/')}/{_ARCHIVES}/{uuid.uuid4()}/"


def destination(
    archive: str | None = None,
    base: str | None = None,
    name: str | None = None,
    run_id: str | None = None,
) -> str:
    """The folder a report is published to.

    An explicit ``archive`` wins, if it is a usable address. If its last step is
    the ``run_id`` (in any letter case), the folder above it is meant, since the
    report brings its own folder. Otherwise ``<base>/<name>/<run_id>``; with no
    ``base`` either there is nowhere to publish to, and that is an error.
    """
    if archive and _has_host(archive):
        parts = urlsplit(archive)
        path = parts.path.rstrip("/")
        if run_id and posixpath.basename(path).lower() == run_id.lower():
            path = posixpath.dirname(path)
        start = f"{parts.scheme}://{parts.netloc}" if parts.scheme else ""
        return start + (path or "/")
    if base:
        if not (name and run_id):
            raise ValueError("publishing below a base needs a name and a run_id")
        return f"{base.rstrip('/')}/{name}/{run_id}"
    raise ValueError("no archive and no base: the report has no destination")


def _has_host(address: str) -> bool:
    parts = urlsplit(address)
    if parts.netloc:
        return parts.netloc != _NO_HOST
    # "scheme:/path" has no place for a host; "scheme:///path" has, and it is empty.
    return parts.scheme in _SCHEMES_WITHOUT_HOST or "://" not in address


def publish_run(
    df: DataFrame, archive: str | None, name: str, run_id: str, base: str | None = None
) -> str:
    """Write the report of one run into its own folder and return that folder.

    A run is published once: a second write to the same folder fails.
    """
    folder = destination(archive, base, name, run_id).rstrip("/")
    if posixpath.basename(folder).lower() != run_id.lower():
        folder = f"{folder}/{run_id}"
    df.write.mode("errorifexists").parquet(folder)
    return folder


def publish_fixed(
    df: DataFrame,
    archive: str | None,
    overwrite: bool,
    base: str | None = None,
    name: str | None = None,
    run_id: str | None = None,
) -> str:
    """Write the report straight into its destination and return that folder.

    ``overwrite`` replaces what is there; otherwise the rows are added. The new rows are written
    beside the folder and take its place when they are whole, so a write that fails or is lost
    leaves the old ones, and ``df`` may read them. Of two replacements at a time the last one stays.
    What a process lost in the very moment of the change has left aside is put back first.
    """
    folder = destination(archive, base, name, run_id)
    spark = df.sparkSession
    restore_folder(spark, folder)
    if not overwrite:
        df.write.mode("append").parquet(folder)
        return folder
    new = f"{folder.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        df.write.parquet(new)
        replace_folder(spark, new, folder)
    except BaseException:
        delete_folder(spark, new)
        raise
    return folder


def write_child_reports(
    df: DataFrame, archive: str, one_folder_per_child: bool = False, prefix_length: int = 2
) -> None:
    """Write the child reports in ``df`` as JSON, one object per child or part of one.

    ``df`` is the result of a fan-out. Rows without ``lines`` carry no report and
    are left out; of the columns, what describes the report is written.

    Children are filed by the first ``prefix_length`` characters of their id: 256
    folders with 2, 65,536 with 4, whatever the number of children, and all of
    about the same size. ``child_report`` reads the one folder that a child is in.
    ``one_folder_per_child`` files them as ``child_id=<id>/`` instead; that is for
    fan-outs over task slots, not for one child per row of a large table.
    """
    columns = [c for c in ("key", "child_id", "status", "error", "part", "lines") if c in df.columns]
    reports = df.where(F.col("lines").isNotNull()).select(*columns)
    folder = "child_id" if one_folder_per_child else "child_prefix"
    if not one_folder_per_child:
        reports = reports.withColumn(folder, F.substring("child_id", 1, prefix_length))
    # Without this every task would write a small file into every folder. AQE
    # sizes the rebalanced partitions and splits those that are too large.
    reports = reports.hint("rebalance", folder)
    reports.write.partitionBy(folder).json(archive)


def child_report(spark: SparkSession, archive: str, child_id: str) -> DataFrame:
    """The report of one child, out of an archive that ``write_child_reports`` filed
    by prefix: one row, or one per ``part``. Only the files of the one prefix are read."""
    schema = (
        "key string, child_id string, status string, error string, part int, lines array<string>"
    )
    reports = spark.read.schema(schema + ", child_prefix string").json(archive)
    # A condition on the folder alone, so that Spark leaves the others out.
    in_folder = F.startswith(F.lit(child_id), F.col("child_prefix"))
    return reports.where(in_folder & (F.col("child_id") == child_id)).drop("child_prefix")
