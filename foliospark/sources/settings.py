"""Settings files, one JSON object of texts per folder level."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.overlay import overlay
from foliospark.shared_storage import has_folder, literal_path, path_exists, qualified

# Fixed value: the name of the settings file in a folder.
SETTINGS_FILE = "app.json"

_LAYER_SCHEMA = "scope string, depth int, key string, value string"


def folder_levels(folder: str) -> list[str]:
    """``folder`` and the folders above it, the outermost first."""
    parts = urlsplit(folder)
    start = f"{parts.scheme}://{parts.netloc}" if parts.scheme else ""
    root = "/" if parts.path.startswith("/") else ""
    steps = [step for step in parts.path.split("/") if step]
    below = [start + root + "/".join(steps[:end]) for end in range(1, len(steps) + 1)]
    return [start + root, *below] if root else below


def settings_layers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Settings of several levels as ``(scope, depth, key, value)``.

    ``paths`` runs from the outermost level to the innermost; the position is the
    ``depth``. A level is a folder with an ``app.json``, such a file itself, or a
    folder written by ``save_layer``, which holds the settings of many scopes. A
    level that does not exist is empty, a malformed file fails the query. Outside
    ``save_layer`` folders ``scope`` is empty text. Of a key that a file has more than
    once, the last counts. Paths are taken literally: ``*`` and ``[1]`` are no patterns.

    With ``folder_levels(folder)`` as ``paths`` and ``overlay`` on top, this gives
    the settings in force in ``folder``.
    """
    layers = []
    for depth, path in enumerate(paths):
        level = _read_level(spark, path)
        if level is not None:
            layers.append(level.withColumn("depth", F.lit(depth)))
    if not layers:
        return spark.createDataFrame([], _LAYER_SCHEMA)
    return reduce(DataFrame.unionByName, layers).select("scope", "depth", "key", "value")


def _read_level(spark: SparkSession, path: str) -> DataFrame | None:
    single_file = f"{path.rstrip('/')}/{SETTINGS_FILE}"
    if path.endswith(".json"):
        single_file = path
    settings = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    if path_exists(spark, single_file):
        file = spark.read.text(literal_path(single_file), wholetext=True)
        found = file.select(F.posexplode(settings)).groupBy("key")
        last = found.agg(F.max_by("value", "pos").alias("value"))
        return last.withColumn("scope", F.lit(""))
    if has_folder(spark, path, "scope="):
        # The schema is given so that a scope such as "01" stays text.
        lines = spark.read.schema("value string, scope string").text(literal_path(path))
        scope = F.coalesce("scope", F.lit("")).alias("scope")
        return lines.select(scope, F.explode(settings))
    return None


def settings_tree(spark: SparkSession, root: str, file_name: str = SETTINGS_FILE) -> DataFrame:
    """The settings files of a whole tree of folders as ``(scope, depth, key, value)``.

    ``scope`` is the folder's path below ``root``, without slashes at its ends; that of ``root`` itself is
    empty. ``depth`` is the number of its steps. All files are read by one scan, however many
    folders there are. A tree that does not exist is empty, a malformed file fails the query. Of a
    key that a file has more than once, the last counts. Paths are taken literally. ``file_name`` may be a
    pattern, such as ``part-*`` for trees written by Spark; of a folder's files the last by name counts.
    """
    if not path_exists(spark, root):
        return spark.createDataFrame([], _LAYER_SCHEMA)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_name)
    with _listing_tasks(spark, spark.sparkContext.defaultParallelism):
        files = reader.text(literal_path(root), wholetext=True)
    # a path is shown as an address: without its scheme and host, and with % forms, but + is itself
    shown = F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    path = F.url_decode(F.regexp_replace(shown, r"\+", "%2B"))
    start = urlsplit(qualified(spark, root)).path.rstrip("/")
    below = F.substr(path, F.lit(len(start) + 1))
    settings = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    steps = F.regexp_replace(below, r"[^/]*$", "")
    found = files.select(_steps(steps).alias("steps"), below.alias("file"), F.posexplode(settings))
    last = found.groupBy("steps", "key").agg(F.max_by("value", F.struct("file", "pos")).alias("value"))
    scope = F.array_join("steps", "/").alias("scope")
    return last.select(scope, F.size("steps").alias("depth"), "key", "value")


@contextmanager
def _listing_tasks(spark: SparkSession, n: int) -> Iterator[None]:
    """Folders are listed by ``n`` tasks a job at most, where Spark would have a task for each folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(n, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settings_in_force(layers: DataFrame, folders: DataFrame, folder: str = "folder") -> DataFrame:
    """The settings in force in each of many folders: ``(folder, key, value, scope)``.

    ``layers`` are those of ``settings_tree`` or any other ``(scope, depth, key, value)`` with folders as
    scopes; ``folders`` has the paths asked for, below the tree's root, in the column ``folder``. A
    folder need not exist: what is above it counts. Of a key the value of the deepest folder on the way
    down decides, also if it is NULL; ``scope`` says which folder that is. Slashes at the ends and
    repeated ones are nothing. Folders asked for twice are answered once, NULL not at all.

    It is one join of the folders' ancestors with the layers and one aggregation, in a plan that
    does not grow with the folders. A scope that many folders have above them is a hot key of
    that join; adaptive execution splits it.
    """
    path = F.col(f"`{folder}`").cast("string")
    asked = folders.where(path.isNotNull()).select(path.alias("folder")).distinct()
    steps = asked.select("folder", _steps(F.col("folder")).alias("steps"))
    ends = F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("end")
    above = steps.select("folder", "steps", ends)
    above = above.select("folder", F.array_join(F.slice("steps", 1, F.col("end")), "/").alias("scope"), F.col("end").alias("depth"))
    named = layers.select(F.array_join(_steps(F.col("scope")), "/").alias("scope"), "key", "value")
    found = above.join(named, "scope").select("folder", "key", "depth", "value", "scope")
    return overlay(found, ["folder", "key"]).select("folder", "key", "value", "scope")


def _steps(path) -> Column:
    return F.filter(F.split(path, "/", -1), lambda step: step != "")
