"""Settings as lines of JSON, below a folder per scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_layer(df: DataFrame, path: str) -> None:
    """Write ``(scope, key, value)`` below ``path/scope=<scope>/``, a line per setting.

    Every line is a JSON object with one key. What was there of a scope is replaced;
    scopes that are not in ``df`` stay as they are. No scope (NULL) is the empty one. A
    key given twice for a scope fails the write.

    Settings are brought together by scope before they are written, so a scope has few
    files; a scope too large for one task is split by its size (adaptive execution).
    """
    scope = F.coalesce("scope", F.lit("")).alias("scope")
    settings = df.select(scope, "key", "value").groupBy("scope", "key")
    given = settings.agg(F.count("*").alias("n"), F.first("value").alias("value"))
    twice = F.concat(F.lit("DUPLICATED_KEY: "), "key", F.lit(" in scope "), "scope")
    value = F.when(F.col("n") > 1, F.raise_error(twice).cast("string")).otherwise(F.col("value"))
    line = F.to_json(F.create_map("key", value), {"ignoreNullFields": "false"}).alias("value")
    (
        given.select("scope", line)
        .hint("rebalance", "scope")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scope")
        .text(path)
    )
