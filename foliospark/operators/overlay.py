"""Layered values: the deepest layer that has a key decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(
    layers: DataFrame | list[DataFrame],
    keys: list[str],
    unique: bool = False,
    not_null: bool = False,
) -> DataFrame:
    """One row per key, with the values of the deepest layer that has the key.

    ``layers`` is a list of frames with the same columns, the outermost first, or
    one frame with a ``depth`` column. A NULL in a deeper layer overrides too. All
    columns besides ``keys`` are values and come from the same layer.

    ``unique=True`` says that each frame of the list has a key once at most, as a
    map has. Then nothing needs regrouping: a layer's rows stay as they are, less
    those whose key a deeper layer has, and where the deeper layers are small
    enough for Spark to broadcast, the outermost is not even shuffled.

    ``not_null=True``, with ``unique``, says that no key is NULL; one that is fails the query. Keys are
    then compared by ``=``, so layers saved in the same buckets of the keys
    (``save_table(bucket_by=keys)``) are overlaid without any shuffle.
    """
    if unique:
        if isinstance(layers, DataFrame):
            raise ValueError("unique=True is for a list of layers")
        return _in_place(layers, keys) if not_null else _without_overridden(layers, keys)
    if not_null:
        raise ValueError("not_null=True is for unique layers")
    depth = "depth"
    if not isinstance(layers, DataFrame):
        # the frames may have a value column named depth
        depth = _free_name("_depth", layers[0].columns)
        numbered = [layer.withColumn(depth, F.lit(i)) for i, layer in enumerate(layers)]
        layers = reduce(DataFrame.unionByName, numbered)
    values = [c for c in layers.columns if c not in keys and c != depth]
    if not values:
        return layers.select(*keys).distinct()
    # max_by is aggregated in each task before the shuffle, so a hot key sends one
    # row per task; a window would bring all its rows into one task.
    name = _free_name("_deepest", layers.columns)
    deepest = F.max_by(F.struct(*values), depth).alias(name)
    return layers.groupBy(*keys).agg(deepest).select(*keys, f"{name}.*")


def _free_name(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _without_overridden(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    result = layers[-1]
    overriding = layers[-1].select(*keys)
    for layer in reversed(layers[:-1]):
        deeper = overriding.toDF(*[f"_deeper_{key}" for key in keys])
        same_key = [layer[key].eqNullSafe(deeper[f"_deeper_{key}"]) for key in keys]
        result = layer.join(deeper, same_key, "left_anti").unionByName(result)
        overriding = layer.select(*keys).unionByName(overriding)
    return result


def _in_place(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """As ``_without_overridden``, by one anti join for each deeper layer: a union would lose the buckets."""
    layers = [_keys_present(layer, keys) for layer in layers]
    parts = []
    for depth, layer in enumerate(layers):
        for deeper in layers[depth + 1 :]:
            deeper = deeper.select(*keys).toDF(*[f"_deeper_{key}" for key in keys])
            same_key = [layer[key] == deeper[f"_deeper_{key}"] for key in keys]
            layer = layer.join(deeper, same_key, "left_anti")
        parts.append(layer)
    return reduce(DataFrame.unionByName, parts)


def _keys_present(layer: DataFrame, keys: list[str]) -> DataFrame:
    for key in keys:
        missing = F.raise_error(F.lit(f"NULL_KEY: {key}")).cast("boolean")
        layer = layer.where(F.when(layer[key].isNull(), missing).otherwise(True))
    return layer
