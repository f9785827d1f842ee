import random

import pytest

from foliospark.operators import overlay


def test_deepest_wins_and_null_overrides(spark):
    layers = spark.createDataFrame(
        [("s", 0, "a", "1"), ("s", 1, "a", "2"), ("s", 2, "a", "3"),
         ("s", 0, "b", "1"), ("s", 2, "b", None), ("s", 1, "c", "5"), ("t", 0, "a", "9")],
        "scope string, depth int, key string, value string",
    )
    rows = {(r.scope, r.key): r.value for r in overlay(layers, ["scope", "key"]).collect()}
    assert rows == {("s", "a"): "3", ("s", "b"): None, ("s", "c"): "5", ("t", "a"): "9"}


def test_all_values_come_from_one_layer(spark):
    low = spark.createDataFrame([(1, "low", "x")], "id int, a string, b string")
    high = spark.createDataFrame([(1, "high", None)], "id int, a string, b string")
    assert [tuple(r) for r in overlay([low, high], ["id"]).collect()] == [(1, "high", None)]


@pytest.mark.parametrize("hot_share", [0.0, 0.5])
def test_equals_brute_force(spark, hot_share):
    rng = random.Random(7)
    layers, expected = [], {}
    for depth in range(6):
        own = {}
        for _ in range(200):
            key = 0 if rng.random() < hot_share else rng.randrange(300)
            own[key] = rng.choice([None, "x", "y", f"v{depth}"])
        expected |= own
        layers.append(spark.createDataFrame(list(own.items()), "key int, value string"))
    for unique in (False, True):
        rows = overlay(layers, ["key"], unique).collect()
        assert {r.key: r.value for r in rows} == expected and len(rows) == len(expected)


def test_unique_layers_with_several_keys_and_null_keys(spark):
    schema = "a int, b string, value string"
    low = [(1, "x", "low"), (1, None, "low"), (None, None, "low"), (2, "x", "low")]
    high = [(1, None, "high"), (None, None, None), (3, "x", "high")]
    layers = [spark.createDataFrame(rows, schema) for rows in (low, high)]
    expected = [
        (None, None, None), (1, None, "high"), (1, "x", "low"), (2, "x", "low"), (3, "x", "high"),
    ]
    for unique in (False, True):
        rows = overlay(layers, ["a", "b"], unique).collect()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))


def test_unique_is_for_lists(spark):
    with pytest.raises(ValueError):
        overlay(spark.range(1).withColumnRenamed("id", "depth"), [], unique=True)


def test_keys_alone(spark):
    layers = [spark.range(0, 3), spark.range(2, 5)]
    for unique in (False, True):
        assert sorted(r.id for r in overlay(layers, ["id"], unique).collect()) == [0, 1, 2, 3, 4]


def test_a_value_column_named_depth_is_kept(spark):
    low = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k int, depth int, _deepest string")
    high = spark.createDataFrame([(1, None, "c")], "k int, depth int, _deepest string")
    for unique in (False, True):
        out = overlay([low, high], ["k"], unique=unique)
        assert out.columns == ["k", "depth", "_deepest"]
        assert sorted(tuple(r) for r in out.collect()) == [(1, None, "c"), (2, 6, "b")]
