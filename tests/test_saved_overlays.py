"""Layers in buckets, and overlays that are kept and changed in part."""

import pathlib

import pytest

from foliospark.operators import overlay
from foliospark.queries import QUERIES
from foliospark.sinks import apply_layer, save_overlay, save_table, saved_overlay
from foliospark.sources import warehouse_table

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "a int, b string, value string"


def rows_of(df):
    return sorted(map(str, map(tuple, df.select("a", "b", "value").collect())))


def files_in(path):
    return {f: f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet")}


def test_bucketed_layers_are_overlaid_without_a_shuffle(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        overlaid = QUERIES["overlay_bucketed"](spark, SF_DIR)
        text = overlaid._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and text.count("LeftAnti") == 3
        assert overlaid.count() == spark.read.parquet(f"{SF_DIR}/customer.parquet").count()
    finally:
        spark.conf.set(key, before)


def test_a_bucket_is_one_sorted_file(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 100 AS k", "id AS `v`").repartition(7)
    save_table(df, "folio_test_buckets", str(tmp_path / "t"), "overwrite", ["k"], 4)
    assert len(files_in(tmp_path / "t")) == 4
    assert sorted(r.v for r in warehouse_table(spark, "folio_test_buckets").collect()) == list(range(1000))
    spark.sql("DROP TABLE folio_test_buckets")


def test_null_keys_fail_where_there_should_be_none(spark):
    low = spark.createDataFrame([(1, "x", "low"), (2, "x", "low")], SCHEMA)
    high = spark.createDataFrame([(1, "x", "high")], SCHEMA)
    assert rows_of(overlay([low, high], ["a", "b"], True, True)) == rows_of(overlay([low, high], ["a", "b"]))
    null = spark.createDataFrame([(None, "x", "null")], SCHEMA)
    for layers in ([low, null], [null, low]):
        with pytest.raises(Exception, match="NULL_KEY: a"):
            overlay(layers, ["a", "b"], True, True).collect()
    with pytest.raises(ValueError):
        overlay([low, high], ["a", "b"], not_null=True)


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "saved")
    base = spark.range(300).selectExpr("CAST(id AS INT) AS a", "IF(id % 7 = 0, NULL, 'b') AS b", "'base' AS value")
    save_overlay(base, path, ["a", "b"], 32)
    before = files_in(path)
    layer = spark.createDataFrame([("new", 1, "b"), (None, 7, None), ("added", None, None)], "value string, a int, b string")
    touched = apply_layer(layer, path, ["a", "b"])
    assert 1 <= len(touched) <= 3
    assert rows_of(saved_overlay(spark, path)) == rows_of(overlay([base, layer], ["a", "b"]))
    after = files_in(path)
    inside = {f"part_of_32={part}" for part in touched}
    assert {f: t for f, t in before.items() if f.parent.name not in inside} == {
        f: t for f, t in after.items() if f.parent.name not in inside
    }
    assert not {f for f in before if f.parent.name in inside} & set(after)


def test_many_layers_equal_the_whole_overlay(spark, tmp_path):
    path = str(tmp_path / "saved")
    layers = [
        spark.range(start, 200, step).selectExpr("CAST(id AS INT) AS a", "CAST(id % 3 AS STRING) AS b", f"'{step}' AS value")
        for start, step in [(0, 2), (1, 3), (0, 5), (50, 50)]
    ]
    save_overlay(layers[0], path, ["a", "b"], 8)
    for layer in layers[1:]:
        apply_layer(layer, path, ["a", "b"])
        apply_layer(layer, path, ["a", "b"])  # again: nothing changes
    assert rows_of(saved_overlay(spark, path)) == rows_of(overlay(layers, ["a", "b"]))


def test_layers_that_do_not_fit_leave_the_saved_rows(spark, tmp_path):
    path = str(tmp_path / "saved")
    base = spark.createDataFrame([(1, "x", "base"), (2, "x", "base")], SCHEMA)
    save_overlay(base, path, ["a", "b"], 4)
    with pytest.raises(Exception, match="DUPLICATED_KEY"):
        apply_layer(spark.createDataFrame([(1, "x", "p"), (1, "x", "q")], SCHEMA), path, ["a", "b"])
    with pytest.raises(ValueError):
        apply_layer(base.drop("value"), path, ["a", "b"])
    with pytest.raises(ValueError):
        apply_layer(base.withColumn("a", base.a.cast("bigint")), path, ["a", "b"])
    assert apply_layer(base.where("false"), path, ["a", "b"]) == []
    assert rows_of(saved_overlay(spark, path)) == rows_of(base)
    with pytest.raises(ValueError):
        saved_overlay(spark, f"{SF_DIR}/nation.parquet")


def test_keys_alone_can_be_saved(spark, tmp_path):
    path = str(tmp_path / "saved")
    save_overlay(spark.range(5), path, ["id"], 2)
    apply_layer(spark.range(3, 8), path, ["id"])
    assert sorted(r.id for r in saved_overlay(spark, path).collect()) == list(range(8))
