"""Rows dealt out by what they cost."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import spread_by_weight


def loads(df, weight, n):
    """Rows and weight of each partition."""
    found = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()
    assert all(0 <= r.p < n for r in found)
    return {r.p: (r.n, r.w or 0) for r in found}


@pytest.mark.parametrize("weight", ["1", "id", "IF(id < 1000, 1000, 1)", "IF(id % 97 = 0, 5000, id % 3)"])
def test_no_partition_is_much_heavier_than_the_mean(spark, weight):
    df = spark.range(0, 20000, 1, 7).selectExpr("id", f"CAST({weight} AS BIGINT) AS w")
    out = spread_by_weight(df, "w", 12)
    assert out.columns == ["id", "w"] and out.rdd.getNumPartitions() == 12
    total, heaviest_row = df.agg(F.sum("w"), F.max("w")).first()
    found = loads(out, "w", 12)
    assert max(w for _, w in found.values()) <= total / 12 * 1.01 + heaviest_row
    assert sorted(r.id for r in out.collect()) == list(range(20000))


def test_rows_without_a_weight_are_dealt_out_too(spark):
    odd = "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN double('NaN') WHEN id % 5 = 2 THEN -4 WHEN id % 5 = 3 THEN double('Infinity') ELSE 0 END"
    df = spark.range(0, 1000, 1, 3).selectExpr("id", f"{odd} AS w")
    found = loads(spread_by_weight(df, "w", 8), F.lit(1), 8)
    assert len(found) == 8 and max(n for n, _ in found.values()) <= 1000 / 8 + 1


def test_empty_tables_expressions_and_clashing_names(spark):
    assert spread_by_weight(spark.range(0), "id", 4).count() == 0
    df = spark.range(50).selectExpr("id AS _slot", "repeat('x', CAST(id AS INT)) AS _weight")
    out = spread_by_weight(df, F.length("_weight"), 4)
    assert out.columns == df.columns and sorted(out.collect()) == sorted(df.collect())
    one = spark.createDataFrame([(1, None), (2, "a")], "id int, text string").where("id = 2")
    assert [tuple(r) for r in spread_by_weight(one, F.length("text"), 3).collect()] == [(2, "a")]
