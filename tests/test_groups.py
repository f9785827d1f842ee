import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.operators import map_groups_tagged, register_group_function, register_row_function
from foliospark.plans import run_cell


def counting():
    """The function is made here, so that it is shipped by value."""

    def counted(report, key, batches):
        """A row a batch: its rows, and whether they come in order."""
        last, n = -1, 0
        for batch in batches:
            values = batch.column("v").to_pylist()
            report.append(f"{len(values)} rows")
            yield pa.RecordBatch.from_pydict(
                {"k": [str(key["k"])], "n": [len(values)], "ordered": [values == sorted(values) and values[0] >= last]}
            )
            last, n = values[-1], n + len(values)

    return counted


SCHEMA = "k string, n bigint, ordered boolean"


def test_groups_span_batches_and_none_is_held(spark):
    df = spark.range(60_000).selectExpr("IF(id < 45000, 'hot', concat('k', id % 7)) AS k", "(id * 7919) % 60000 AS v", "1 AS other")
    out = map_groups_tagged(df.repartition(9), ["k"], counting(), SCHEMA, "run", order=["v"], columns=["v"])
    rows = out.collect()
    sums, batches = defaultdict(int), defaultdict(int)
    for r in rows:
        sums[r["k"]] += r["n"]
        batches[r["k"]] += 1
    assert sums == {"hot": 45_000, **{f"k{i}": df.where(f"k = 'k{i}'").count() for i in range(7)}}
    assert all(r["ordered"] for r in rows)
    # a batch of Arrow has 10,000 rows, so the hot group came in five pieces or six
    assert batches["hot"] in (5, 6) and max(r["n"] for r in rows) <= 10_000
    ids = {r["k"]: r["child_id"] for r in rows}
    assert ids["hot"] == hashlib.md5(b'run:{"k":"hot"}').hexdigest() and len(set(ids.values())) == 8
    parts = sorted((r["part"], r["lines"]) for r in rows if r["k"] == "hot")
    assert [p for p, _ in parts] == list(range(len(parts))) and sum(len(lines) for _, lines in parts) == batches["hot"]


def test_null_and_nan_keys_empty_texts_and_unread_groups(spark):
    rows = [(None, 1.0, 1), (None, 1.0, 2), ("", float("nan"), 3), ("", float("nan"), 4), ("", None, 5), ("a", 0.5, 6)]
    df = spark.createDataFrame(rows, "k string, x double, v int")

    def first_only(report, key, batches):
        if key["k"] == "a":
            return
        yield next(batches).slice(0, 1).select(["v"])

    out = map_groups_tagged(df.repartition(3), ["k", "x"], first_only, "v int", "run", order=[F.desc("v")])
    assert sorted(r["v"] for r in out.collect()) == [2, 4, 5]
    assert map_groups_tagged(df.limit(0), ["k"], counting(), SCHEMA, "run").collect() == []
    with pytest.raises(Exception, match="no such group"):

        def failing(report, key, batches):
            raise ValueError("no such group")

        map_groups_tagged(df, ["k"], failing, SCHEMA, "run").collect()


def test_a_hot_key_in_pieces(spark):
    df = spark.range(20_000).selectExpr("'hot' AS k", "id AS v")
    out = map_groups_tagged(df, ["k"], counting(), SCHEMA, "run", columns=["v"], pieces=8)
    rows = out.collect()
    assert len({r["child_id"] for r in rows}) == 8 and sum(r["n"] for r in rows) == 20_000
    assert max(r["n"] for r in rows) < 3000
    with pytest.raises(ValueError, match="piece"):
        map_groups_tagged(df.withColumnRenamed("v", "piece"), ["k"], counting(), SCHEMA, "run", pieces=2)


def test_names_of_its_own_that_the_table_has_too(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, child_id string")

    def names(report, key, batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"names": [",".join(batch.schema.names)], "n": [batch.num_rows]})

    assert [tuple(r)[:2] for r in map_groups_tagged(df, ["k"], names, "names string, n int", "run").collect()] == [("k,child_id", 2)]
    with pytest.raises(ValueError, match="taken"):
        map_groups_tagged(df, ["k"], names, "lines string", "run")


def test_one_shuffle_and_pruned_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")

    def none(report, key, batches):
        yield from ()

    plan = map_groups_tagged(df, ["o_custkey"], none, "n int", "run", order=["o_orderkey"], columns=["o_totalprice"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "o_orderpriority" not in text


def test_functions_that_sql_calls(spark):
    spark.range(25_000).selectExpr("id", "id % 3 AS k").createOrReplaceTempView("test_udtf_rows")

    def cells(session):
        register_row_function(session, "test_odd", lambda row: {"n": row["id"]} if row["id"] % 2 else None, "n bigint")
        register_group_function(
            session, "test_sum", lambda: [0, 0],
            lambda state, row: state.__setitem__(slice(2), [state[0] + row["id"], state[1] + 1]),
            "total bigint, n int", lambda state: [{"total": state[0], "n": state[1]}],
        )
        register_row_function(session, "test_batch", lambda batch: batch.select(["id"]), "id bigint", batched=True)
        register_row_function(session, "test_bad", lambda row: {"m": 1}, "n bigint")

    run_cell(spark, cells)
    odd = run_cell(spark, "%sql\nSELECT count(*) AS n, min(n) AS least FROM test_odd(TABLE(test_udtf_rows))")[0].frame
    assert [tuple(r) for r in odd.collect()] == [(12_500, 1)]
    sums = run_cell(spark, "%sql\nSELECT * FROM test_sum(TABLE(test_udtf_rows) PARTITION BY k ORDER BY id DESC)")[0].frame
    want = [(sum(range(k, 25_000, 3)), len(range(k, 25_000, 3))) for k in range(3)]
    assert sorted(tuple(r) for r in sums.collect()) == sorted(want)
    plan = sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "ArrowEvalPythonUDTF" in plan and plan.count("Exchange hashpartitioning") == 1
    batch = spark.sql("SELECT count(*) AS n FROM test_batch(TABLE(test_udtf_rows))")
    assert batch.first()["n"] == 25_000
    with pytest.raises(Exception, match="not in the result schema"):
        spark.sql("SELECT * FROM test_bad(TABLE(test_udtf_rows))").collect()
    empty = spark.sql("SELECT * FROM test_sum(TABLE(SELECT * FROM test_udtf_rows WHERE id < 0) PARTITION BY k)")
    assert empty.collect() == []
