import datetime
import decimal
import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from foliospark.operators import (
    distribute,
    distribute_eval,
    map_eval,
    map_isolated,
    map_partitions_tagged,
    report_index,
    slot_count,
    spread,
)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def partition_sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_spread_is_even_whatever_the_keys(spark):
    skewed = spark.range(0, 8000, 1, 1).withColumn("key", F.lit(1))
    sizes = partition_sizes(spread(skewed, 8))
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert len(partition_sizes(spread(skewed))) == slot_count(spark)


def test_spread_cached(spark):
    cached = spread(spark.range(10), 2, cache=True)
    assert cached.is_cached and cached.count() == 10
    cached.unpersist()


def test_one_row_per_element_whatever_happens(spark):
    def fn(report, row):
        report.append(f"saw {row['id']}")
        if row["id"] % 5 == 1:
            raise ValueError("x" * 5000)
        if row["id"] % 5 == 2:
            return {"n": "no number", "t": "text"}
        if row["id"] % 5 == 3:
            return {"unknown": 1}
        if row["id"] % 5 == 4:
            raise SystemExit(3)
        return {"n": row["id"] * 10}

    rows = map_isolated(spark.range(0, 1000, 1, 3), fn, "id", "n int, t string", "run").collect()
    assert sorted(r.key for r in rows) == list(range(1000))
    for r in rows:
        assert r.child_id == md5(f"run:{r.key}") and r.lines == [f"saw {r.key}"]
        if r.key % 5 == 0:
            assert (r.status, r.error, r.n, r.t) == ("ok", None, r.key * 10, None)
        else:
            assert (r.status, r.n, r.t) == ("error", None, None)
    errors = {r.key % 5: r.error for r in rows}
    assert errors[1].startswith("ValueError: xxx") and len(errors[1]) == 5012
    assert "no number" in errors[2] and "unknown" in errors[3] and errors[4] == "SystemExit: 3"


def test_odd_reports_and_results_do_not_spread(spark):
    def fn(report, row):
        report.append(row["id"])
        report.append("half a pair \ud800")
        if row["id"] == 1:
            return {"t": "half a pair \ud800"}
        if row["id"] == 2:
            return ["not a dict"]
        if row["id"] == 3:
            raise RuntimeError("half a pair \ud800")
        if row["id"] == 4:
            raise Mute()
        if row["id"] == 5:
            return []
        return None

    class Mute(Exception):
        def __str__(self):
            raise RuntimeError("no words")

    rows = sorted(map_isolated(spark.range(7), fn, "id", "t string", "run").collect())
    assert [r.status for r in rows] == ["ok", "error", "error", "error", "error", "error", "ok"]
    assert rows[4].error == "Mute: a Mute that has no text"
    assert all(r.lines == [str(r.key), "half a pair ?"] for r in rows)


def test_ids_do_not_depend_on_placement(spark):
    def fn(report, row):
        return {"n": row["id"]}

    few = map_isolated(spark.range(0, 50, 1, 2), fn, "id", "n bigint", "run")
    many = map_isolated(spark.range(0, 50, 1, 7), fn, "id", "n bigint", "run", slots=5)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_result_types(spark):
    day, moment = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 1, 2, 3)
    aware = moment.replace(tzinfo=datetime.timezone.utc)

    def fn(report, row):
        return {
            "d": day, "ts": aware, "ntz": moment, "dec": decimal.Decimal("1.50"),
            "arr": [1.5, None], "m": {"k": 1}, "s": {"x": 1, "y": ["a"]}, "b": b"\x00", "f": True,
        }

    schema = (
        "d date, ts timestamp, ntz timestamp_ntz, dec decimal(10,2), arr array<double>,"
        " m map<string,int>, s struct<x:int,y:array<string>>, b binary, f boolean"
    )
    keyed = spark.createDataFrame([("k1",)], "name string")
    row = map_isolated(keyed, fn, "name", schema, "run").select("*", F.unix_seconds("ts")).first()
    assert (row.key, row.status, row.error) == ("k1", "ok", None)
    assert (row.d, row.ntz, row.dec, row.arr) == (day, moment, decimal.Decimal("1.50"), [1.5, None])
    assert (row.m, row.s.asDict()) == ({"k": 1}, {"x": 1, "y": ["a"]})
    assert (bytes(row.b), row.f) == (b"\0", True)
    assert row["unix_seconds(ts)"] == int(aware.timestamp())


def test_taken_names_are_refused(spark):
    with pytest.raises(ValueError):
        map_isolated(spark.range(1), lambda report, row: {}, "id", "status string", "run")
    with pytest.raises(ValueError):
        map_partitions_tagged(spark.range(1), lambda report, batches: batches, "lines int", "run")


def test_map_eval(spark):
    in_spark = map_eval(spark.range(5), F.col("id") * 2)
    assert [r[0] for r in in_spark.collect()] == [0, 2, 4, 6, 8]
    in_python = map_eval(spark.range(5), lambda row: {"x": row["id"] * 2}, "x bigint")
    assert [r.x for r in in_python.collect()] == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        map_eval(spark.range(5), lambda row: {"x": 1})


@pytest.mark.parametrize(
    "fn", [lambda row: {"x": 1 // row["id"]}, lambda row: {"x": "text"}, lambda row: {"y": 1}]
)
def test_map_eval_errors_fail_the_query(spark, fn):
    with pytest.raises(Exception, match="(ZeroDivisionError|ArrowInvalid|KeyError)"):
        map_eval(spark.range(5), fn, "x int").collect()


def test_distribute(spark):
    def greet(report, row):
        report.append(f"slot {row['id']} reports")
        return {"result": str(row["id"])}

    rows = sorted(distribute(spark, greet, 4).collect())
    assert [(r.key, r.result, r.child_id) for r in rows] == [
        (i, str(i), md5(f"run:{i}")) for i in range(4)
    ]
    assert distribute(spark, greet).count() == spark.sparkContext.defaultParallelism
    squares = distribute_eval(spark, F.col("id") * F.col("id"), 4)
    assert [r[0] for r in squares.collect()] == [0, 1, 4, 9]


def row_counter():
    """Made here rather than imported, so that the workers need not find this module."""

    def counted(report, batches):
        n = 0
        for batch in batches:
            n += batch.num_rows
            yield batch.select(["id"])
        report.append(f"{n} rows")

    return counted


def test_partitions_are_tagged_and_report_last(spark):
    df = spark.range(0, 25000, 1, 3)
    rows = map_partitions_tagged(df, row_counter(), "id bigint", "run").collect()
    assert sorted(r.id for r in rows) == list(range(25000))
    by_child = {}
    for r in rows:
        by_child.setdefault(r.child_id, []).append(r)
    assert by_child.keys() == {md5(f"run:{i}") for i in range(3)}
    for own in by_child.values():
        assert own[-1].lines == [f"{len(own)} rows"]
        assert all(r.lines is None for r in own[:-1])


def test_partitions_without_output_have_no_report(spark):
    def few(report, batches):
        report.append("here")
        for batch in batches:
            yield batch.filter(pc.less(batch.column("id"), 10))

    df = spark.range(0, 100, 1, 4)
    tagged = map_partitions_tagged(df, few, "id bigint", "run")
    assert [r.child_id for r in report_index(tagged).collect()] == [md5("run:0")]
    spread_out = map_partitions_tagged(spark.range(3), row_counter(), "id bigint", "run", slots=8)
    assert spread_out.select("child_id").distinct().count() <= 3


def test_partition_columns_by_name_and_type(spark):
    def swapped(report, batches):
        for batch in batches:
            twice = pc.multiply(batch.column("id"), 2)
            yield pa.RecordBatch.from_arrays([twice, batch.column("id")], names=["twice", "id"])

    tagged = map_partitions_tagged(spark.range(3), swapped, "id int, twice double", "run")
    assert sorted((r.id, r.twice) for r in tagged.collect()) == [(0, 0.0), (1, 2.0), (2, 4.0)]


def test_partition_errors_fail_the_query(spark):
    def broken(report, batches):
        yield from batches
        raise RuntimeError("partition is broken")

    with pytest.raises(Exception, match="partition is broken"):
        map_partitions_tagged(spark.range(3), broken, "id bigint", "run").collect()


def test_report_index(spark):
    df = spark.createDataFrame([("aa",), ("aa",), ("bb",)], "child_id string")
    rows = sorted(report_index(df).collect())
    assert [r.child_id for r in rows] == ["aa", "bb"]
    assert rows[0].line == "Subreport: aa [markdown](aa.md) [html](aa.html) [pdf](aa.pdf)"
    assert (rows[1].markdown, rows[1].html, rows[1].pdf) == ("bb.md", "bb.html", "bb.pdf")
    assert report_index(df, distinct=False).count() == 3


def test_every_type_reaches_the_function_and_returns(spark):
    schema = (
        "i int, l bigint, f float, d double, s string, t boolean, day date, ntz timestamp_ntz,"
        " dec decimal(10,2), arr array<int>, m map<string,int>, st struct<x:int,y:string>, b binary"
    )
    full = (
        1, 2**40, 0.1, float("inf"), "é|\n", True, datetime.date(2024, 2, 29),
        datetime.datetime(2024, 2, 29, 1, 2, 3, 4), decimal.Decimal("1.50"), [1, None], {"k": None},
        (1, None), b"\x00\xff",
    )
    empty = (None,) * len(full)
    for rows in ([full], [empty], [full, empty, full]):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        back = map_eval(df, lambda row: row, schema)
        assert back.collect() == df.collect()
        kept = map_isolated(df.withColumn("key", F.lit(1)), lambda report, row: {
            name: value for name, value in row.items() if name != "key"
        }, "key", schema, "run")
        assert kept.select(*df.columns).collect() == df.collect()
        assert {r.status for r in kept.collect()} == {"ok"}


def test_empty_frames(spark):
    nothing = spark.range(0)
    assert map_eval(nothing, lambda row: row, "id bigint").collect() == []
    assert map_isolated(nothing, lambda report, row: None, "id", "x int", "run").collect() == []
    tagged = map_partitions_tagged(nothing, row_counter(), "id bigint", "run")
    assert tagged.collect() == [] and report_index(tagged).collect() == []


def test_a_long_report_is_sent_in_parts(spark):
    """A line per row: a task never holds more lines than a batch has rows."""


    def fn(report, batches):
        for batch in batches:
            for value in batch.column("id").to_pylist():
                report.append(f"row {value}")
            yield batch
            assert len(report) <= 100

        report.append("end")

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        rows = map_partitions_tagged(spark.range(0, 1000, 1, 2), fn, "id bigint", "run").collect()
    finally:
        spark.conf.set(key, before)
    children = {}
    for row in rows:
        assert (row["part"] is None) == (row["lines"] is None)
        if row["lines"] is not None:
            children.setdefault(row["child_id"], {})[row["part"]] = row["lines"]
    assert len(children) == 2
    for parts in children.values():
        assert sorted(parts) == list(range(len(parts))) and len(parts) >= 9
        lines = [line for part in sorted(parts) for line in parts[part]]
        assert len(lines) == 501 and lines[-1] == "end"
    whole = [line for parts in children.values() for lines in parts.values() for line in lines]
    assert sorted(x for x in whole if x != "end") == sorted(f"row {i}" for i in range(1000))


def test_an_error_text_is_whole(spark):
    def fn(report, row):
        raise ValueError("x" * 5000)

    row = map_isolated(spark.range(1), fn, "id", "x int", "run").first()
    assert row["error"] == "ValueError: " + "x" * 5000


def test_map_eval_over_batches(spark):
    import pyarrow.compute as pc

    def twice(batch):
        return pa.RecordBatch.from_arrays([pc.multiply(batch.column("id"), 2)], names=["x"])

    out = map_eval(spark.range(5), twice, "x bigint", batched=True)
    assert sorted(r["x"] for r in out.collect()) == [0, 2, 4, 6, 8]
