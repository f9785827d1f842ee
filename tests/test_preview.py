from pyspark.sql import functions as F

from foliospark.operators import preview, render_markdown


def lines(df, n=100):
    return [r.line for r in sorted(render_markdown(df, n).collect())]


def test_values_become_text_and_null_stays(spark):
    df = spark.sql(
        "SELECT 1 AS i, CAST(1e10 AS DOUBLE) AS d, array(1, 2) AS a, map('k', 1.50) AS m,"
        " NULL AS n, DATE '2024-01-02' AS day, named_struct('x', true) AS s"
    )
    assert preview(df).first().asDict() == {
        "i": "1", "d": "1.0E10", "a": "[1, 2]", "m": "{k -> 1.50}", "n": None,
        "day": "2024-01-02", "s": "{true}",
    }
    assert all(f.dataType.simpleString() == "string" for f in preview(df).schema)


def test_limit(spark):
    assert preview(spark.range(1000)).count() == 100
    assert preview(spark.range(1000), 7).count() == 7


def test_repeated_names_keep_their_values(spark):
    df = spark.sql("SELECT 1 AS a, NULL AS a, 2 AS a_2, 3 AS a")
    assert preview(df).columns == ["a", "a_3", "a_2", "a_4"]
    assert tuple(preview(df).first()) == ("1", None, "2", "3")


def test_frame_without_columns(spark):
    done = spark.sql("CREATE OR REPLACE TEMP VIEW test_preview_view AS SELECT 1")
    assert preview(done).columns == [] and preview(done).collect() == []
    assert lines(done) == []


def test_markdown_escapes(spark):
    df = spark.sql(r"SELECT 'x|y' AS `a|b`, 'one\ntwo\r\nthree' AS t, NULL AS n")
    assert lines(df) == [r"| a\|b | t | n |", "|---|---|---|", r"| x\|y | one<br>two<br>three |  |"]


def test_markdown_of_an_empty_frame(spark):
    assert lines(spark.range(0)) == ["| id |", "|---|"]


def test_markdown_numbers_lines_in_order(spark):
    df = spark.range(0, 5000, 1, 20).orderBy(F.desc("id"))
    rendered = sorted(render_markdown(df, 30).collect())
    assert [r.line_no for r in rendered] == list(range(32))
    assert [r.line for r in rendered[2:]] == [f"| {i} |" for i in range(4999, 4969, -1)]


def test_markdown_of_few_rows_in_many_partitions(spark):
    df = spark.range(0, 40, 1, 8).orderBy(F.desc("id"))
    assert lines(df)[2:] == [f"| {i} |" for i in range(39, -1, -1)]
