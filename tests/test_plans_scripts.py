import pytest
from hypothesis import given
from hypothesis import strategies as st

from foliospark.plans import (
    run_cell,
    run_notebook,
    run_script_with_params,
    run_sql_script,
    split_statements,
)


def test_split_rule():
    text = "SELECT 1;\n;SELECT 'a\\;b' ; -- c;d\nSELECT 2"
    assert split_statements(text) == ["SELECT 1", r"SELECT 'a\;b'", "-- c", "d\nSELECT 2"]
    assert split_statements(" ; \n;") == []
    assert split_statements("") == []
    assert split_statements("SELECT 1;") == ["SELECT 1"]
    assert split_statements("SELECT ';'") == ["SELECT '", "'"]


@given(st.text(alphabet="a;\\\\ \n'", max_size=30))
def test_split_rule_equals_reading_letter_by_letter(text):
    pieces, before = [""], ""
    for letter in text:
        if letter == ";" and before != "\\":
            pieces.append("")
        else:
            pieces[-1] += letter
        before = letter
    assert split_statements(text) == [p.strip() for p in pieces if p.strip()]


def test_escaped_semicolon_reaches_the_literal(spark):
    assert run_sql_script(spark, r"SELECT 'a\;b' AS x")[0].frame.first()["x"] == "a;b"
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        run_sql_script(spark, r"SELECT 1 \; SELECT 2")


def test_triple_quotes_are_plain_text(spark):
    assert run_sql_script(spark, """SELECT '\"\"\"' AS x""")[0].frame.first()["x"] == '"' * 3


def test_statements_run_in_order_and_stop_at_the_first_failure(spark):
    seen = []
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        run_sql_script(
            spark,
            "CREATE OR REPLACE TEMP VIEW test_script_view AS SELECT 41 AS x;"
            "SELECT x + 1 AS y FROM test_script_view; selekt 1; DROP VIEW test_script_view",
            each=lambda result: seen.append(result.frame.collect()),
        )
    assert [[tuple(r) for r in rows] for rows in seen] == [[], [(42,)]]
    assert spark.table("test_script_view").first()["x"] == 41


def test_parameters(spark):
    script = "SELECT :a AS a, :b AS b; SELECT :b AS only_b"
    results = run_script_with_params(spark, script, {"a": 1, "b": "x"}, {"b": "it's; \\"})
    assert tuple(results[0].frame.first()) == (1, "it's; \\")
    assert results[1].frame.first()["only_b"] == "it's; \\"
    plain = run_script_with_params(spark, script, {"a": 1, "b": "x"})
    assert tuple(plain[0].frame.first()) == (1, "x")
    with pytest.raises(ValueError, match="nope"):
        run_script_with_params(spark, script, {"a": 1, "b": "x"}, {"nope": 1})


def test_cells(spark):
    assert [r.frame.first()[0] for r in run_cell(spark, "  %sql  \nSELECT 1; SELECT 2")] == [1, 2]
    assert run_cell(spark, "%sql") == []
    assert run_cell(spark, lambda s: s.range(3))[0].frame.count() == 3
    assert run_cell(spark, lambda s: 5)[0].shown == "5"
    with pytest.raises(ValueError):
        run_cell(spark, "SELECT 1")


def test_notebook_isolates_cells(spark):
    def explode(session):
        raise KeyError("gone")

    def only_effects(session):
        session.range(1).createOrReplaceTempView("test_notebook_view")

    report = run_notebook(
        spark,
        ["%sql\nSELECT 1 AS a; selekt 1; SELECT 2", explode, "print(1)", only_effects,
         "%sql\nSELECT * FROM test_notebook_view", "%sql\nSELECT raise_error('late') AS x"],
    )
    rows = report.collect()
    assert [(r["cell"], r["name"], r["status"]) for r in rows] == [
        (1, "Cmd1", "ok"), (1, "Cmd1", "error"), (2, "Cmd2", "error"), (3, "Cmd3", "error"),
        (4, "Cmd4", "ok"), (5, "Cmd5", "ok"), (6, "Cmd6", "error"),
    ]
    assert rows[0]["lines"] == ["| a |", "|---|", "| 1 |"]
    assert rows[1]["statement"] == "selekt 1" and "PARSE_SYNTAX_ERROR" in rows[1]["error"]
    assert rows[2]["statement"] == "explode" and "gone" in rows[2]["error"]
    assert rows[5]["lines"][-1] == "| 0 |"
    assert "late" in rows[6]["error"]


def test_shutdown_ends_the_notebook(spark):
    def stop(session):
        raise RuntimeError("shutdown now")

    rows = run_notebook(spark, ["%sql\nSELECT 1", stop, "%sql\nSELECT 2"]).collect()
    assert [(r["cell"], r["status"]) for r in rows] == [(1, "ok"), (2, "shutdown")]


def test_each_statement_is_shown_before_the_next_starts(spark):
    """The view is gone by the end of the cell, its content was shown before."""
    rows = run_notebook(
        spark,
        ["%sql\nCREATE OR REPLACE TEMP VIEW test_shown AS SELECT 5 AS x;"
         "SELECT * FROM test_shown; DROP VIEW test_shown; SELECT * FROM test_shown"],
    ).collect()
    assert [r["status"] for r in rows] == ["ok", "ok", "ok", "error"]
    assert rows[1]["lines"][-1] == "| 5 |"


def test_results_do_not_show_what_later_statements_write(spark, tmp_path):
    script = (
        f"DROP TABLE IF EXISTS test_order; CREATE TABLE test_order (x INT) USING parquet LOCATION '{tmp_path}/t';"
        "SELECT count(*) AS n FROM test_order; INSERT INTO test_order VALUES (:x);"
        "SELECT count(*) AS n FROM test_order; DROP TABLE test_order"
    )
    results = run_script_with_params(spark, script, {"x": 1})
    assert [[row["n"] for row in r.shown] for r in results] == [[], [], ["0"], [], ["1"], []]
    cell = run_cell(spark, "%sql\n" + script.replace(":x", "2").replace("/t'", "/u'"))
    assert [[row["n"] for row in r.shown] for r in cell] == [[], [], ["0"], [], ["1"], []]


def test_the_last_statement_is_not_run_for_its_preview(spark):
    result = run_sql_script(spark, "SELECT raise_error('run') AS x")[-1]
    assert result.statement.startswith("SELECT")
    with pytest.raises(Exception, match="run"):
        _ = result.shown


def test_what_is_no_frame_is_shown_as_text(spark):
    rows = run_notebook(spark, [lambda s: 5, lambda s: "a\nb", lambda s: None]).collect()
    assert [(r["status"], r["lines"]) for r in rows] == [("ok", ["5"]), ("ok", ["a", "b"]), ("ok", [])]


def test_a_traceback_does_not_stop_the_notebook(spark):
    from pyspark.sql import functions as F

    def worker(session):
        @F.udf("int")
        def shutdown_hook(x):
            raise RuntimeError("disk full")

        return session.range(1).select(shutdown_hook("id"))

    def told(session):
        @F.udf("int")
        def hook(x):
            raise RuntimeError("shutdown at noon")

        return session.range(1).select(hook("id"))

    rows = run_notebook(spark, [worker, "%sql\nSELECT 1 AS a", told, "%sql\nSELECT 2"]).collect()
    assert [(r["cell"], r["status"]) for r in rows] == [(1, "error"), (2, "ok"), (3, "shutdown")]


def test_cells_before_a_lost_driver_are_in_the_archive(spark, tmp_path):
    archive = str(tmp_path / "archive")

    def killed(session):
        raise SystemExit("the driver dies")

    with pytest.raises(SystemExit):
        run_notebook(spark, ["%sql\nSELECT 1 AS a; selekt 2", "%sql\nSELECT 3 AS b", killed], archive=archive)
    kept = sorted((r["cell"], r["status"]) for r in spark.read.json(archive).collect())
    assert kept == [(1, "error"), (1, "ok"), (2, "ok")]


def test_a_preview_is_one_job(spark):
    spark.sparkContext.setJobGroup("test-preview", "previews")
    cells = ["%sql\nSELECT id AS a FROM range(5); SELECT id + 1 AS b FROM range(7)"]
    run_notebook(spark, cells)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("test-preview")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 2


def test_empty_notebook(spark):
    assert run_notebook(spark, []).collect() == []


def test_every_notebook_has_the_sample_view(spark):
    cell = "%sql\n SELECT * FROM guids\n"
    row = run_notebook(spark, [cell]).first()
    assert row["status"] == "ok" and row["lines"][:2] == ["| guid |", "|---|"]
    assert len(row["lines"]) == 102
