"""Cells, notebooks, parameters and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import (
    preview,
    register_group_function,
    register_row_function,
    render_markdown,
)
from foliospark.plans import run_cell, run_notebook, run_script_with_params, run_sql_script
from foliospark.plans.notebook import NOTEBOOK_REPORT
from foliospark.queries.inputs import table, views
from foliospark.shared_storage import fresh_folder


def cells_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL cell makes a view, a function cell reads it."""
    views(spark, sf_dir, "folio_run_cell", "customer", "orders")
    run_cell(
        spark,
        """%sql
        CREATE OR REPLACE TEMP VIEW folio_run_cell_spending AS
        SELECT o_custkey AS c_custkey, count(*) AS n_orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
        FROM folio_run_cell_orders GROUP BY o_custkey;
        """,
    )

    def named(session):
        spending = session.table("folio_run_cell_spending")
        return session.table("folio_run_cell_customer").join(spending, "c_custkey").select(
            "c_custkey", "c_name", "n_orders", "spent"
        )

    return run_cell(spark, named)[0].frame


def functions_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code cell registers functions of rows and of groups, a SQL cell calls them on tables."""
    views(spark, sf_dir, "folio_udtf", "orders")

    def functions(session):
        def in_cents(row):
            if row["o_orderstatus"] == "P":
                return None
            return {"customer": row["o_custkey"], "order": row["o_orderkey"], "cents": round(row["o_totalprice"] * 100)}

        def streak(state, row):
            """The length of the run of rising orders that ends here."""
            state["run"] = state.get("run", 0) + 1 if row["cents"] > state.get("cents", -1) else 1
            state["cents"], state["best"] = row["cents"], max(state.get("best", 0), state["run"])
            state["customer"] = row["customer"]
            yield {"customer": row["customer"], "order": row["order"], "run": state["run"]}

        def longest(state):
            if state:
                yield {"customer": state["customer"], "order": None, "run": state["best"]}

        register_row_function(session, "folio_in_cents", in_cents, "customer bigint, order bigint, cents bigint")
        register_group_function(session, "folio_streaks", dict, streak, "customer bigint, order bigint, run int", longest)

    run_cell(spark, functions)
    cell = """%sql
        SELECT * FROM folio_streaks(
            TABLE(SELECT * FROM folio_in_cents(TABLE(SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM folio_udtf_orders)))
            PARTITION BY customer ORDER BY order
        )
    """
    return run_cell(spark, cell)[0].frame


def sql_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""Several statements, an escaped semicolon and empty pieces between them."""
    views(spark, sf_dir, "folio_script", "events")
    return run_sql_script(
        spark,
        r"""
        CREATE OR REPLACE TEMP VIEW folio_script_daily AS
        SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events
        FROM folio_script_events GROUP BY CAST(ts AS DATE), event_type;
        ;
        SELECT day, concat_ws('\;', event_type, n_events) AS summary FROM folio_script_daily;
        """,
    )[-1].frame


def script_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement shows, before the next one runs: a table counted, grown and counted again."""
    views(spark, sf_dir, "folio_order", "part")
    folder = fresh_folder(spark, "script-order")
    results = run_sql_script(
        spark,
        f"""
        DROP TABLE IF EXISTS folio_order_parts;
        CREATE TABLE folio_order_parts USING parquet LOCATION '{folder}'
        AS SELECT p_partkey, p_size FROM folio_order_part WHERE p_size <= 25;
        SELECT count(*) AS n, sum(p_size) AS size FROM folio_order_parts;
        INSERT INTO folio_order_parts SELECT p_partkey, p_size FROM folio_order_part;
        SELECT count(*) AS n, sum(p_size) AS size FROM folio_order_parts;
        DROP TABLE folio_order_parts
        """,
    )
    shown = [row for result in results for row in result.shown]
    rows = [(place, row["n"], row["size"]) for place, row in enumerate(shown, start=1)]
    return spark.createDataFrame(rows, "place int, n string, size string")


def notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report whose third cell fails and whose sixth cell ends it."""
    views(spark, sf_dir, "folio_notebook", "orders", "lineitem")

    def priorities(session):
        orders = session.table("folio_notebook_orders")
        return orders.groupBy("o_orderpriority").count().orderBy("o_orderpriority")

    def stop(session):
        raise RuntimeError("shutdown requested")

    archive = fresh_folder(spark, "notebook")
    run_notebook(
        spark,
        [
            "%sql\nSELECT count(*) AS n FROM folio_notebook_orders;"
            "SELECT l_returnflag, count(*) AS n FROM folio_notebook_lineitem"
            " GROUP BY l_returnflag ORDER BY l_returnflag",
            priorities,
            "%sql\nSELECT max(o_orderkey) AS top FROM folio_notebook_orders;"
            "SELECT nothing FROM folio_notebook_nowhere; SELECT 1 AS never",
            "%sql\nCREATE OR REPLACE TEMP VIEW folio_notebook_flags AS"
            " SELECT DISTINCT l_linestatus FROM folio_notebook_lineitem",
            "%sql\nSELECT l_linestatus FROM folio_notebook_flags ORDER BY l_linestatus",
            stop,
            "%sql\nSELECT 1 AS never",
        ],
        archive=archive,
    )
    report = spark.read.schema(NOTEBOOK_REPORT).json(archive)
    return report.select(
        "cell", "name", "status", F.col("error").isNotNull().alias("failed"),
        F.concat_ws("\n", "lines").alias("text"),
    )


def script_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "folio_params", "orders")
    script = """
        SELECT o_orderkey, o_totalprice FROM folio_params_orders
        WHERE o_totalprice >= :min_price AND o_orderstatus = :status
    """
    defaults = {"min_price": 0.0, "status": "O"}
    return run_script_with_params(spark, script, defaults, {"min_price": 250000.0})[0].frame


def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of the first hundred orders: the limit is the feature."""
    return preview(table(spark, sf_dir, "orders").orderBy("o_orderkey"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of the latest events, NULL and bars included."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat_ws("|", "event_type", "user_id").alias("who"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    return render_markdown(events.orderBy(F.desc("event_id")))


QUERIES = {
    "cell_functions": functions_in_cells,
    "run_cell": cells_in_turn,
    "sql_script": sql_script,
    "script_order": script_order,
    "notebook": notebook,
    "script_params": script_params,
    "preview": preview_query,
    "markdown": markdown,
}

ORACLES = {
    "cell_functions": """
        WITH cents AS (
            SELECT o_custkey AS customer, o_orderkey AS "order", CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
            FROM orders WHERE o_orderstatus <> 'P'
        ), breaks AS (
            SELECT *, CASE WHEN cents > lag(cents) OVER (PARTITION BY customer ORDER BY n) THEN NULL ELSE n END AS begun
            FROM cents
        ), runs AS (
            SELECT customer, "order",
                   CAST(n - max(begun) OVER (PARTITION BY customer ORDER BY n ROWS UNBOUNDED PRECEDING) + 1 AS INTEGER) AS run
            FROM breaks
        )
        SELECT * FROM runs UNION ALL SELECT customer, NULL, max(run) FROM runs GROUP BY customer
    """,
    "run_cell": """
        SELECT c_custkey, c_name, count(*) AS n_orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name
    """,
    "sql_script": """
        SELECT CAST(ts AS DATE) AS day, event_type || ';' || count(*) AS summary
        FROM events GROUP BY CAST(ts AS DATE), event_type
    """,
    "script_order": """
        SELECT 1 AS place, CAST(count(*) AS VARCHAR) AS n, CAST(sum(p_size) AS VARCHAR) AS size
        FROM part WHERE p_size <= 25
        UNION ALL
        SELECT 2, CAST(count(*) AS VARCHAR), CAST(sum(p_size) AS VARCHAR)
        FROM (SELECT p_size FROM part WHERE p_size <= 25 UNION ALL SELECT p_size FROM part)
    """,
    "notebook": r"""
        SELECT 1 AS cell, 'Cmd1' AS name, 'ok' AS status, false AS failed,
               '| n |' || chr(10) || '|---|' || chr(10) || '| ' || count(*) || ' |' AS text
        FROM orders
        UNION ALL
        SELECT 1, 'Cmd1', 'ok', false,
               '| l_returnflag | n |' || chr(10) || '|---|---|' || chr(10) || string_agg(
                   '| ' || l_returnflag || ' | ' || n || ' |', chr(10) ORDER BY l_returnflag)
        FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag)
        UNION ALL
        SELECT 2, 'Cmd2', 'ok', false,
               '| o_orderpriority | count |' || chr(10) || '|---|---|' || chr(10) || string_agg(
                   '| ' || o_orderpriority || ' | ' || n || ' |', chr(10) ORDER BY o_orderpriority)
        FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority)
        UNION ALL
        SELECT 3, 'Cmd3', 'ok', false,
               '| top |' || chr(10) || '|---|' || chr(10) || '| ' || max(o_orderkey) || ' |'
        FROM orders
        UNION ALL SELECT 3, 'Cmd3', 'error', true, ''
        UNION ALL SELECT 4, 'Cmd4', 'ok', false, ''
        UNION ALL
        SELECT 5, 'Cmd5', 'ok', false,
               '| l_linestatus |' || chr(10) || '|---|' || chr(10) || string_agg(
                   '| ' || l_linestatus || ' |', chr(10) ORDER BY l_linestatus)
        FROM (SELECT DISTINCT l_linestatus FROM lineitem)
        UNION ALL SELECT 6, 'Cmd6', 'shutdown', true, ''
    """,
    "script_params": """
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_totalprice >= 250000.0 AND o_orderstatus = 'O'
    """,
    "preview": """
        SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
               o_totalprice::VARCHAR AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate,
               o_orderpriority
        FROM orders ORDER BY orders.o_orderkey LIMIT 100
    """,
    "markdown": r"""
        WITH shown AS (
            SELECT *, row_number() OVER (ORDER BY event_id DESC) AS n FROM events
        )
        SELECT CAST(0 AS BIGINT) AS line_no, '| event_id | who | value |' AS line
        UNION ALL SELECT 1, '|---|---|---|'
        UNION ALL
        SELECT n + 1, '| ' || event_id || ' | ' || event_type || '\|' || user_id || ' | '
               || CASE WHEN event_type = 'error' THEN '' ELSE value::VARCHAR END || ' |'
        FROM shown WHERE n <= 100
    """,
}
