"""SQL that users bring along, run as scripts: joins, aggregates, windows, sets.

These are Spark's own features; the queries show that scripts carry them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import run_sql_script
from foliospark.queries.inputs import views


def _script(name: str, tables: list[str], sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs ``sql`` as a script; ``{t}`` in it stands for the view prefix."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, f"folio_{name}", *tables)
        return run_sql_script(spark, sql.replace("{t}", f"folio_{name}_"))[-1].frame

    return query


REVENUE_BY_REGION = """
    CREATE OR REPLACE TEMP VIEW {t}sales AS
    SELECT r_name, n_name, c_mktsegment, l_extendedprice, l_discount
    FROM {t}lineitem
    JOIN (SELECT o_orderkey, c_mktsegment
          FROM {t}orders JOIN {t}customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey
    JOIN (SELECT s_suppkey, n_name, r_name
          FROM {t}supplier JOIN {t}nation ON s_nationkey = n_nationkey
          JOIN {t}region ON n_regionkey = r_regionkey) ON l_suppkey = s_suppkey;

    SELECT r_name, n_name, c_mktsegment, count(*) AS n_lines,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))
                    * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
    FROM {t}sales GROUP BY r_name, n_name, c_mktsegment;
"""

_SCRIPTS = {
    "sql_filter_project": (
        ["lineitem"],
        """
        SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS saved
        FROM {t}lineitem
        WHERE l_shipdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00'
          AND l_shipdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'
          AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
        """,
        """
        SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS saved
        FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
          AND l_discount BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.07 AS DOUBLE) AND l_quantity < 24
        """,
    ),
    "sql_join_multi": (
        ["lineitem", "orders", "customer", "supplier", "nation", "region"],
        REVENUE_BY_REGION,
        """
        SELECT r_name, n_name, c_mktsegment, count(*) AS n_lines,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))
                        * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, n_name, c_mktsegment
        """,
    ),
    "sql_semi_anti": (
        ["customer", "orders"],
        """
        -- Distinct first: a customer with many orders is one row per task then
        CREATE OR REPLACE TEMP VIEW {t}pending AS
        SELECT DISTINCT o_custkey FROM {t}orders WHERE o_orderstatus = 'P';
        CREATE OR REPLACE TEMP VIEW {t}urgent AS
        SELECT DISTINCT o_custkey FROM {t}orders WHERE o_orderpriority = '1-URGENT';
        SELECT c_custkey, c_name FROM {t}customer
        WHERE EXISTS (SELECT 1 FROM {t}pending WHERE o_custkey = c_custkey)
          AND NOT EXISTS (SELECT 1 FROM {t}urgent WHERE o_custkey = c_custkey)
        """,
        """
        SELECT c_custkey, c_name FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
          AND NOT EXISTS (SELECT 1 FROM orders
                          WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
        """,
    ),
    "sql_rollup": (
        ["lineitem"],
        """
        SELECT l_returnflag, l_linestatus, ship_year,
               grouping_id(l_returnflag, l_linestatus, ship_year) AS level,
               sum(n) AS n_lines, CAST(sum(q) AS DOUBLE) AS quantity
        FROM (SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year,
                     count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q
              FROM {t}lineitem GROUP BY l_returnflag, l_linestatus, year(l_shipdate))
        GROUP BY ROLLUP (l_returnflag, l_linestatus, ship_year)
        """,
        """
        SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
               CAST(grouping_id(l_returnflag, l_linestatus, year(l_shipdate)) AS BIGINT) AS level,
               count(*) AS n_lines,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, year(l_shipdate))
        """,
    ),
    "sql_window_rank": (
        ["orders", "customer"],
        """
        SELECT c_mktsegment, o_orderkey, o_totalprice, place FROM (
            SELECT c_mktsegment, o_orderkey, o_totalprice,
                   row_number() OVER (PARTITION BY c_mktsegment
                                      ORDER BY o_totalprice DESC, o_orderkey) AS place
            FROM {t}orders JOIN {t}customer ON o_custkey = c_custkey
        ) WHERE place <= 10
        """,
        """
        SELECT c_mktsegment, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM (
            SELECT c_mktsegment, o_orderkey, o_totalprice,
                   row_number() OVER (PARTITION BY c_mktsegment
                                      ORDER BY o_totalprice DESC, o_orderkey) AS place
            FROM orders JOIN customer ON o_custkey = c_custkey
        ) WHERE place <= 10
        """,
    ),
    "sql_topk": (
        ["lineitem", "part"],
        """
        SELECT p_brand, p_name, l_orderkey, l_linenumber, l_extendedprice
        FROM {t}lineitem JOIN {t}part ON l_partkey = p_partkey
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25
        """,
        """
        SELECT p_brand, p_name, l_orderkey, l_linenumber, l_extendedprice
        FROM lineitem JOIN part ON l_partkey = p_partkey
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25
        """,
    ),
    "sql_setops": (
        ["customer", "supplier", "orders"],
        """
        CREATE OR REPLACE TEMP VIEW {t}active AS
        SELECT DISTINCT o_custkey FROM {t}orders;
        -- Few nations, many customers: distinct first, so that the rows do not move
        SELECT DISTINCT 'both' AS kind, c_nationkey AS code FROM {t}customer
        INTERSECT SELECT DISTINCT 'both', s_nationkey FROM {t}supplier
        UNION ALL
        (SELECT 'idle', c_custkey FROM {t}customer EXCEPT SELECT 'idle', o_custkey FROM {t}active)
        """,
        """
        SELECT kind, CAST(code AS BIGINT) AS code FROM (
            (SELECT 'both' AS kind, c_nationkey AS code FROM customer
             INTERSECT SELECT 'both', s_nationkey FROM supplier)
            UNION ALL
            (SELECT 'idle', c_custkey FROM customer EXCEPT SELECT 'idle', o_custkey FROM orders)
        )
        """,
    ),
    "sql_scalar_fn": (
        ["documents"],
        """
        SELECT doc_id, upper(lang) AS lang, length(text) AS n_letters, md5(text) AS digest,
               size(split(text, ' ')) AS n_pieces, replace(source, 'src', 'source ') AS origin,
               abs(n_chars - length(text)) AS off_by
        FROM {t}documents
        """,
        """
        SELECT doc_id, upper(lang) AS lang, CAST(length(text) AS INTEGER) AS n_letters,
               md5(text) AS digest, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_pieces,
               replace(source, 'src', 'source ') AS origin, abs(n_chars - length(text)) AS off_by
        FROM documents
        """,
    ),
}

QUERIES = {name: _script(name, tables, sql) for name, (tables, sql, _) in _SCRIPTS.items()}
ORACLES = {name: oracle for name, (_, _, oracle) in _SCRIPTS.items()}
