"""Comparing a Spark result with DuckDB's, regardless of row order."""

from __future__ import annotations

from collections import Counter

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duckdb_with(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return connection


# DuckDB's name for each type that query results have.
DUCKDB_TYPES = {
    "bigint": "BIGINT", "boolean": "BOOLEAN", "date": "DATE", "double": "DOUBLE",
    "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
}


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def difference(df, connection, sql):
    """None if equal, else a text that shows what differs."""
    expected = connection.execute(sql)
    expected_columns = [d[0] for d in expected.description]
    types = sorted((name, DUCKDB_TYPES[kind]) for name, kind in df.dtypes)
    expected_types = sorted((d[0], str(d[1])) for d in expected.description)
    if types != expected_types:
        return f"columns {types} != {expected_types}"
    table = df.toArrow()
    actual = rows_by_name(table.column_names, zip(*[c.to_pylist() for c in table.columns]))
    wanted = rows_by_name(expected_columns, expected.fetchall())
    if actual == wanted:
        return None
    extra, missing = list((actual - wanted).items())[:3], list((wanted - actual).items())[:3]
    return f"{table.num_rows} rows, {sum(wanted.values())} wanted; extra {extra}; missing {missing}"
