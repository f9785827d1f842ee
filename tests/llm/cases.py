"""Fixtures of the operators: awkward rows, and the given tables as Python values."""

from __future__ import annotations

import duckdb

SF_DIR = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000))
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"

#: id, text, and two columns whose names operators might use themselves
ROWS = [
    (1, PROSE, "x", 1),
    (2, PROSE, "y", 2),
    (3, None, "z", 3),
    (4, "", None, None),
    (5, "   \n\t \n", "a", 5),
    (6, LONG, "b", 6),
    (7, LONG + " end", "c", 7),
    (8, "a", "d", 8),
    (9, "\u00e9\u00c9 \U0001f600 caf\u00e9 \x1c \u2003 \u00a0x", "e", 9),
    (10, "same line here today\nsame line here today\nsame line here today\nother one now\n", "f", 10),
    (None, PROSE, "g", 11),
    (None, None, "h", 12),
    (11, "repeated row text of more than ten words that stands here twice in full", "i", 13),
    (11, "repeated row text of more than ten words that stands here twice in full", "i", 13),
]
#: The names of columns that operators add, in other letter case too.
SCHEMA = "doc_id bigint, text string, quality string, N_REMOVED int"


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given(name: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{SF_DIR}/{name}.parquet'").fetchall()
