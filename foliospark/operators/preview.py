"""The first rows of a frame, as text and as a markdown table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` rows with every value as text and NULL left NULL.

    Which rows come first is up to the frame: sort it if that matters. A column
    name that occurs again gets a number (``a``, ``a_2``), so no value is lost.
    """
    names = _distinct_names(df.columns)
    positions = [f"c{i}" for i in range(len(names))]
    texts = [F.col(p).cast("string").alias(name) for p, name in zip(positions, names)]
    # The limit comes last: only there it stops Spark from starting a task on
    # every partition of the frame when the preview is collected.
    return df.toDF(*positions).select(*texts).limit(n)


def render_markdown(df: DataFrame, n: int = 100) -> DataFrame:
    """The preview as a markdown table, one ``(line_no, line)`` row per line.

    The ``n`` rows are read right away, see ``preview``. NULL is an empty cell. A
    frame without columns gives no lines. ``line_no`` gives the order of the lines.
    """
    lines = markdown_lines(df, n)
    return df.sparkSession.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")


def markdown_lines(df: DataFrame, n: int = 100) -> list[str]:
    """The lines of the markdown table, read in one go: a line is made where its row is."""
    names = _distinct_names(df.columns)
    if not names:
        return []
    positions = [f"c{i}" for i in range(len(names))]
    cells = [F.coalesce(_escaped(F.col(p).cast("string")), F.lit("")) for p in positions]
    rows = df.toDF(*positions).select(_table_line(cells).alias("line")).limit(n).collect()
    header = "| " + " | ".join(_escaped_text(name) for name in names) + " |"
    return [header, "|" + "---|" * len(names), *[row["line"] for row in rows]]


def _distinct_names(columns: list[str]) -> list[str]:
    names: list[str] = []
    for column in columns:
        name, count = column, 1
        while name in names or (count > 1 and name in columns):
            count += 1
            name = f"{column}_{count}"
        names.append(name)
    return names


def _escaped(text: Column) -> Column:
    barless = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(barless, "\r\n|\r|\n", "<br>")


def _escaped_text(text: str) -> str:
    return re.sub("\r\n|\r|\n", "<br>", text.replace("|", "\\|"))


def _table_line(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
