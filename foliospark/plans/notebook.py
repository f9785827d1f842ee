"""Notebooks: cells that run one after the other into one report."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from foliospark.operators.preview import markdown_lines
from foliospark.plans.script import Cell, cell_statements
from foliospark.shared_storage import write_text
from foliospark.sinks import register_view
from foliospark.sources import guid_source

# The view every notebook starts with, the word in the message of an
# error that ends it, and what a cell's name starts with.
_SAMPLE_VIEW = "guids"
_STOP_WORD = "shutdown"
_CELL_NAME = "Cmd"

#: The columns of a report.
NOTEBOOK_REPORT = (
    "cell int, name string, statement string, status string, error string, lines array<string>"
)

_COLUMNS = ("cell", "name", "statement", "status", "error", "lines")


def run_notebook(
    spark: SparkSession, cells: list[Cell], n: int = 100, archive: str | None = None
) -> DataFrame:
    """Run the cells and return the report, one row per statement that started.

    ``lines`` is the preview of the statement's result as a markdown table of at
    most ``n`` rows; only those rows come to the driver, and they are shown before
    the next statement starts. What a function returns that is no frame is shown as its
    text. The first failure ends its cell with ``status`` "error" and the notebook goes
    on with the next cell; an error whose own message speaks of "shutdown" ends the
    notebook with that status.

    With ``archive`` the rows of a cell are added to that folder as a file of JSON lines
    (:data:`NOTEBOOK_REPORT` is their schema) when the cell ends, also when it failed, so they
    outlast a driver that dies in a later cell. No job is run for that.

    The view ``guids`` (see ``guid_source``) is there from the start.
    """
    register_view(guid_source(spark), _SAMPLE_VIEW)
    report: list[tuple] = []
    for number, cell in enumerate(cells, start=1):
        begun = len(report)
        try:
            stopped = _run_cell(spark, number, cell, n, report)
        finally:
            if archive is not None and len(report) > begun:
                lines = [json.dumps(dict(zip(_COLUMNS, row))) + "\n" for row in report[begun:]]
                name = f"cell-{number:05}-{uuid.uuid4().hex}.json"
                write_text(spark, archive, name, "".join(lines))
        if stopped:
            break
    return spark.createDataFrame(report, NOTEBOOK_REPORT)


def _run_cell(spark: SparkSession, number: int, cell: Cell, n: int, report: list[tuple]) -> bool:
    """Run one cell and add its rows to the report; true if it ends the notebook."""
    for statement, run in cell_statements(spark, cell):
        try:
            result = run()
            lines = _shown(result, n)
        except Exception as e:
            stopped = _STOP_WORD in _message(e)
            status = "shutdown" if stopped else "error"
            report.append((number, f"{_CELL_NAME}{number}", statement, status, str(e), []))
            return stopped
        report.append((number, f"{_CELL_NAME}{number}", statement, "ok", None, lines))
    return False


def _shown(result: object, n: int) -> list[str]:
    if result is None:
        return []
    if isinstance(result, DataFrame):
        return markdown_lines(result, n)
    return str(result).splitlines()


def _message(error: Exception) -> str:
    """An error's own message. One from a Python worker brings along its traceback, with the
    names and lines of the user's code; there the message is the last line."""
    text = str(error).strip()
    return text.splitlines()[-1] if "Traceback (most recent call last)" in text else text
