"""SQL scripts of several statements, and cells."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, Row, SparkSession

from foliospark.operators.preview import preview

# The statement separator, the letters that count as blank around a
# statement (the space and all below it), and the first line of a SQL cell.
_SEPARATOR = r"(?<!\\);"
_BLANK = "".join(map(chr, range(33)))
_SQL_CELL = "%sql"

Cell = str | Callable[[SparkSession], object]
Statement = tuple[str, Callable[[], object]]


@dataclass
class Result:
    """What a statement gave: ``frame``, whole and lazy, or whatever else a function returned.

    ``shown`` is what the statement's result was before the next one started: the rows of
    its :func:`preview`, or the text of what is no frame. Of the last statement it is read
    when it is first asked for.
    """

    statement: str
    frame: object
    n: int

    @cached_property
    def shown(self) -> list[Row] | str:
        if self.frame is None:
            return []
        if not isinstance(self.frame, DataFrame):
            return str(self.frame)
        return preview(self.frame, self.n).collect() if self.frame.columns else []


def split_statements(text: str) -> list[str]:
    r"""The statements of a script: its pieces between semicolons, none of them empty.

    ``\;`` does not separate; the backslash stays, and Spark reads ``\;`` in a text
    literal as ``;``. Quotes and comments are not looked at, so a bare semicolon
    inside them separates too.
    """
    pieces = [piece.strip(_BLANK) for piece in re.split(_SEPARATOR, text)]
    return [piece for piece in pieces if piece]


def run_sql_script(
    spark: SparkSession,
    text: str,
    args: dict | None = None,
    each: Callable[[Result], None] | None = None,
    n: int = 100,
) -> list[Result]:
    """Run the statements in order and return one result each.

    Commands take effect at once. Of a query the first ``n`` rows are read before the next
    statement starts (see :class:`Result`), so they do not show what later statements
    write; its frame stays lazy and whole. ``each(result)`` is called before the next
    statement starts. The first failure ends the script; what earlier statements did
    remains.
    """
    return _run_all(_sql_statements(spark, text, args), n, each)


def run_script_with_params(
    spark: SparkSession,
    text: str,
    defaults: dict,
    overrides: dict | None = None,
    each: Callable[[Result], None] | None = None,
    n: int = 100,
) -> list[Result]:
    """Run a script with named parameters (``:name``).

    ``defaults`` are the script's own values; ``overrides`` replaces some of them
    and may not name others. Values are bound, not pasted into the text.
    """
    unknown = (overrides or {}).keys() - defaults.keys()
    if unknown:
        raise ValueError(f"the script has no parameters {sorted(unknown)}")
    return run_sql_script(spark, text, {**defaults, **(overrides or {})}, each, n)


def run_cell(
    spark: SparkSession,
    cell: Cell,
    each: Callable[[Result], None] | None = None,
    n: int = 100,
) -> list[Result]:
    """Run a cell: text whose first line is ``%sql``, or a function of the session.

    A SQL cell gives one result per statement, shown in order as in
    :func:`run_sql_script`; a function gives its own result, which need not be a frame.
    """
    return _run_all(cell_statements(spark, cell), n, each)


def cell_statements(spark: SparkSession, cell: Cell) -> Iterator[Statement]:
    """The statements of a cell, each with the function that runs it."""
    if callable(cell):
        return iter([(getattr(cell, "__name__", "cell"), lambda: cell(spark))])
    first, _, script = cell.partition("\n")
    if first.strip(_BLANK) != _SQL_CELL:
        return iter([(cell, _refuse_text)])
    return _sql_statements(spark, script)


def _sql_statements(
    spark: SparkSession, text: str, args: dict | None = None
) -> Iterator[Statement]:
    for statement in split_statements(text):
        yield statement, partial(spark.sql, statement, args=args)


def _run_all(
    statements: Iterator[Statement], n: int, each: Callable[[Result], None] | None = None
) -> list[Result]:
    results: list[Result] = []
    for statement, run in statements:
        if results:
            _ = results[-1].shown  # read before the next statement starts
        results.append(Result(statement, run(), n))
        if each is not None:
            each(results[-1])
    return results


def _refuse_text() -> DataFrame:
    raise ValueError("a text cell starts with a %sql line; other code is a function")
