"""User functions that SQL cells call: table functions over a TABLE argument.

Rows go to Python and back as Arrow batches. The functions are shipped as closures that
use nothing of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.pandas.types import to_arrow_schema


def register_row_function(
    spark: SparkSession, name: str, fn: Callable[[dict], dict | None], schema: str, batched: bool = False
) -> None:
    """Make ``fn`` the table function ``name`` of this session's SQL: a row in, a row of ``schema`` (DDL) out.

    In SQL it is called with a table, ``SELECT * FROM name(TABLE(orders))`` or ``name(TABLE(SELECT ...))``.
    ``fn`` gets the row as a dict and gives the result columns as a dict, or None for no row; with
    ``batched`` it gets an Arrow batch of rows and gives one. As in ``map_eval`` an error fails the
    query, and nothing is shuffled. A later function replaces one of the same name.
    """

    def step(_, rows):
        if batched:
            return fn(rows)
        return [out] if (out := fn(rows)) is not None else []

    register_group_function(spark, name, dict, step, schema, batched=batched)


def register_group_function(
    spark: SparkSession,
    name: str,
    start: Callable[[], object],
    step: Callable[[object, dict], Iterable[dict]],
    schema: str,
    finish: Callable[[object], Iterable[dict]] | None = None,
    batched: bool = False,
) -> None:
    """Make a function of whole groups the table function ``name`` of this session's SQL.

    ``SELECT * FROM name(TABLE(orders) PARTITION BY o_custkey ORDER BY o_orderkey)`` gives each group's
    rows, in order, to ``step(state, row)``; ``state`` is what ``start()`` gave for the group. ``step`` gives
    result rows as dicts, and ``finish(state)`` more of them after the last row. With ``batched``, ``step`` gets
    an Arrow batch of the group's next rows and gives one. Rows flow through: of a group, which may span
    any number of batches, only the state and one batch's results are held. A group is worked on in one
    task. Without PARTITION BY each task's rows are a group.
    """
    result_type = T.StructType.fromDDL(schema)
    results = to_arrow_schema(result_type)
    known = set(results.names)

    def as_table(rows):
        for row in rows:
            if row.keys() - known:
                raise KeyError(f"not in the result schema: {sorted(row.keys() - known)}")
        return pa.table([pa.array([row.get(f.name) for row in rows], f.type) for f in results], schema=results)

    class Function:
        def __init__(self):
            self.state = start()

        def eval(self, batch):
            if batched:
                out = step(self.state, batch)
                yield pa.table([out.column(f.name).cast(f.type) for f in results], schema=results)
            else:
                yield as_table([out for row in batch.to_pylist() for out in step(self.state, row) or ()])

        def terminate(self):
            if finish is not None:
                yield as_table(list(finish(self.state) or ()))

    spark.udtf.register(name, arrow_udtf(Function, returnType=result_type))
