"""User functions over rows and partitions, with a report per child.

The functions that run in the executors are closures that use nothing of this
package, so a cluster needs no copy of it on the executors.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.operators.overlay import _free_name
from foliospark.sources.tables import slot_source

# The word an index line starts with, and the forms a child report
# is linked in.
_INDEX_WORD = "Subreport:"
_LINK_SUFFIXES = {"markdown": ".md", "html": ".html", "pdf": ".pdf"}

RowFunction = Callable[[dict], dict]
BatchFunction = Callable[[pa.RecordBatch], pa.RecordBatch]
ReportingRowFunction = Callable[[list, dict], "dict | None"]
GroupFunction = Callable[[list, dict, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ReportingBatchFunction = Callable[[list, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _row_reader() -> Callable[[pa.RecordBatch], list[dict]]:
    """The function that reads a batch as dicts. It is made for every fan-out, so
    that it is shipped together with the user's function."""

    def values(column):
        number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
        if pa.types.is_string(column.type) or (number and column.null_count == 0):
            return column.to_numpy(zero_copy_only=False).tolist()  # the same, but faster
        return column.to_pylist()

    def rows(batch):
        if not batch.num_columns:
            return batch.to_pylist()
        names = batch.schema.names
        return [dict(zip(names, row)) for row in zip(*map(values, batch.columns))]

    return rows


def slot_count(spark: SparkSession) -> int:
    """How many partitions ``spread`` deals out to by default.

    One per core, or ``spark.sql.shuffle.partitions`` where that is more: this
    setting is what keeps a shuffle partition of a large table within an
    executor's memory.
    """
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )


def spread(df: DataFrame, n: int | None = None, cache: bool = False) -> DataFrame:
    """The rows dealt out evenly over ``n`` partitions.

    Dealing is round-robin, so no key, however frequent, makes one partition
    larger than the others. ``n`` defaults to ``slot_count``.

    ``cache=True`` keeps the result for reuse; call ``unpersist()`` when done.
    """
    spread_out = df.repartition(slot_count(df.sparkSession) if n is None else n)
    return spread_out.persist() if cache else spread_out


def spread_by_weight(df: DataFrame, weight: Column | str, n: int | None = None) -> DataFrame:
    """The rows dealt out over ``n`` partitions of the same weight.

    ``spread`` evens the number of rows; where some take a function much longer than others (long texts,
    large orders), give what they cost as ``weight``. No partition is heavier than 1.01 times the mean
    and one row. That one hundredth is shared by all rows alike, so that rows without a weight are
    dealt out as well; NULL, NaN, infinite and negative weights are none. Neighbours stay together.

    Two passes: the first, a job of its own, reads the weights and sums them by task, a number each; the second
    knows from these sums how much lies before each row, and sends it to its partition: one shuffle. Rows
    that come to tasks in another way in the second pass, as after a shuffle that adaptive execution plans anew, are all
    dealt out too, but less evenly.
    """
    n = slot_count(df.sparkSession) if n is None else n
    given = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    usable = F.when((given > 0) & (given < float("inf")), given).otherwise(0.0)
    schema = df.schema
    name, slot = _free_name("_weight", df.columns), _free_name("_slot", df.columns)
    weighed = df.withColumn(name, usable)

    def summed(batches):
        rows, total = 0, 0.0
        for batch in batches:
            rows += batch.num_rows
            total += float(np.sum(batch.column(0).to_numpy()))
        names = ["task", "rows", "total"]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([rows]), pa.array([total])], names=names)

    sums = weighed.select(name).mapInArrow(summed, "task bigint, rows bigint, total double")
    sums = sorted(map(tuple, sums.collect()))  # one row a task
    all_rows, total = sum(rows for _, rows, _ in sums), sum(weights for _, _, weights in sums)
    share = (0.01 * total or 1.0) / max(all_rows, 1)
    ends = list(itertools.accumulate((weights + share * rows for _, rows, weights in sums), initial=0.0))
    before, quota = {task: end for (task, _, _), end in zip(sums, ends)}, ends[-1] / n

    def dealt(batches):
        at = before.get(TaskContext.get().partitionId(), 0.0)
        for batch in batches:
            weights = batch.column(batch.num_columns - 1).to_numpy() + share
            passed = at + np.cumsum(weights)
            slots = np.clip((passed - weights / 2) // quota, 0, n - 1).astype(np.int32)
            if batch.num_rows:
                at = passed[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slots)], names=[*batch.schema.names[:-1], slot])

    if not all_rows:
        return spread(df, n)
    rows = weighed.mapInArrow(dealt, T.StructType([*schema.fields, T.StructField(slot, T.IntegerType())]))
    return rows.repartitionById(n, F.col(slot)).drop(slot)


def map_isolated(
    df: DataFrame,
    fn: ReportingRowFunction,
    key: str,
    schema: str,
    run_id: str,
    columns: list[str] | None = None,
    slots: int | None = None,
) -> DataFrame:
    """``fn(report, row)`` for every row, one child report per row.

    ``fn`` gets a list to append report lines to and the row as a dict, and gives
    the result columns of ``schema`` (DDL) as a dict, or None for all NULL. The
    result has one row per input row, whatever happens:
    ``(key, child_id, status, error, lines, <result columns>)``. Where ``fn``
    raises, or gives a value that does not fit ``schema``, ``status`` is "error",
    ``error`` says why, in full, the result columns are NULL and the neighbours are
    untouched. ``fn`` should have no side effects, as Spark may
    run a row again.

    ``child_id`` depends on ``run_id`` and the key only, so it is the same when
    a task is repeated; ``key`` should be unique and not NULL. ``columns`` names
    what ``fn`` reads; only these columns and the key are scanned.

    Rows stay where the scan put them. ``slots`` deals them out first (see
    ``spread``), which pays for a small input with a slow ``fn``.
    """
    result_type = T.StructType.fromDDL(schema)
    results = to_arrow_schema(result_type)
    known = set(result_type.names)
    rows_of = _row_reader()

    def run(batches):
        def text(value):
            try:
                return str(value).encode("utf-8", "replace").decode("utf-8")
            except Exception:
                return f"a {type(value).__name__} that has no text"

        def failed(error, report):
            return "error", f"{type(error).__name__}: {text(error)}", report, {}

        def attempt(row):
            report = []
            try:
                result = fn(report, row)
                if result is None:
                    result = {}
                unknown = result.keys() - known
                if unknown:
                    raise KeyError(f"not in the result schema: {sorted(unknown)}")
                return "ok", None, report, result
            except (Exception, SystemExit) as e:
                return failed(e, report)

        def reports(all_lines):
            try:
                return pa.array(all_lines, pa.list_(pa.string()))
            except Exception:  # not all of them are texts, or texts that can be encoded
                all_lines = [[text(line) for line in lines] for lines in all_lines]
                return pa.array(all_lines, pa.list_(pa.string()))

        def convert(outcomes):
            return [
                pa.array([o[3].get(f.name) for o in outcomes], type=f.type) for f in results
            ]

        def convert_alone(outcome):
            try:
                convert([outcome])
                return outcome
            except Exception as e:
                return failed(e, outcome[2])

        for batch in batches:
            outcomes = [attempt(row) for row in rows_of(batch)]
            try:
                columns_out = convert(outcomes)
            except Exception:
                outcomes = [convert_alone(o) for o in outcomes]
                columns_out = convert(outcomes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([o[0] for o in outcomes], pa.string()),
                    pa.array([o[1] for o in outcomes], pa.string()),
                    reports([o[2] for o in outcomes]),
                    *columns_out,
                ],
                names=["key", "status", "error", "lines", *results.names],
            )

    if known & {"key", "child_id", "status", "error", "lines"}:
        raise ValueError("key, child_id, status, error and lines are taken in the result")
    source = df if columns is None else df.select(*dict.fromkeys([key, *columns]))
    if slots is not None:
        source = spread(source, slots)
    out_type = T.StructType(
        [
            T.StructField("key", source.schema[key].dataType),
            T.StructField("status", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("lines", T.ArrayType(T.StringType())),
            *result_type.fields,
        ]
    )
    mapped = source.mapInArrow(run, out_type)
    key_text = F.coalesce(F.col("key").cast("string"), F.lit(""))
    child_id = F.md5(F.concat(F.lit(f"{run_id}:"), key_text))
    return mapped.select(
        "key", child_id.alias("child_id"), "status", "error", "lines", *result_type.names
    )


def distribute(
    spark: SparkSession,
    fn: ReportingRowFunction,
    n: int | None = None,
    schema: str = "result string",
    run_id: str = "run",
) -> DataFrame:
    """``map_isolated`` over one row per task slot; the row is ``{"id": slot}``."""
    return map_isolated(slot_source(spark, n), fn, "id", schema, run_id)


def map_eval(
    df: DataFrame,
    fn: RowFunction | BatchFunction | Column | list[Column],
    schema: str | None = None,
    columns: list[str] | None = None,
    batched: bool = False,
) -> DataFrame:
    """The results of ``fn`` for every row; an error fails the query.

    A Column or a list of Columns is evaluated as such, without Python. A function
    gets the row as a dict and gives the columns of ``schema`` (DDL) as a dict;
    ``columns`` names what it reads, and only that is scanned. With ``batched`` the
    function gets an Arrow batch of rows and gives one with the columns of ``schema``;
    for whatever Arrow or numpy can do with whole columns that is much faster.
    """
    if not callable(fn) or isinstance(fn, Column):
        return df.select(fn if isinstance(fn, Column) else list(fn))
    if schema is None:
        raise ValueError("a Python function needs the schema of its results")
    result_type = T.StructType.fromDDL(schema)
    results = to_arrow_schema(result_type)
    known = set(result_type.names)
    rows_of = _row_reader()

    def run(batches):
        def evaluate(row):
            result = fn(row)
            if result.keys() - known:
                raise KeyError(f"not in the result schema: {sorted(result.keys() - known)}")
            return result

        for batch in batches:
            if batched:
                out = fn(batch)
                by_name = [out.column(f.name).cast(f.type) for f in results]
                yield pa.RecordBatch.from_arrays(by_name, schema=results)
                continue
            rows = [evaluate(row) for row in rows_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.get(f.name) for r in rows], type=f.type) for f in results],
                schema=results,
            )

    source = df if columns is None else df.select(*columns)
    return source.mapInArrow(run, result_type)


def distribute_eval(
    spark: SparkSession,
    fn: RowFunction | Column | list[Column],
    n: int | None = None,
    schema: str | None = None,
) -> DataFrame:
    """``map_eval`` over one row per task slot; the column is ``id``."""
    return map_eval(slot_source(spark, n), fn, schema)


def map_partitions_tagged(
    df: DataFrame,
    fn: ReportingBatchFunction,
    schema: str,
    run_id: str,
    columns: list[str] | None = None,
    slots: int | None = None,
) -> DataFrame:
    """``fn(report, batches)`` for every partition, one child report per partition.

    ``fn`` gets a list to append report lines to and an iterator of Arrow batches,
    and gives an iterator of batches with the columns of ``schema`` (DDL). Batches
    flow through one at a time; neither a partition nor its report is ever held as a
    whole. The result adds ``child_id``, the same on every row of a partition, and the
    child's report in parts: the lines added since the part before are ``lines`` on the
    last row of a batch, with the number of the part (from 0) as ``part``; the list
    is empty again then. The partition's last row always has a part. A partition without
    output rows leaves no report. An error fails the query.

    ``columns`` and ``slots`` are as in ``map_isolated``. Which rows share a
    partition is up to Spark, so results must not depend on it.
    """
    result_type = T.StructType.fromDDL(schema)
    results = to_arrow_schema(result_type)

    tag = _tagger(results)

    def run(batches):
        partition = TaskContext.get().partitionId()
        child = hashlib.md5(f"{run_id}:{partition}".encode()).hexdigest()
        report = []
        yield from tag(fn(report, batches), child, report)

    source = df if columns is None else df.select(*columns)
    if slots is not None:
        source = spread(source, slots)
    return source.mapInArrow(run, _tagged_type(result_type))


def map_groups_tagged(
    df: DataFrame,
    by: list[str],
    fn: GroupFunction,
    schema: str,
    run_id: str,
    order: list[str | Column] | None = None,
    columns: list[str] | None = None,
    pieces: int = 1,
) -> DataFrame:
    """``fn(report, key, batches)`` for every group of rows with equal ``by`` columns, one child report per group.

    ``key`` is a dict of the group's ``by`` values; NULLs are equal, and so are NaNs. ``batches`` is an
    iterator of Arrow batches with the group's rows (their ``by`` columns too), sorted by ``order``. A group may
    span any number of batches: it flows through, and neither it nor its report is ever held as a
    whole. ``fn`` need not read it to the end. Results and reports are as in :func:`map_partitions_tagged`,
    with a ``child_id`` per group, the md5 of ``run_id:`` and the key as JSON, so it does not depend on
    where a group is worked on. A group without output rows leaves no report.

    Rows are placed by a hash of the key and sorted within each partition: one shuffle. All rows of a
    key are one stream in one task. For functions whose results can be combined, ``pieces`` deals the rows of
    each key out over so many groups by a hash of the row, each with its number as ``piece`` in
    ``key`` (and in the JSON of its ``child_id``); a hot key is then worked on in as many tasks.

    ``columns`` names what ``fn`` reads besides ``by`` and ``order``; only these are scanned.
    """
    result_type = T.StructType.fromDDL(schema)
    results = to_arrow_schema(result_type)
    tag = _tagger(results)
    if pieces > 1 and "piece" in df.columns:
        raise ValueError("piece is taken in the key")
    names = {c for c in order or [] if isinstance(c, str)}
    source = df if columns is None else df.select(*dict.fromkeys([*by, *columns, *sorted(names)]))
    shown = source.columns
    if pieces > 1:
        piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in shown]), F.lit(pieces)).cast("int")
        source, by = source.withColumn("piece", piece), [*by, "piece"]
    child = "child_id"
    while child in source.columns:
        child += "_"
    key_json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in by]), {"ignoreNullFields": "false"})
    source = source.withColumn(child, F.md5(F.concat(F.lit(f"{run_id}:"), key_json)))
    placed = source.repartition(child).sortWithinPartitions(child, *(order or []))

    def run(batches):
        def stretches():
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(child)
                changes = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False).nonzero()[0]
                starts = [0, *(changes + 1).tolist()]
                for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                    yield ids[start].as_py(), batch.slice(start, stop - start)

        for child_id, group in itertools.groupby(stretches(), key=lambda x: x[0]):
            first = next(group)[1]
            key = first.slice(0, 1).select(by).to_pylist()[0]
            rows = (batch.select(shown) for batch in itertools.chain([first], (b for _, b in group)))
            report = []
            yield from tag(fn(report, key, rows), child_id, report)

    return placed.mapInArrow(run, _tagged_type(result_type))


def _tagger(results: pa.Schema) -> Callable:
    """The function that gives a stream of batches its child id and report. It is made for every
    fan-out, so that it is shipped together with the user's function."""

    def tag(stream, child, report):
        sent = 0

        def tagged(batch, last):
            nonlocal sent
            lines = pa.nulls(batch.num_rows, pa.list_(pa.string()))
            parts = pa.nulls(batch.num_rows, pa.int32())
            if last or report:
                own = pa.array([[str(line) for line in report]], pa.list_(pa.string()))
                lines = pa.concat_arrays([lines[1:], own])
                parts = pa.concat_arrays([parts[1:], pa.array([sent], pa.int32())])
                report.clear()
                sent += 1
            by_name = [batch.column(f.name).cast(f.type) for f in results]
            return pa.RecordBatch.from_arrays(
                [*by_name, pa.repeat(child, batch.num_rows), parts, lines],
                names=[*results.names, "child_id", "part", "lines"],
            )

        held = None
        for batch in stream:
            if batch.num_rows == 0:
                continue
            if held is not None:
                yield tagged(held, last=False)
            held = batch
        if held is not None:
            yield tagged(held, last=True)

    return tag


def _tagged_type(result_type: T.StructType) -> T.StructType:
    if set(result_type.names) & {"child_id", "part", "lines"}:
        raise ValueError("child_id, part and lines are taken in the result")
    return T.StructType(
        [
            *result_type.fields,
            T.StructField("child_id", T.StringType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("lines", T.ArrayType(T.StringType())),
        ]
    )


def report_index(df: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per child report in ``df`` with its index line and links.

    ``distinct=False`` saves the shuffle where every row is a child of its own,
    as in the result of ``map_isolated``.
    """
    children = df.select("child_id")
    if distinct:
        children = children.distinct()
    links = {
        kind: F.concat("child_id", F.lit(suffix)) for kind, suffix in _LINK_SUFFIXES.items()
    }
    linked = [F.concat(F.lit(f"[{kind}]("), link, F.lit(")")) for kind, link in links.items()]
    line = F.concat_ws(" ", F.lit(_INDEX_WORD), "child_id", *linked)
    return children.select(
        "child_id", *[link.alias(kind) for kind, link in links.items()], line.alias("line")
    )
