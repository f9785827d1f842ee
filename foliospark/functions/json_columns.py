"""JSON text to and from typed columns.

All functions take and return Columns and hold no Python code at run time, so
they stay inside the JVM, next to the scan, and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def json_to_doubles(col: Column | str) -> Column:
    """JSON array text as ``array<double>``.

    Quoted numbers are accepted. An element that is no number, and a JSON null,
    give NULL for that element; text that is no JSON array gives NULL.
    """
    # Reading numbers as such takes half the time, but gives NULL for the whole
    # array if one element is none. Only then the elements are read as texts.
    numbers = F.from_json(_column(col), "array<double>")
    texts = F.from_json(_column(col), "array<string>")
    return F.coalesce(numbers, texts.try_cast("array<double>"))


def json_to_ints(col: Column | str) -> Column:
    """JSON array text as ``array<int>``; fractions are cut off toward zero.

    A number outside the 32-bit range gives NULL for that element.
    """

    # Asked first, as every failed cast costs an exception.
    def cut(x: Column) -> Column:
        return F.when((x > -(2**31) - 1) & (x < 2**31), x.cast("int"))

    return F.transform(json_to_doubles(col), cut)


def doubles_to_json(col: Column | str) -> Column:
    """Numeric array as JSON text, written so that reading gives the same doubles.

    ``array<float>`` is widened first: the short float form would not read back
    to the same double.
    """
    return F.to_json(_column(col).cast("array<double>"))


def ints_to_json(col: Column | str) -> Column:
    """Integer array as JSON text."""
    return F.to_json(_column(col).cast("array<int>"))


def parse_json(col: Column | str, schema: T.DataType | str, mode: str = "FAILFAST") -> Column:
    """JSON text as a value of ``schema``; malformed text fails the query.

    ``mode="PERMISSIVE"`` gives NULLs for malformed text instead.
    """
    return F.from_json(_column(col), schema, {"mode": mode})


def parse_json_checked(col: Column | str, schema: T.StructType | str) -> Column:
    """JSON text as ``struct<value, rejected: struct<text, reason>>``, parsed once.

    Where the text is an object that fits ``schema``, ``value`` is that and ``rejected`` is NULL. Where it is
    not, ``value`` is NULL and ``rejected`` has the text as it was and why: "no JSON", "no object", or
    "does not fit the schema" (a value of another type, or a missing one in a field that is NOT NULL).
    NULL gives NULL for both.
    """
    struct_type = _data_type(schema)
    if not isinstance(struct_type, T.StructType):
        raise ValueError("rejected texts are told apart for objects, so the schema is a struct")
    raw = "_rejected"
    while raw in struct_type.names:
        raw += "_"
    text = _column(col).cast("string")
    wide = T.StructType([*struct_type.fields, T.StructField(raw, T.StringType())])
    parsed = F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw})
    shape = F.schema_of_variant(F.try_parse_json(text))
    fields = [f.name for f in struct_type.fields]

    def checked(p: Column) -> Column:
        missing = [p[f.name].isNull() for f in struct_type.fields if not f.nullable]
        bad = F.coalesce(p[raw].isNotNull(), F.lit(True))
        for lacking in missing:
            bad = bad | lacking
        bad = text.isNotNull() & (bad | ~F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False)))
        reason = (
            F.when(shape.isNull(), "no JSON")
            .when(~F.startswith(shape, F.lit("OBJECT")), "no object")
            .otherwise("does not fit the schema")
        )
        value = F.when(text.isNotNull() & ~bad, F.struct(*[p[n].alias(n) for n in fields]))
        rejected = F.when(bad, F.struct(text.alias("text"), reason.alias("reason")))
        return F.struct(value.alias("value"), rejected.alias("rejected"))

    # as the one element of an array the parsed text is a variable, made once
    return F.get(F.transform(F.array(parsed), checked), F.lit(0))


def parse_variant(col: Column | str) -> Column:
    """JSON text whose shape changes from row to row as a VARIANT; NULL for what is no JSON."""
    return F.try_parse_json(_column(col).cast("string"))


def variant_field(col: Column | str, path: str, kind: str) -> Column:
    """The value at ``path`` (``$.a[0].b``) of a VARIANT as ``kind``; NULL where there is none or it does not fit."""
    return F.try_variant_get(_column(col), path, kind)


def to_json_sorted(
    col: Column | str, schema: T.DataType | str | None = None, pretty: bool = True
) -> Column:
    """Value as JSON text with map entries in key order and nulls kept.

    Without ``schema`` the column must be a map of plain values. With the
    column's ``schema`` (type object or DDL) it may be any nesting of structs,
    arrays and maps, and the maps inside are put in key order too.
    """
    value = _column(col)
    if schema is None:
        value = _sort_entries(value)
    else:
        value = _sort_maps(value, _data_type(schema))
    return F.to_json(value, _json_options(pretty))


def to_json_rooted(
    col: Column | str,
    root: str,
    schema: T.DataType | str,
    pretty: bool = True,
) -> Column:
    """As :func:`to_json_sorted`, with the value wrapped as ``{root: value}``.

    ``schema`` is the column's type, so that maps at any depth are put in key order.
    """
    value = _sort_maps(_column(col), _data_type(schema))
    return F.to_json(F.struct(value.alias(root)), _json_options(pretty))


def _json_options(pretty: bool) -> dict[str, str]:
    return {"ignoreNullFields": "false", "pretty": str(pretty).lower()}


def _data_type(schema: T.DataType | str) -> T.DataType:
    return T.DataType.fromDDL(schema) if isinstance(schema, str) else schema


def _by_key(left: Column, right: Column) -> Column:
    return F.when(left["key"] < right["key"], -1).when(left["key"] > right["key"], 1).otherwise(0)


def _sort_entries(entries_map: Column, orderable: bool = True) -> Column:
    entries = F.map_entries(entries_map)
    # Keys are unique, so ordering whole entries orders by key; only entries
    # whose values have no order (maps) need the slower comparator.
    ordered = F.sort_array(entries) if orderable else F.array_sort(entries, _by_key)
    return F.map_from_entries(ordered)


def _holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return _holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_holds_map(f.dataType) for f in data_type.fields)
    return False


def _sort_maps(value: Column, data_type: T.DataType) -> Column:
    if not _holds_map(data_type):
        return value
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: _sort_maps(x, data_type.elementType))
    if isinstance(data_type, T.StructType):
        fields = [_sort_maps(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    inner = value
    if _holds_map(data_type.valueType):
        inner = F.transform_values(value, lambda k, v: _sort_maps(v, data_type.valueType))
    return _sort_entries(inner, orderable=not _holds_map(data_type.valueType))
