import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions import (
    doubles_to_json,
    ints_to_json,
    json_to_doubles,
    json_to_ints,
    parse_json,
    to_json_rooted,
    to_json_sorted,
)


def one(spark, sql, column):
    return spark.sql(sql).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text, doubles, ints",
    [
        ('[1, 2.5, "3"]', [1.0, 2.5, 3.0], [1, 2, 3]),
        (None, None, None),
        ("[1,null]", [1.0, None], [1, None]),
        ("[]", [], []),
        ('{"a":1}', None, None),
        ("not json", None, None),
        ("[3.7,99999999999]", [3.7, 99999999999.0], [3, None]),
        ("[-3.7, 1e3, 2147483647, -2147483648]", [-3.7, 1000.0, 2147483647.0, -2147483648.0],
         [-3, 1000, 2147483647, -2147483648]),
        ('["x", true]', [None, None], [None, None]),
        ("[2147483647.9, -2147483648.9]", [2147483647.9, -2147483648.9], [2147483647, -2147483648]),
        ("[1e400, 1]", [float("inf"), 1.0], [None, 1]),
        ('["1.5", "x", 2, null, {"a": 1}]', [1.5, None, 2.0, None, None], [1, None, 2, None, None]),
        ("[[1], 2]", [None, 2.0], [None, 2]),
        ("", None, None),
        ("[2147483648, -2147483649]", [2147483648.0, -2147483649.0], [None, None]),
    ],
)
def test_numbers_from_json(spark, text, doubles, ints):
    row = spark.createDataFrame([(text,)], "j string").select(
        json_to_doubles("j").alias("d"), json_to_ints(F.col("j")).alias("i")
    ).first()
    assert (row["d"], row["i"]) == (doubles, ints)


def test_floats_survive_the_round_trip(spark):
    df = spark.sql("SELECT array(CAST(0.1 AS FLOAT), CAST(1e-30 AS FLOAT), NULL) AS a")
    row = df.select(
        json_to_doubles(doubles_to_json("a")).alias("back"),
        F.col("a").cast("array<double>").alias("a"),
    ).first()
    assert row["back"] == row["a"]


def test_ints_to_json(spark):
    assert one(spark, "SELECT array(3, NULL, -1) AS a", ints_to_json("a")) == "[3,null,-1]"
    assert one(spark, "SELECT CAST(NULL AS ARRAY<INT>) AS a", ints_to_json("a")) is None


def test_parse_json(spark):
    schema = "a int, b array<string>"
    good = one(spark, """SELECT '{"a": 1, "b": ["x"]}' AS j""", parse_json("j", schema))
    assert good.asDict() == {"a": 1, "b": ["x"]}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        one(spark, """SELECT '{"a": 1' AS j""", parse_json("j", schema))
    lenient = one(spark, """SELECT '{"a": 1' AS j""", parse_json("j", schema, "PERMISSIVE"))
    assert lenient["b"] is None


def test_sorted_map_keeps_nulls(spark):
    text = one(spark, "SELECT map('b', NULL, 'a', 'x') AS m", to_json_sorted("m"))
    assert text == '{\n  "a" : "x",\n  "b" : null\n}'


def test_sorted_map_with_number_keys(spark):
    text = one(spark, "SELECT map(10, 'x', 9, 'y') AS m", to_json_sorted("m", pretty=False))
    assert text == '{"9":"y","10":"x"}'


def test_maps_inside_are_sorted_too(spark):
    sql = """
        SELECT named_struct(
            'z', CAST(NULL AS INT),
            'm', map('q', map('y', 2, 'x', 1), 'p', CAST(NULL AS MAP<STRING, INT>)),
            'l', array(map('d', 4, 'c', 3))) AS v
    """
    schema = "z int, m map<string, map<string, int>>, l array<map<string, int>>"
    text = one(spark, sql, to_json_sorted("v", schema, pretty=False))
    assert text == '{"z":null,"m":{"p":null,"q":{"x":1,"y":2}},"l":[{"c":3,"d":4}]}'
    rooted = one(spark, sql, to_json_rooted("v", "row", schema))
    assert json.loads(rooted) == {"row": json.loads(text)}
    assert rooted.startswith('{\n  "row" : {\n    "z" : null,')


def test_null_gives_null(spark):
    sql = "SELECT CAST(NULL AS MAP<STRING, STRING>) AS m"
    assert one(spark, sql, to_json_sorted("m")) is None
    assert one(spark, sql, to_json_rooted("m", "row", "map<string,int>", pretty=False)) == '{"row":null}'
