"""JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import (
    doubles_to_json,
    ints_to_json,
    json_to_doubles,
    json_to_ints,
    parse_json,
    parse_json_checked,
    parse_variant,
    to_json_rooted,
    to_json_sorted,
    variant_field,
)
from foliospark.queries.inputs import table


def json_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector to JSON text and back, exactly."""
    text = table(spark, sf_dir, "embeddings").select(
        "vec_id", doubles_to_json("embedding").alias("json")
    )
    return text.select("vec_id", F.posexplode(json_to_doubles("json")).alias("pos", "x"))


def json_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of every line item to JSON text and back."""
    numbers = F.array("l_linenumber", F.col("l_quantity").cast("int"), F.month("l_shipdate"))
    text = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", ints_to_json(numbers).alias("json")
    )
    # Kept as a column of its own, so that the text is parsed once.
    parsed = text.withColumn("numbers", json_to_ints("json"))
    names = ["line_number", "quantity", "month"]
    parts = [F.get("numbers", F.lit(i)).alias(name) for i, name in enumerate(names)]
    return parsed.select("l_orderkey", "l_partkey", "l_suppkey", "json", *parts)


def json_ints_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers read from JSON texts of decimal, quoted, missing and too large numbers."""
    text = F.concat(
        F.lit("["), "value", F.lit(', "'), "user_id", F.lit('", null, '),
        F.lit(3_000_000_000) + F.col("event_id"), F.lit("]"),
    )
    return (
        table(spark, sf_dir, "events")
        .select("event_id", text.alias("json"))
        .select("event_id", F.posexplode(json_to_ints("json")).alias("pos", "x"))
    )


def parse_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = parse_json("props", "k int").alias("props")
    return table(spark, sf_dir, "events").select("event_id", props).select("event_id", "props.k")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with some texts cut off, of another shape, or with a value of another type."""
    text = (
        F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4))
        .when(F.col("event_id") % 13 == 0, F.concat(F.lit("["), "props", F.lit("]")))
        .when(F.col("event_id") % 17 == 0, F.regexp_replace("props", r"(\d+)", '"n$1"'))
        .when(F.col("event_id") % 19 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


def json_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of whole texts, and what was rejected with the reason, in one pass."""
    checked = parse_json_checked("text", "k int").alias("p")
    return _damaged(spark, sf_dir).select("event_id", checked).select(
        "event_id", F.col("p.value.k").alias("k"), F.col("p.rejected.text").alias("text"), F.col("p.rejected.reason").alias("reason")
    )


def json_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of texts of several shapes."""
    parsed = _damaged(spark, sf_dir).select("event_id", parse_variant("text").alias("v"))
    fields = {"number": ("$.k", "int"), "text": ("$.k", "string"), "inside": ("$[0].k", "bigint")}
    return parsed.select("event_id", *[variant_field("v", *at).alias(name) for name, at in fields.items()])


def json_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a map whose entries were given out of order."""
    entries = F.create_map(
        F.lit("user"), F.col("user_id").cast("string"),
        F.lit("props"), F.col("props"),
        F.lit("lost"), F.lit(None).cast("string"),
        F.lit("event"), F.col("event_type"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        to_json_sorted(entries, pretty=False).alias("json"),
        to_json_sorted(entries).alias("pretty_json"),
    )


def json_sorted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and type; a user's map has one entry per type."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    per_user = counts.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("counts")
    )
    return per_user.select("user_id", to_json_sorted("counts", pretty=False).alias("json"))


def json_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    schema = "c_custkey bigint, c_name string, seg string"
    # keys out of order, to be put in order
    numbers = F.create_map(F.lit("z"), "c_custkey", F.lit("a"), F.col("c_nationkey").cast("bigint"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        to_json_rooted(row, "row", schema, pretty=False).alias("json"),
        to_json_rooted(row, "row", schema).alias("pretty_json"),
        to_json_rooted(numbers, "row", "map<string,bigint>", pretty=False).alias("map_json"),
    )


def json_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn, whole text included, to JSON text and back."""
    turn = F.struct("conv_id", "turn", "role", "text")
    turn_type = "struct<conv_id: bigint, turn: bigint, role: string, text: string>"
    written = table(spark, sf_dir, "conversations").select(
        to_json_rooted(turn, "row", turn_type, pretty=False).alias("json")
    )
    schema = f"row {turn_type}"
    return written.select("json", parse_json("json", schema).alias("read")).select(
        "json", "read.row.*"
    )


QUERIES = {
    "json_checked": json_checked,
    "json_variants": json_variants,
    "json_doubles": json_doubles,
    "json_ints": json_ints,
    "json_ints_truncated": json_ints_truncated,
    "parse_json": parse_json_query,
    "json_sorted": json_sorted,
    "json_sorted_counts": json_sorted_counts,
    "json_rooted": json_rooted,
    "json_turns": json_turns,
}

ORACLES = {
    "json_checked": """
        SELECT event_id,
               CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0
                    THEN CAST(n AS INTEGER) END AS k,
               CASE WHEN event_id % 11 = 0 THEN left(props, 4) WHEN event_id % 13 = 0 THEN '[' || props || ']'
                    WHEN event_id % 17 = 0 THEN replace(props, n, '"n' || n || '"') END AS text,
               CASE WHEN event_id % 11 = 0 THEN 'no JSON' WHEN event_id % 13 = 0 THEN 'no object'
                    WHEN event_id % 17 = 0 THEN 'does not fit the schema' END AS reason
        FROM (SELECT *, regexp_extract(props, '[0-9]+') AS n FROM events)
    """,
    "json_variants": """
        WITH kinds AS (
            SELECT event_id, regexp_extract(props, '[0-9]+') AS n,
                   CASE WHEN event_id % 11 = 0 THEN 'cut' WHEN event_id % 13 = 0 THEN 'list' WHEN event_id % 17 = 0 THEN 'text'
                        WHEN event_id % 19 = 0 THEN 'null' ELSE 'plain' END AS kind
            FROM events
        )
        SELECT event_id, CASE WHEN kind = 'plain' THEN CAST(n AS INTEGER) END AS number,
               CASE WHEN kind = 'plain' THEN n WHEN kind = 'text' THEN 'n' || n END AS text,
               CASE WHEN kind = 'list' THEN CAST(n AS BIGINT) END AS inside
        FROM kinds
    """,
    "json_doubles": """
        SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
               unnest(CAST(embedding AS DOUBLE[])) AS x
        FROM embeddings
    """,
    "json_ints": """
        SELECT l_orderkey, l_partkey, l_suppkey,
               '[' || l_linenumber || ',' || CAST(trunc(l_quantity) AS INTEGER) || ','
                   || month(l_shipdate) || ']' AS json,
               l_linenumber AS line_number, CAST(trunc(l_quantity) AS INTEGER) AS quantity,
               CAST(month(l_shipdate) AS INTEGER) AS month
        FROM lineitem
    """,
    "json_ints_truncated": """
        SELECT event_id, CAST(pos AS INTEGER) AS pos,
               CASE pos WHEN 0 THEN CAST(trunc(value) AS INTEGER)
                        WHEN 1 THEN CAST(user_id AS INTEGER) END AS x
        FROM events, (SELECT range AS pos FROM range(4))
    """,
    "parse_json": "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events",
    "json_sorted": r"""
        WITH texts AS (
            SELECT *, '"' || replace(replace(props, '\', '\\'), '"', '\"') || '"' AS quoted
            FROM events
        )
        SELECT event_id,
               '{"event":"' || event_type || '","lost":null,"props":' || quoted
                   || ',"user":"' || user_id || '"}' AS json,
               '{' || chr(10) || '  "event" : "' || event_type || '",' || chr(10)
                   || '  "lost" : null,' || chr(10) || '  "props" : ' || quoted || ',' || chr(10)
                   || '  "user" : "' || user_id || '"' || chr(10) || '}' AS pretty_json
        FROM texts
    """,
    "json_sorted_counts": """
        SELECT user_id,
               '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}'
                   AS json
        FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
        GROUP BY user_id
    """,
    "json_rooted": """
        WITH texts AS (
            SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'null'
                           ELSE '"' || c_mktsegment || '"' END AS seg
            FROM customer
        )
        SELECT c_custkey,
               '{"row":{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","seg":' || seg
                   || '}}' AS json,
               '{' || chr(10) || '  "row" : {' || chr(10) || '    "c_custkey" : ' || c_custkey
                   || ',' || chr(10) || '    "c_name" : "' || c_name || '",' || chr(10)
                   || '    "seg" : ' || seg || chr(10) || '  }' || chr(10) || '}' AS pretty_json,
               '{"row":{"a":' || c_nationkey || ',"z":' || c_custkey || '}}' AS map_json
        FROM texts
    """,
    "json_turns": """
        SELECT CAST(json_object('row', json_object(
                   'conv_id', conv_id, 'turn', turn, 'role', role, 'text', text)) AS VARCHAR)
                   AS json,
               conv_id, turn, role, text
        FROM conversations
    """,
}
