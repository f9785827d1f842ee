"""User functions over rows, partitions and slots."""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import (
    distribute,
    distribute_eval,
    map_eval,
    map_groups_tagged,
    map_isolated,
    map_partitions_tagged,
    report_index,
    slot_count,
    spread,
    spread_by_weight,
)
from foliospark.queries.inputs import table

SLOTS = 64


def spread_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"))


def spread_documents_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 partitions, none of which has many more characters than the mean."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    slots = spread_by_weight(documents, "n_chars", 16).groupBy(F.spark_partition_id().alias("slot"))
    shares = slots.agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    return shares.agg(
        F.sum("rows").alias("n_docs"),
        F.sum("chars").alias("n_chars"),
        (F.max("chars") <= F.sum("chars") / 16 * 1.1 + F.max("longest")).alias("even"),
    )


def checked_events(spark: SparkSession, sf_dir: str, run_id: str) -> DataFrame:
    """Every event through a function that refuses error events."""

    def check(report, row):
        report.append(f"Event {row['event_id']}")
        if row["event_type"] == "error":
            raise ValueError(f"event {row['event_id']} is an error")
        report.append(f"is a {row['event_type']}")
        return {"twice": row["value"] * 2, "kind": row["event_type"].upper()}

    return map_isolated(
        table(spark, sf_dir, "events"),
        check,
        key="event_id",
        schema="twice double, kind string",
        run_id=run_id,
        columns=["event_type", "value"],
    )


def map_isolated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = checked_events(spark, sf_dir, "map_isolated")
    return checked.withColumn("lines", F.concat_ws("; ", "lines"))


def map_isolated_bad_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that do not fit their type fail alone; the function itself never raises."""

    def size(report, row):
        long_text = row["n_chars"] % 2 == 1
        return {"n_chars": "odd" if long_text else row["n_chars"]}

    sizes = map_isolated(
        table(spark, sf_dir, "documents"),
        size,
        key="doc_id",
        schema="n_chars bigint",
        run_id="sizes",
        columns=["n_chars"],
    )
    return sizes.select(F.col("key").alias("doc_id"), "child_id", "status", "n_chars")


def distribute_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per slot, next to the slot's share of the orders."""

    def greet(report, row):
        report.append(f"slot {row['id']} reports")
        if row["id"] % 7 == 3:
            raise RuntimeError(f"slot {row['id']} is down")
        return {"square": row["id"] * row["id"]}

    slots = distribute(spark, greet, SLOTS, "square bigint", run_id="distribute")
    slot = F.pmod("o_orderkey", F.lit(SLOTS)).alias("key")
    shares = table(spark, sf_dir, "orders").groupBy(slot).agg(F.count("*").alias("n_orders"))
    return slots.join(shares, "key", "left").select(
        "key", "child_id", "status", "error", F.concat_ws("; ", "lines").alias("lines"),
        "square", F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
    )


def distribute_eval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot results from a column and from a function, next to the customers per slot."""
    in_spark = distribute_eval(
        spark, [F.col("id"), (F.col("id") * F.col("id")).alias("square")], SLOTS
    )
    in_python = distribute_eval(
        spark, lambda row: {"id": row["id"], "cube": row["id"] ** 3}, SLOTS,
        "id bigint, cube bigint",
    )
    slot = F.pmod("c_custkey", F.lit(SLOTS)).alias("id")
    shares = table(spark, sf_dir, "customer").groupBy(slot).agg(F.count("*").alias("n_customers"))
    return (
        in_spark.join(in_python, "id")
        .join(shares, "id", "left")
        .withColumn("n_customers", F.coalesce("n_customers", F.lit(0)))
    )


def map_eval_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return map_eval(
        orders, [F.col("o_orderkey"), (F.col("o_orderkey") * 2 + 1).alias("next_key")]
    )


def map_eval_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form: a function of whole Arrow columns."""

    def next_key(batch):
        key = batch.column("o_orderkey")
        following = pc.add(pc.multiply(key, 2), 1)
        return pa.RecordBatch.from_arrays([key, following], names=["o_orderkey", "next_key"])

    return map_eval(
        table(spark, sf_dir, "orders"),
        next_key,
        "o_orderkey bigint, next_key bigint",
        columns=["o_orderkey"],
        batched=True,
    )


def map_eval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text in Unicode's composed form, which no built-in makes: its digest and length."""

    def composed(row):
        text = unicodedata.normalize("NFC", row["text"])
        digest = hashlib.md5(text.encode()).hexdigest()
        return {"doc_id": row["doc_id"], "digest": digest, "n_composed": len(text)}

    documents = table(spark, sf_dir, "documents")
    schema = "doc_id bigint, digest string, n_composed bigint"
    return map_eval(documents, composed, schema, columns=["doc_id", "text"])


def map_isolated_long_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose errors are all one has: whole texts, however long."""

    def refuse(report, row):
        if row["doc_id"] % 3 == 0:
            raise ValueError(row["text"])
        return {"n": len(row["text"])}

    documents = table(spark, sf_dir, "documents")
    out = map_isolated(documents, refuse, "doc_id", "n bigint", "long_errors", columns=["text"])
    return out.select(F.col("key").alias("doc_id"), "status", "error", "n")


def revenue_by_partition(spark: SparkSession, sf_dir: str, run_id: str, slots: int | None = None):
    """The revenue of every line item, batch by batch, with a row count per partition."""

    def revenue(report, batches):
        n = 0
        for batch in batches:
            n += batch.num_rows
            kept = pc.subtract(1.0, batch.column("l_discount"))
            amount = pc.multiply(batch.column("l_extendedprice"), kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("l_orderkey"), batch.column("l_linenumber"), amount],
                names=["l_orderkey", "l_linenumber", "revenue"],
            )
        report.append(str(n))

    return map_partitions_tagged(
        table(spark, sf_dir, "lineitem"),
        revenue,
        "l_orderkey bigint, l_linenumber int, revenue double",
        run_id,
        columns=["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"],
        slots=slots,
    )


def map_partitions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without their tag: which partition they were in is up to Spark."""
    return revenue_by_partition(spark, sf_dir, "map_partitions").drop("child_id", "part", "lines")


def partition_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child has one report, its count is right, and no slot has two children."""
    slots = slot_count(spark)
    tagged = revenue_by_partition(spark, sf_dir, "partition_reports", slots)
    children = tagged.groupBy("child_id").agg(
        F.count("*").alias("n_rows"),
        F.count("lines").alias("n_reports"),
        F.sum(F.element_at("lines", 1).cast("bigint")).alias("n_reported"),
    )
    wrong = (F.col("n_reports") != 1) | (F.col("n_rows") != F.col("n_reported"))
    return children.agg(
        F.sum("n_rows").alias("n_rows"),
        F.count_if(wrong).alias("n_wrong"),
        (F.count("*") <= slots).alias("within_slots"),
    )


def report_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index line per event, each event being a child."""
    return report_index(checked_events(spark, sf_dir, "report_index"), distinct=False)


def report_index_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index line per partition, all of them well formed and different."""
    tagged = revenue_by_partition(spark, sf_dir, "report_index_partitions")
    index = report_index(tagged)
    links = r"\[markdown\]\(\1\.md\) \[html\]\(\1\.html\) \[pdf\]\(\1\.pdf\)"
    form = rf"^Subreport: ([0-9a-f]{{32}}) {links}$"
    return index.agg(
        (F.count("*") >= 1).alias("has_children"),
        (F.count("*") == F.count_distinct("child_id")).alias("all_different"),
        F.count_if(~F.col("line").rlike(form)).alias("n_malformed"),
    )


def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders in order of their keys, each with the sum so far in cents."""

    def balances(report, key, batches):
        total = 0
        for batch in batches:
            cents = pc.round(pc.multiply(batch.column("o_totalprice"), 100.0)).cast(pa.int64())
            sums = pc.add(pc.cumulative_sum(cents), total)
            total = sums[-1].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column("o_custkey"), batch.column("o_orderkey"), sums],
                names=["o_custkey", "o_orderkey", "balance"],
            )
        report.append(f"customer {key['o_custkey']}: {total}")

    return map_groups_tagged(
        table(spark, sf_dir, "orders"),
        ["o_custkey"],
        balances,
        "o_custkey bigint, o_orderkey bigint, balance bigint",
        "running_balance",
        order=["o_orderkey"],
        columns=["o_totalprice"],
    )


def running_balance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = running_balance(spark, sf_dir)
    return found.drop("part").withColumn("lines", F.concat_ws("; ", "lines"))


def hot_groups_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three return flags have a third of all line items each; partial sums of pieces are combined."""

    def sums(report, key, batches):
        lines, quantity = 0, 0.0
        for batch in batches:
            lines += batch.num_rows
            quantity += pc.sum(batch.column("l_quantity")).as_py()
        yield pa.RecordBatch.from_pydict({"flag": [key["l_returnflag"]], "n": [lines], "quantity": [quantity]})

    parts = map_groups_tagged(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], sums, "flag string, n bigint, quantity double",
        "pieces", columns=["l_orderkey", "l_linenumber", "l_quantity"], pieces=16,
    )
    pieces = (F.count("*") > 1).alias("split_up")
    return parts.groupBy("flag").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"), pieces)


QUERIES = {
    "map_groups_tagged": running_balance_query,
    "map_groups_pieces": hot_groups_in_pieces,
    "spread": spread_orders,
    "spread_by_weight": spread_documents_by_length,
    "map_isolated": map_isolated_query,
    "map_isolated_bad_values": map_isolated_bad_values,
    "map_isolated_long_errors": map_isolated_long_errors,
    "distribute": distribute_query,
    "distribute_eval": distribute_eval_query,
    "map_eval_column": map_eval_column,
    "map_eval_function": map_eval_function,
    "map_eval_texts": map_eval_texts,
    "map_partitions_tagged": map_partitions_query,
    "partition_reports": partition_reports,
    "report_index": report_index_query,
    "report_index_partitions": report_index_partitions,
}

ORACLES = {
    "map_groups_tagged": """
        WITH sums AS (
            SELECT o_custkey, o_orderkey, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS last,
                   CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT))
                        OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance
            FROM orders
        )
        SELECT o_custkey, o_orderkey, balance,
               md5('running_balance:{"o_custkey":' || o_custkey || '}') AS child_id,
               CASE WHEN last THEN 'customer ' || o_custkey || ': ' || balance ELSE '' END AS lines
        FROM sums
    """,
    "map_groups_pieces": """
        SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS quantity, true AS split_up
        FROM lineitem GROUP BY l_returnflag
    """,
    "spread": "SELECT * FROM orders",
    "spread_by_weight": "SELECT count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, true AS even FROM documents",
    "map_isolated": """
        SELECT event_id AS key, md5('map_isolated:' || event_id) AS child_id,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN event_type = 'error'
                    THEN 'ValueError: event ' || event_id || ' is an error' END AS error,
               'Event ' || event_id
                   || CASE WHEN event_type = 'error' THEN '' ELSE '; is a ' || event_type END
                   AS lines,
               CASE WHEN event_type <> 'error' THEN value * 2 END AS twice,
               CASE WHEN event_type <> 'error' THEN upper(event_type) END AS kind
        FROM events
    """,
    "map_isolated_bad_values": """
        SELECT doc_id, md5('sizes:' || doc_id) AS child_id,
               CASE WHEN n_chars % 2 = 1 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN n_chars % 2 = 0 THEN n_chars END AS n_chars
        FROM documents
    """,
    "map_isolated_long_errors": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN doc_id % 3 = 0 THEN 'ValueError: ' || text END AS error,
               CASE WHEN doc_id % 3 <> 0 THEN CAST(length(text) AS BIGINT) END AS n
        FROM documents
    """,
    "distribute": """
        SELECT s.id AS key, md5('distribute:' || s.id) AS child_id,
               CASE WHEN s.id % 7 = 3 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN s.id % 7 = 3 THEN 'RuntimeError: slot ' || s.id || ' is down' END AS error,
               'slot ' || s.id || ' reports' AS lines,
               CASE WHEN s.id % 7 <> 3 THEN s.id * s.id END AS square,
               count(o_orderkey) AS n_orders
        FROM (SELECT range AS id FROM range(64)) s LEFT JOIN orders ON o_orderkey % 64 = s.id
        GROUP BY s.id
    """,
    "distribute_eval": """
        SELECT s.id, s.id * s.id AS square, s.id * s.id * s.id AS cube,
               count(c_custkey) AS n_customers
        FROM (SELECT range AS id FROM range(64)) s LEFT JOIN customer ON c_custkey % 64 = s.id
        GROUP BY s.id
    """,
    "map_eval_column": "SELECT o_orderkey, o_orderkey * 2 + 1 AS next_key FROM orders",
    "map_eval_function": "SELECT o_orderkey, o_orderkey * 2 + 1 AS next_key FROM orders",
    "map_eval_texts": """
        SELECT doc_id, md5(nfc_normalize(text)) AS digest,
               CAST(length(nfc_normalize(text)) AS BIGINT) AS n_composed
        FROM documents
    """,
    "map_partitions_tagged": """
        SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue
        FROM lineitem
    """,
    "partition_reports": """
        SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong, true AS within_slots FROM lineitem
    """,
    "report_index": """
        WITH children AS (SELECT md5('report_index:' || event_id) AS child_id FROM events)
        SELECT child_id, child_id || '.md' AS markdown, child_id || '.html' AS html,
               child_id || '.pdf' AS pdf,
               'Subreport: ' || child_id || ' [markdown](' || child_id || '.md) [html]('
                   || child_id || '.html) [pdf](' || child_id || '.pdf)' AS line
        FROM children
    """,
    "report_index_partitions": """
        SELECT count(*) >= 1 AS has_children, true AS all_different,
               CAST(0 AS BIGINT) AS n_malformed
        FROM lineitem
    """,
}
