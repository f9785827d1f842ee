"""Operators together, as a user runs them."""

import json

from pyspark.sql import functions as F

from foliospark.functions import parse_json, to_json_sorted
from foliospark.operators import distribute, map_isolated, overlay, report_index
from foliospark.plans import run_notebook
from foliospark.sinks import (
    child_report,
    materialize,
    new_archive,
    publish_run,
    write_child_reports,
)
from foliospark.sources import folder_levels, settings_layers

SF_DIR = "/root/testdata/sf0.001"


def test_three_rounds_of_slots_that_report_their_settings(spark, tmp_path):
    work = tmp_path / "jobs" / "worker"
    work.mkdir(parents=True)
    (tmp_path / "app.json").write_text('{"bucket": "main", "worker.index": "none"}')
    (work / "app.json").write_text('{"worker.index": "3"}')
    settings = overlay(settings_layers(spark, folder_levels(str(work))), ["key"])
    as_map = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    text = settings.select("key", "value").agg(to_json_sorted(as_map).alias("text")).first()["text"]
    assert text == '{\n  "bucket" : "main",\n  "worker.index" : "3"\n}'

    def work_in(report, row):
        report.append(f"slot {row['id']}")
        report.append(text)
        return {"result": json.loads(text)["worker.index"]}

    for number in range(3):
        archive = f"{tmp_path}/archive-{number}"
        slots = distribute(spark, work_in, 8, run_id=f"round-{number}")
        write_child_reports(slots, archive)
        children = sorted(slots.collect())
        assert [(c.key, c.status, c.result) for c in children] == [(i, "ok", "3") for i in range(8)]
        report = child_report(spark, archive, children[5].child_id).first()
        assert report.lines == ["slot 5", text]
        assert {r.child_id for r in report_index(slots).collect()} == {c.child_id for c in children}


def test_a_notebook_is_published(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/orders.parquet").createOrReplaceTempView("test_workload_orders")
    report = run_notebook(
        spark,
        ["%sql\nSELECT o_orderstatus, count(*) AS n FROM test_workload_orders"
         " GROUP BY o_orderstatus ORDER BY o_orderstatus", "%sql\nselekt 1"],
    )
    folder = publish_run(report, new_archive(str(tmp_path)), "notebook", "run-1")
    published = spark.read.parquet(folder).orderBy("cell").collect()
    assert [r.status for r in published] == ["ok", "error"]
    assert published[0].lines[:2] == ["| o_orderstatus | n |", "|---|---|"]
    assert len(published[0].lines) == 5


def test_one_materialized_run_serves_results_and_reports(spark, tmp_path):
    """The function runs once per event, however often the run is used."""
    runs = spark.sparkContext.accumulator(0)

    def check(report, row):
        runs.add(1)
        report.append(row["event_type"])
        return {"long": row["k"] > 50}

    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    parsed = events.select("event_id", "event_type", parse_json("props", "k int").alias("props"))
    flat = parsed.select("event_id", "event_type", "props.k")

    def build(session):
        return map_isolated(flat, check, "event_id", "long boolean", "r")

    run = materialize(spark, f"{tmp_path}/run", build)
    write_child_reports(run, f"{tmp_path}/reports")
    assert report_index(run, distinct=False).count() == events.count() == runs.value
    assert spark.read.json(f"{tmp_path}/reports").count() == events.count()
