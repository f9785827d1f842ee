import threading
import time

import pytest
from pyspark.sql import functions as F

from foliospark import shared_storage
from foliospark.functions import parse_json_checked, parse_variant, variant_field
from foliospark.shared_storage import Claim, replace_folder, restore_folder
from foliospark.sinks import materialize, publish_fixed, save_layer


def failing(spark, n=100):
    """Rows of which the last cannot be made, so a write of them ends halfway."""
    bad = F.when(F.col("id") == n - 1, F.raise_error("halfway").cast("bigint")).otherwise(F.col("id"))
    return spark.range(0, n, 1, 4).select(bad.alias("id"))


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    folder = str(tmp_path / "report")
    publish_fixed(spark.range(7), folder, overwrite=True)
    with pytest.raises(Exception, match="halfway"):
        publish_fixed(failing(spark), folder, overwrite=True)
    assert spark.read.parquet(folder).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["report"]
    publish_fixed(spark.range(3), folder, overwrite=True)
    publish_fixed(spark.range(2), folder, overwrite=False)
    assert spark.read.parquet(folder).count() == 5


def test_the_old_rows_are_there_until_the_new_ones_are_whole(spark, tmp_path):
    folder, seen = str(tmp_path / "report"), []
    publish_fixed(spark.range(7), folder, overwrite=True)
    slow = spark.range(0, 3, 1, 3).mapInArrow(lambda batches: (time.sleep(1), (yield from batches))[1], "id bigint")
    writing = threading.Thread(target=publish_fixed, args=(slow, folder, True))
    writing.start()
    while writing.is_alive():
        try:
            seen.append(spark.read.parquet(folder).count())
        except Exception:  # begun before the change
            continue
    assert set(seen) <= {3, 7} and seen[0] == 7
    assert spark.read.parquet(folder).count() == 3


def test_a_process_lost_between_the_renames(spark, tmp_path, monkeypatch):
    old, new = tmp_path / "report", tmp_path / "report.new"
    spark.range(7).write.parquet(str(old))
    spark.range(2).write.parquet(str(new))
    old.rename(tmp_path / "report.replaced")
    assert restore_folder(spark, str(old)) and not restore_folder(spark, str(old))
    assert spark.read.parquet(str(old)).count() == 7
    replace_folder(spark, str(new), str(old))
    assert spark.read.parquet(str(old)).count() == 2 and not new.exists()
    with pytest.raises(OSError):
        replace_folder(spark, str(tmp_path / "absent"), str(old))
    assert spark.read.parquet(str(old)).count() == 2


def test_a_failed_layer_leaves_the_old_one(spark, tmp_path):
    folder = str(tmp_path / "layer")
    rows = spark.range(20).selectExpr("concat('s', id % 2) AS scope", "cast(id AS string) AS key", "'old' AS value")
    save_layer(rows, folder)
    before = sorted(map(str, spark.read.text(folder).collect()))
    bad = failing(spark).selectExpr("'s0' AS scope", "cast(id AS string) AS key", "'new' AS value")
    with pytest.raises(Exception, match="halfway"):
        save_layer(bad, folder)
    assert sorted(map(str, spark.read.text(folder).collect())) == before


def test_one_of_several_sessions_builds(spark, tmp_path):
    built, found = [], []

    def builder(session):
        built.append(1)
        time.sleep(1)
        return session.range(5)

    def ask(session):
        found.append(materialize(session, str(tmp_path / "t"), builder, wait=0.1).count())

    threads = [threading.Thread(target=ask, args=(spark.newSession(),)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == [5] * 4 and len(built) == 1
    assert not (tmp_path / "t.claim").exists()


def test_a_failed_builder_lets_the_next_one_build(spark, tmp_path):
    with pytest.raises(Exception, match="halfway"):
        materialize(spark, str(tmp_path / "t"), failing)
    assert materialize(spark, str(tmp_path / "t"), lambda s: s.range(4)).count() == 4


def test_stale_claims_are_taken_over(spark, tmp_path):
    path = str(tmp_path / "x.claim")
    lost, waiting = Claim(spark, path, 1), Claim(spark, path, 1)
    assert lost.take() and not waiting.take()
    time.sleep(2.5)
    assert not waiting.take()  # it is renewed
    lost._done.set()  # its process is gone
    time.sleep(2)
    assert waiting.take() and not Claim(spark, path, 1).take()
    lost.release()
    assert (tmp_path / "x.claim").exists()  # it was no longer its own
    waiting.release()
    assert not (tmp_path / "x.claim").exists()
    assert [p.name for p in tmp_path.iterdir() if "claim" in p.name and not p.name.startswith(".")] == []


def test_rejected_texts_and_why(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": "one"}', '{"b": null}', '{"a": 1', "[1]", "", None, '{"a": 1, "c": 2}', "7", "nul", '{"a": 99999999999}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["p"] for r in df.select("i", parse_json_checked("text", "a int, b string").alias("p")).collect()}
    values = {i: p["value"] and tuple(p["value"]) for i, p in got.items()}
    assert values == {0: (1, "x"), 1: None, 2: (None, None), 3: None, 4: None, 5: None, 6: None, 7: (1, None), 8: None, 9: None, 10: None}
    reasons = {i: p["rejected"] and p["rejected"]["reason"] for i, p in got.items()}
    fit, none, other = "does not fit the schema", "no JSON", "no object"
    assert reasons == {0: None, 1: fit, 2: None, 3: none, 4: other, 5: none, 6: None, 7: None, 8: other, 9: none, 10: fit}
    assert all(p["rejected"] is None or p["rejected"]["text"] == texts[i] for i, p in got.items())
    must = df.select("i", parse_json_checked("text", "a int NOT NULL").alias("p")).where("i IN (0, 2)").collect()
    assert [r["p"]["rejected"] and r["p"]["rejected"]["reason"] for r in must] == [None, fit]
    with pytest.raises(ValueError):
        parse_json_checked("text", "array<int>")


def test_variants(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": "x"}]}',), ("[2]",), ("broken",), (None,)], "text string")
    v = parse_variant("text")
    out = df.select(variant_field(v, "$.a[1].b", "string"), variant_field(v, "$.a[0]", "int"), variant_field(v, "$[0]", "int"))
    assert [tuple(r) for r in out.collect()] == [("x", 1, None), (None, None, 2), (None,) * 3, (None,) * 3]
