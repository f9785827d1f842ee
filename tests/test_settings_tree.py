import json
import random

import pytest

from foliospark.queries import layers
from foliospark.sources import settings_in_force, settings_tree


def write(root, folder, settings):
    place = root / folder if folder else root
    place.mkdir(parents=True, exist_ok=True)
    text = settings if isinstance(settings, str) else json.dumps(settings)
    (place / "app.json").write_text(text)


def in_force(spark, root, folders):
    asked = spark.createDataFrame([(f,) for f in folders], "folder string")
    found = settings_in_force(settings_tree(spark, str(root)), asked).collect()
    return {(r["folder"], r["key"]): (r["value"], r["scope"]) for r in found}


def test_the_deepest_folder_decides(spark, tmp_path):
    root = tmp_path / "a b+c%[1]"
    write(root, "", {"x": "0", "y": "0"})
    write(root, "eu/de", {"x": "2", "y": None})
    write(root, "eu/de/é ö", {"x": "3"})
    write(root, "eu/deep", {"x": "other"})
    (root / "eu/notes.json").write_text("no settings")
    tree = settings_tree(spark, str(root))
    assert sorted(tuple(r)[:2] for r in tree.collect()) == [
        ("", 0), ("", 0), ("eu/de", 2), ("eu/de", 2), ("eu/de/é ö", 3), ("eu/deep", 2),
    ]
    found = in_force(spark, root, ["eu/de/é ö/x/y", "/eu//de/", "eu", "absent/path", "", None, "eu", "eu"])
    assert found == {
        ("eu/de/é ö/x/y", "x"): ("3", "eu/de/é ö"), ("eu/de/é ö/x/y", "y"): (None, "eu/de"),
        ("/eu//de/", "x"): ("2", "eu/de"), ("/eu//de/", "y"): (None, "eu/de"),
        ("eu", "x"): ("0", ""), ("eu", "y"): ("0", ""),
        ("absent/path", "x"): ("0", ""), ("absent/path", "y"): ("0", ""), ("", "x"): ("0", ""), ("", "y"): ("0", ""),
    }


def test_repeated_keys_missing_trees_and_malformed_files(spark, tmp_path):
    assert settings_tree(spark, str(tmp_path / "absent")).collect() == []
    write(tmp_path / "one", "", '{"k": "first", "k": "last"}')
    assert [r["value"] for r in settings_tree(spark, str(tmp_path / "one")).collect()] == ["last"]
    write(tmp_path / "two", "x", '{"k": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        settings_tree(spark, str(tmp_path / "two")).collect()


def test_many_folders_in_one_plan(spark, tmp_path):
    """Against a walk up each path; the plan has one scan and its size does not grow with the folders."""
    chance = random.Random(1)
    settings = {"": {"a": "root"}}
    for _ in range(120):
        folder = "/".join(str(chance.randrange(4)) for _ in range(chance.randint(1, 4)))
        settings[folder] = {k: chance.choice(["1", "2", None]) for k in chance.sample("abcd", 2)}
    for folder, values in settings.items():
        write(tmp_path, folder, values)
    folders = ["/".join(str(chance.randrange(4)) for _ in range(chance.randint(1, 6))) for _ in range(10_000)]
    want = {}
    for folder in set(folders):
        steps = folder.split("/")
        for n in range(len(steps) + 1):
            scope = "/".join(steps[:n])
            for key, value in settings.get(scope, {}).items():
                want[folder, key] = (value, scope)
    assert in_force(spark, tmp_path, folders) == want
    layers = settings_tree(spark, str(tmp_path))

    def plan(n):
        asked = spark.range(n).selectExpr("concat(id % 4, '/', id % 3) AS folder")
        return settings_in_force(layers, asked)._jdf.queryExecution().optimizedPlan().toString()

    assert plan(10_000).count("Relation") == 1 and len(plan(10_000)) - len(plan(10)) < 50


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for n in range(100):
        write(tmp_path, f"f{n}", {"k": str(n)})
    name, context = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(name)
    context.setJobGroup("listing of a tree", "")
    try:
        tree = settings_tree(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing of a tree") for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= context.defaultParallelism
    assert spark.conf.get(name) == before
    assert sorted(r["value"] for r in tree.collect()) == sorted(str(n) for n in range(100))


def test_all_cores_write_the_tree(spark, tmp_path, monkeypatch):
    """The files of few customers are little data, but each takes its time."""
    monkeypatch.setattr(layers, "fresh_folder", lambda spark, purpose: str(tmp_path / "tree"))
    tables = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(1, "N1", 0), (2, "N2", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": (
            [(k, f"C{k}", 1 + k % 2, 9600.0 if k % 3 else -950.0) for k in range(60)],
            "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {(r["c_custkey"], r["key"]): r["value"] for r in layers.settings_of_every_customer(spark, str(tmp_path)).collect()}
    want = {}
    for k in range(60):
        national = k % 2  # N2 has customers with odd keys
        want[k, "contact"] = "N2" if national else "R"
        want[k, "tier"] = "gold" if k % 3 else None
        if k % 3:
            want[k, "owner"] = f"C{k}"
    assert found == want
    files = list((tmp_path / "tree").glob("region=*/nation=*/customer=*/part-*"))
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > 1
