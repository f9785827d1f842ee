"""Fan-out as on a cluster: workers without this package, and tasks that are repeated."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import json
import sys

sys.path.insert(0, {repo!r})  # the driver's path; Spark does not pass it to the workers
from pyspark import TaskContext
from pyspark.sql import SparkSession

from foliospark.operators import map_eval, map_isolated, map_partitions_tagged

spark = (
    SparkSession.builder.master("local[2,3]")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")


def lose_first_attempt():
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")


def count(report, batches):
    for batch in batches:
        report.append(f"batch of {{batch.num_rows}}")
        yield batch
    lose_first_attempt()


def double(row):
    lose_first_attempt()
    return {{"x": row["id"] * 2}}


def greet(report, row):
    report.append("hello")
    return {{"x": row["id"]}}


df = spark.range(0, 30, 1, 3)
print(json.dumps({{
    "tagged": [[r.id, r.child_id, r.lines]
               for r in map_partitions_tagged(df, count, "id bigint", "run").collect()],
    "doubled": [r.x for r in map_eval(df, double, "x bigint").collect()],
    "greeted": [[r.key, r.status, r.lines, r.x]
                for r in map_isolated(df, greet, "id", "x bigint", "run").collect()],
}}))
"""


def test_repeated_tasks_on_workers_without_the_package(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO)],
        cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=180,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    result = json.loads(done.stdout.strip().splitlines()[-1])
    assert [row[0] for row in result["tagged"]] == list(range(30))
    assert len({row[1] for row in result["tagged"]}) == 3
    # Nothing of the lost attempts is left, not even a line.
    assert [row[2] for row in result["tagged"] if row[2]] == [["batch of 10"]] * 3
    assert result["doubled"] == [2 * i for i in range(30)]
    assert result["greeted"] == [[i, "ok", ["hello"], i] for i in range(30)]
