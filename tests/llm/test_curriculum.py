import hashlib
import math
import random
from collections import defaultdict

import pytest
from cases import awkward, empty

from foliospark.llm.curriculum import by_first_position, segments, training_mix, training_order
from foliospark.llm.queries import CURRICULUM

FLAT = [[(0, 1), (1, 1)]]


def brute_force(rows, schedules, demand=1.5, max_epochs=2):
    """Per row ``(id, size, source_size, target, taken)``; rows are (id, text, source)."""
    sizes = [len((text or "").encode().split()) for _, text, _ in rows]
    total = defaultdict(int)
    for (_, _, source), size in zip(rows, sizes):
        total[source] += size
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    areas = [sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(k, k[1:])) for k in schedules]
    weight = {s: areas[i % len(areas)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes) * demand
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > max_epochs * total[s]}
        for s in full:
            target[s] = float(max_epochs * total[s])
            left -= target[s]
        open_ -= full
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
    placed = defaultdict(list)
    for i, (id_, text, source) in enumerate(rows):
        named = ":".join(str(x) for x in (id_, text) if x is not None)
        placed[source].append((hashlib.md5(named.encode()).hexdigest(), -1 if id_ is None else id_, i))
    taken = [0] * len(rows)
    for source, places in placed.items():
        left = math.floor(target[source] + 0.5)
        for _ in range(max_epochs):
            for _, _, i in sorted(places):
                words = min(left, sizes[i])
                taken[i] += words
                left -= words
    return [(r[0], n, total[r[2]], pytest.approx(target[r[2]]), t) for r, n, t in zip(rows, sizes, taken)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


def mixed(mix):
    return in_order([(r["id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mix.collect()])


def test_hot_source_and_sources_too_small_for_their_share(spark):
    chance = random.Random(3)
    rows = []
    for i in range(1500):
        source = "hot" if i % 3 else chance.choice(["a", "b", "B", "ä", None, "small"] if i % 9 else ["tiny"])
        rows.append((i, " ".join("w" * (1 + chance.randrange(3)) for _ in range(chance.randrange(60))), source))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = training_mix(df, CURRICULUM)
    assert mixed(mix) == in_order(brute_force(rows, CURRICULUM))
    assert mixed(mix) == mixed(mix.select("*"))
    sums = mix.groupBy("source_size", "target").sum("taken", "size").collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 1 for r in sums)
    assert all(t <= 2 * n for _, n, _, _, t in mixed(mix))


def test_the_mixture_follows_the_schedules(spark):
    rows = [(i, "one two three four", "up" if i % 2 else "down") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    schedules = {"up": [(0, 0), (1, 2)], "down": [(0, 2), (1, 0)], "absent": [(0, 1), (1, 1)]}
    mix = training_mix(df, schedules, demand=1.0, carry=["source", "text"])
    order = training_order(mix).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert sum(r["words"] for r in order) == 16_000
    for tenth in range(10):
        part = [r["row"]["source"] for r in order if tenth <= r["position"] * 10 < tenth + 1]
        assert part.count("up") / len(part) == pytest.approx((tenth + 0.5) / 10, abs=0.02)
    first = [r["takes"][0]["position"] for r in by_first_position(mix).collect()]
    assert first == sorted(first)


def test_sources_without_schedule_or_weight_are_not_taken(spark):
    rows = [(1, "a b c", "x"), (2, "d e f", "y"), (3, "g h", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = training_mix(df, {"x": [(0, 1), (1, 1)], "y": [(0, 0), (1, 0)]})
    assert {r["id"]: r["taken"] for r in mix.collect()} == {1: 6, 2: 0, 3: 0}


def test_awkward_rows_and_clashing_names(spark):
    df = awkward(spark).withColumnRenamed("quality", "source")
    mix = training_mix(df, CURRICULUM, carry=df.columns)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert mixed(mix) == in_order(brute_force(rows, CURRICULUM))
    named = df.selectExpr("doc_id", "text", "source", "1 AS size", "2 AS row", "3 AS `a.b`")
    assert training_mix(named, FLAT, carry=named.columns).select("row.row", "row.`a.b`").first() == (2, 3)
    nothing = training_mix(empty(spark).withColumnRenamed("quality", "source"), CURRICULUM)
    assert nothing.collect() == [] and training_order(nothing).collect() == []
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [r[1:] for r in mixed(training_mix(wordless, CURRICULUM))] == [(0, 0, 0.0, 0)] * 2


def test_schedules_are_checked():
    for knots in ([(0, 1)], [(0.1, 1), (1, 1)], [(0, 1), (0, 1), (1, 1)], [(0, -1), (1, 1)]):
        with pytest.raises(ValueError):
            segments(knots)
