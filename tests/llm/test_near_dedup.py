import random
from collections import defaultdict

import numpy as np
import pytest
from cases import SF_DIR, awkward, empty, given

from foliospark.llm import near_dedup
from foliospark.llm.near_dedup import compressed, components, estimate, keep_one, near_duplicates, sketch
from foliospark.llm.queries import QUERIES


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_force(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_query_equals_brute_force(spark):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op9_near_dedup"](spark, SF_DIR).collect()}
    assert got == brute_force(given("documents", "doc_id, text"), 4)


@pytest.mark.parametrize("block", [512, 8])
def test_groups_of_marginal_copies(spark, monkeypatch, block):
    """Copies of one base with so many edits that links between them are few and chained."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    chance = random.Random(5)
    base = [f"w{chance.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(chance.choice([0, 1, 2, 3, 4, 5])):
            words[chance.randrange(120)] = f"edit{chance.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, width=4).collect()}
    assert got == brute_force(rows, 4)


def test_registers_estimate_the_similarity(spark):
    chance = np.random.default_rng(1)
    errors = []
    for size in (5, 40, 400):
        for share in (0.2, 0.5, 0.8, 1.0):
            both = chance.integers(0, 1 << 63, max(1, int(size * share)), np.uint64)
            rest = chance.integers(0, 1 << 63, 2 * (size - len(both)), np.uint64)
            a, b = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
            truth = len(both) / (len(both) + len(rest))
            x, y = compressed(sketch(np.unique(a))), compressed(sketch(np.unique(b)))
            frame = spark.createDataFrame([(x.tolist(), y.tolist(), len(a), len(b))], "x array<smallint>, y array<smallint>, n int, m int")
            found = frame.select(estimate(frame["x"], frame["y"], frame["n"], frame["m"])).first()[0]
            errors.append(abs(found - truth))
    assert max(errors) < 0.2 and np.mean(errors) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (100, 300)]
    links = spark.createDataFrame(chain, "a int, b int")
    found = {r["node"]: r["label"] for r in components(links).collect()}
    want = defaultdict(int) | {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert found == dict(want)


def test_awkward_rows(spark):
    rows = near_duplicates(awkward(spark)).collect()
    assert len(rows) == 14
    of = {r["id"]: r for r in rows}
    assert of[1]["component_id"] == of[2]["component_id"] == 1 and not of[2]["kept"]
    assert of[7]["component_id"] == 6 and of[6]["kept"]
    assert of[3]["n_shingles"] == of[4]["n_shingles"] == of[5]["n_shingles"] == 0
    assert all(of[i]["kept"] for i in (3, 4, 5, 8, 9)) and of[8]["n_shingles"] == 1
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["id"] is None)
    kept = keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9, 10, 11]
    assert near_duplicates(empty(spark)).collect() == [] and keep_one(empty(spark)).collect() == []


def test_names_of_its_own_that_the_table_has_too(spark):
    rows = [(1, "one two three four five six", 7, 8), (1, "one two three four five six", 7, 8), (2, "one two three four five six", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, near_dup_id int, NEAR_DUP_VERTEX int")
    assert [tuple(r) for r in keep_one(df).collect()] == rows[:1]


def test_a_set_is_stored_once(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('a b c d e f ', id % 2) AS text").repartition(7)
    assert near_dedup._full_sets(df, df.select(df["doc_id"].alias("id")), 5, "doc_id", "text").count() == 2
