import random
import string

import pytest
import xxhash
from cases import SF_DIR, awkward, empty, given

from foliospark.llm import line_dedup as module
from foliospark.llm.line_dedup import chunks, line_dedup
from foliospark.llm.queries import QUERIES


def brute_force(rows, min_words=10):
    """Every least window of lines, from each line on and back from each line, against all that come first."""
    windows, first = [], {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        words = [len(x.encode().split()) for x in lines]
        own = set()
        for i in range(len(lines)):
            for step in (1, -1):
                j = i
                while 0 <= j < len(lines):
                    low, high = min(i, j), max(i, j)
                    if words[i] and words[j] and i != j and sum(words[low : high + 1]) >= min_words:
                        own.add((low, high + 1))
                        break
                    j += step
        for low, high in sorted(own):
            part = "\n".join(lines[low:high])
            windows.append((doc_id, low, high, part))
            first[part] = min(first.get(part, (doc_id, low)), (doc_id, low))
    gone = {doc_id: set() for doc_id, _ in rows}
    for doc_id, low, high, part in windows:
        if first[part][0] != doc_id or first[part][1] + high - low <= low:
            gone[doc_id].update(range(low, high))
    return {
        i: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), len(gone[i])) for i, t in rows
    }


def test_query_equals_brute_force(spark, monkeypatch):
    """With a boundary at every line nothing is lost; with chosen ones next to nothing."""
    want = brute_force(given("documents", "doc_id, text"))
    some = {r["doc_id"]: r["n_removed"] for r in QUERIES["op10_line_dedup"](spark, SF_DIR).collect()}
    lines = sum(n for _, n in want.values())
    assert lines > 100 and 0.95 * lines <= sum(some.values()) <= lines
    assert all(some[i] <= n for i, (_, n) in want.items())
    monkeypatch.setattr(module, "NO_BOUNDARY", 0)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in QUERIES["op10_line_dedup"](spark, SF_DIR).collect()}
    assert got == want


def some_lines(chance, n):
    return [" ".join(chance.choices(string.ascii_lowercase, k=chance.randint(5, 12))) for _ in range(n)]


@pytest.mark.parametrize("copies", [2, 20])
def test_recall_by_length_of_the_passage(spark, copies):
    chance = random.Random(copies)
    rows, planted = [], {}
    for length in (2, 3, 4, 6):
        for _ in range(40):
            passage = some_lines(chance, length)
            for copy in range(copies):
                lines = [*some_lines(chance, chance.randint(1, 4)), *passage, *some_lines(chance, chance.randint(1, 4))]
                planted[len(rows)] = (length, copy)
                rows.append((len(rows), "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(df).collect()}
    for length in (2, 3, 4, 6):
        found = [got[i][1] for i, (n, copy) in planted.items() if n == length and copy]
        assert sum(found) / (length * len(found)) >= 0.95, (length, sum(found) / (length * len(found)))
        assert max(found) == length
    assert all(got[i][1] == 0 for i, (_, copy) in planted.items() if not copy)


def test_boundaries_hang_on_lines_inside_alone():
    passage = [f"line {i} of the passage here" for i in range(60)]
    one = "\n".join(["a", *passage]).encode()
    two = "\n".join(["x y", "", "z", *passage, "end of all"]).encode()
    cut = [{c[2] for c in chunks(t, 10)} for t in (one, two)]
    inside = [{c for c in own if c.startswith(b"line") and c.endswith(b"here")} for own in cut]
    assert inside[0] == inside[1] and 50 < len(inside[0]) <= 59


def test_lines_around_a_chunk_go_along(spark, monkeypatch):
    """Chunks at one place of a passage only; the rest is found line by line."""
    passage = [f"w{i} of the passage with words" for i in range(9)]
    middle = [xxhash.xxh64_intdigest(passage[i].encode()) for i in (4, 5)]
    monkeypatch.setattr(module, "boundaries", lambda h: ([x == middle[0] for x in h], [x == middle[1] for x in h]))
    passage.insert(3, "")
    rows = [(1, "\n".join(["first one", *passage, "", "then this"])), (2, "\n".join(["", *passage, "", "or that"])),
            (3, "\n".join(["other", *passage[3:8], "changed"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup(df).collect()}
    assert got == {1: rows[0][1].split("\n"), 2: ["", "", "or that"], 3: ["other", "", "changed"]}


def test_keys_that_collide_are_told_apart_by_bytes(spark, monkeypatch):
    rows = [(i, "\n".join(f"{'odd' if i % 2 else 'even'} passage line {k} with many words in it here" for k in range(6))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")

    class OneKey:
        xxh64_intdigest = staticmethod(xxhash.xxh64_intdigest)
        xxh3_128_digest = staticmethod(lambda data: b"k" * 16)

    monkeypatch.setattr(module, "xxhash", OneKey)
    monkeypatch.setattr(module, "NO_BOUNDARY", 0)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(df).collect()}
    assert got == brute_force(rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    out = line_dedup(df)
    assert out.columns == [*df.columns, "n_removed_"]
    rows = out.collect()
    assert len(rows) == 14
    before = sorted(map(str, df.select("doc_id", "text").collect()))
    # one text has several lines, and none of its chunks comes twice
    same = [r for r in rows if r["n_removed_"] == 0]
    assert sorted(str(r) for r in spark.createDataFrame([(r[0], r[1]) for r in same], "doc_id bigint, text string").collect()) == before
    assert line_dedup(empty(spark)).collect() == []


def repeated_runs(rows, min_words=10):
    """Independent of windows and hashes: every run of equal lines, extended as far as it goes."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        worded = [bool(x.encode().strip()) for x in lines]
        gone, place_of = set(), {}
        for i, line in enumerate(lines):
            for other, j in seen.get(line, []) if worded[i] else []:
                if i and j and worded[i - 1] and lines[i - 1] == other[j - 1]:
                    continue  # a longer run starts before
                n = 0
                while i + n < len(lines) and j + n < len(other) and lines[i + n] == other[j + n]:
                    n += 1
                while not worded[i + n - 1]:
                    n -= 1
                if sum(worded[i : i + n]) > 1 and len("\n".join(lines[i : i + n]).encode().split()) >= min_words:
                    gone.update(range(i, i + n))
            place_of.setdefault(line, []).append((lines, i))
        for line, places in place_of.items():
            seen.setdefault(line, []).extend(places)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_every_repeated_passage_goes(spark, monkeypatch):
    monkeypatch.setattr(module, "NO_BOUNDARY", 0)
    chance = random.Random(3)
    passages = [some_lines(chance, 2 + i % 5) for i in range(40)]
    passages[7].insert(1, "")
    rows = [(i, "\n".join([*some_lines(chance, i % 4), *passages[i % 40], *some_lines(chance, i % 3)])) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(df).collect()}
    assert got == repeated_runs(rows)
    assert all(got[i][1] == len(passages[i % 40]) for i in range(40, 160))


def test_query_finds_every_repeated_run_between_documents(spark, monkeypatch):
    monkeypatch.setattr(module, "NO_BOUNDARY", 0)
    # of runs within a document, QUERIES removes those that do not overlap the first
    got = {r["doc_id"]: r["n_removed"] for r in QUERIES["op10_line_dedup"](spark, SF_DIR).collect()}
    want = {i: n for i, (_, n) in repeated_runs(given("documents", "doc_id, text")).items()}
    assert all(got[i] >= n for i, n in want.items()) and sum(want.values()) > 125


def test_the_first_of_overlapping_passages_stays(spark, monkeypatch):
    monkeypatch.setattr(module, "NO_BOUNDARY", 0)
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(1, "\n".join([a] * 5)), (2, "\n".join([b, a] * 3)), (3, "\n".join([b] * 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup(df).collect()}
    assert got == {1: [a, a], 2: [b, a], 3: [b, b, b]}
