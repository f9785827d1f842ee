import string
from itertools import combinations

from cases import LONG, PROSE, SF_DIR, awkward, empty, given

from foliospark.llm.decontaminate import benchmark_overlaps, decontaminate, masks
from foliospark.llm.queries import QUERIES


def normal(text):
    return [x for w in (text or "").encode().lower().split() if (x := w.strip(string.punctuation.encode()))]


def brute_force(docs, items, min_words=13, percent=80):
    found = set()
    for doc_id, text in docs:
        words = normal(text)
        places = {}
        for place, word in enumerate(words):
            places.setdefault(word, []).append(place)
        for item_id, item_text in items:
            item = normal(item_text)
            window = min(min_words, len(item))
            shifts = {place - i for i, w in enumerate(item) for place in places.get(w, ())} if item else set()
            for shift in shifts:
                equal = [0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(item)]
                if any(100 * sum(equal[i : i + window]) >= percent * window for i in range(len(item) - window + 1)):
                    found.add((doc_id, item_id))
                    break
    return found


def test_query_equals_brute_force(spark):
    got = [(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontamination"](spark, SF_DIR).collect()]
    want = brute_force(given("documents", "doc_id, text"), given("benchmark", "item_id, text"))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_substitutions_are_tolerated(spark):
    item = PROSE.split()
    near = list(item)
    near[3], near[9] = "other", "Words"
    far = [w if i % 2 else f"x{i}" for i, w in enumerate(item)]
    docs = [(1, "before it " + " ".join(near) + " after"), (2, " ".join(far)), (3, PROSE.upper().replace(" ", ", ")), (4, PROSE[:30])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, PROSE), (8, PROSE), (9, None), (None, "short item"), (10, "...")], "item_id int, text string")
    rows = {(r["id"], r["item_id"]): (r["first_word"], r["n_words"], r["n_equal"]) for r in benchmark_overlaps(df, items).collect()}
    assert rows == {(1, 7): (2, 15, 13), (1, 8): (2, 15, 13), (3, 7): (0, 15, 15), (3, 8): (0, 15, 15)}
    assert sorted(r["doc_id"] for r in decontaminate(df, items).collect()) == [2, 4]


def test_short_items_have_to_agree_as_a_whole(spark):
    df = spark.createDataFrame([(1, "x short item y"), (2, "short the item")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "Short item")], "item_id int, text string")
    assert [r["id"] for r in benchmark_overlaps(df, items).collect()] == [1]


def test_awkward_rows(spark):
    df = awkward(spark)
    items = spark.createDataFrame([(1, PROSE), (2, LONG[5000:5400])], "item_id int, text string")
    left = decontaminate(df, items)
    assert left.columns == df.columns
    rows = left.collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 3, 4, 5, 8, 9, 10, 11, 11]
    assert [r["text"] for r in rows if r["doc_id"] is None] == [None]  # the other overlaps
    assert decontaminate(empty(spark), items).collect() == []
    assert decontaminate(df, items.limit(0)).count() == 14


def test_masks_miss_no_tolerated_pattern(spark):
    """Every choice of words that may be replaced in 13 neighbouring ones, or in a shorter item."""
    for span in range(1, 14):
        tolerated = span - -(-span * 80 // 100)
        for replaced in combinations(range(span), tolerated):
            assert any(not set(picked) & set(replaced) for picked in masks(span, 80))
        assert all(picked for picked in masks(span, 80))
    docs, items, want = [], [], set()
    for n in range(5, 17):
        item = [f"word{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for replaced in combinations(range(n), 1 if n < 10 else 2):
            text = " ".join("other" if i in replaced else w for i, w in enumerate(item))
            docs.append((len(docs), f"some words before {text} and after"))
            window = min(13, n)
            if any(100 * sum(i not in replaced for i in range(a, a + window)) >= 80 * window for a in range(n - window + 1)):
                want.add((docs[-1][0], n))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = benchmark_overlaps(df, spark.createDataFrame(items, "item_id int, text string"))
    assert {(r["id"], r["item_id"]) for r in found.collect()} == want and len(want) == len(docs)
