from collections import Counter

from cases import SF_DIR, awkward, empty, given

from foliospark.llm.quality import RULES, Measures, Rule, estimate_cascade, keep_quality, quality_verdicts
from foliospark.llm.queries import QUERIES


def counted(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered.update(range(i, i + 5))
    seen, dups = set(), 0
    for line in text.encode().split(b"\n"):
        if line.split():
            dups += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered)


def test_query_equals_brute_force(spark):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op1_quality_rules"](spark, SF_DIR).collect()}
    rows = given("documents", "doc_id, text")
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base = counted(text)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        kept = not failed and not any(r.rejects(Measures(text.encode())) for r in RULES)
        assert got[doc_id] == (*base, failed, kept)


def test_labelled_texts(spark):
    labels = dict(given("labels", "doc_id, quality"))
    for row in QUERIES["op1_quality_rules"](spark, SF_DIR).collect():
        if labels.get(row["doc_id"]) == 0:
            assert not row["kept"]
        elif labels.get(row["doc_id"]) == 1 and not row["base_failed"]:
            assert row["kept"]


def test_the_order_follows_rejections_per_cost(spark):
    calls = []

    def slow(m):
        return sum(range(20_000)) < 0

    rules = (Rule("slow", slow), Rule("all", lambda m: True), Rule("none", lambda m: False))
    order = estimate_cascade(awkward(spark), rules)
    assert order[0].rule.name == "all" and order[0].rejected == 1.0 and calls == []
    assert [e.rejected for e in order[1:]] == [0.0, 0.0]


def test_order_does_not_change_verdicts(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    one = keep_quality(df).select("doc_id").collect()
    two = keep_quality(df, tuple(reversed(RULES))).select("doc_id").collect()
    assert sorted(one) == sorted(two) and 0 < len(one) < df.count()


def test_awkward_rows(spark):
    df = awkward(spark)
    judged = quality_verdicts(df)
    assert judged.columns == [*df.columns, "quality_"]
    kept = keep_quality(df)
    assert kept.columns == df.columns
    # the others have few words or lines that repeat
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 6, 7, 11, 11]
    assert keep_quality(empty(spark)).collect() == []
