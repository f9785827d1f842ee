import itertools
import math
import zlib
from collections import Counter

import numpy as np
from cases import SF_DIR, awkward, empty, given

from foliospark.llm.hidden_markov import (
    FORMS,
    Model,
    WordIndex,
    emissions_of,
    expected_counts,
    form,
    form_pairs,
    forms_in,
    log_likelihoods,
    score_texts,
    tokens_of,
    train,
    unpacked,
    word_counts,
)
from foliospark.llm.queries import QUERIES


def test_query_equals_brute_force_and_beats_unigrams(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op5_hidden_markov"](spark, SF_DIR).collect()}
    tokens = {i: [*t.encode().lower().split(), b" "] for i, t in given("documents", "doc_id, text")}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        row = rows[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (out[i], len(words), n)
        assert row["n_known"] == sum(counts[w] > 0 for w in words)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        assert math.isfinite(row["score"])
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def model(states=3, symbols=5, seed=4):
    chance = np.random.default_rng(seed)
    start, moves, emits = chance.random(states), chance.random((states, states)), chance.random((states, symbols))
    return Model(
        0, 0, {}, np.zeros(0, np.int64), np.zeros(FORMS), np.zeros(FORMS),
        start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True),
    )


def laid(sequences):
    return np.concatenate(sequences), np.array([len(s) for s in sequences])


def test_recursions_equal_the_sum_over_all_paths():
    m = model()
    sequences = [np.array(s) for s in ([0, 1, 4, 2], [3], [2, 2], [4, 0, 0, 1])]
    runs = [expected_counts(*laid(sequences), m, size=size) for size in (1, 2, 3, 1024)]
    want_start, want_moves, want_emits, want_logs = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), []
    for s in sequences:
        parts = []
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emits[path[0], s[0]]
            for t in range(1, len(s)):
                p *= m.moves[path[t - 1], path[t]] * m.emits[path[t], s[t]]
            parts.append((path, p))
        total = sum(p for _, p in parts)
        want_logs.append(math.log10(total))
        for path, p in parts:
            want_start[path[0]] += p / total
            for t, k in enumerate(path):
                want_emits[k, s[t]] += p / total
                if t:
                    want_moves[path[t - 1], k] += p / total
    for start, moves, emitted in runs:
        assert np.allclose(start, want_start, rtol=1e-4) and np.allclose(moves, want_moves, rtol=1e-4)
        assert np.allclose(emitted, want_emits, rtol=1e-4, atol=1e-6)
    for size in (1, 2, 3, 64):
        assert np.allclose(log_likelihoods(*laid(sequences), m, size), want_logs)


def test_long_sequences_equal_a_plain_recursion():
    m, chance = model(), np.random.default_rng(2)
    sequences = [chance.integers(0, 5, n) for n in (50_000, 1, 64, 65, 1000)]
    for s, log in zip(sequences, log_likelihoods(*laid(sequences), m)):
        alpha, want = m.start * m.emits[:, s[0]], 0.0
        for x in s[1:]:
            want += math.log10(alpha.sum())
            alpha = (alpha / alpha.sum()) @ m.moves * m.emits[:, x]
        assert math.isclose(log, want + math.log10(alpha.sum()), rel_tol=1e-9)


def test_scores_are_those_of_the_trained_model(spark):
    texts = {i: t for i, t in given("documents", "doc_id, text") if i < 200}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["id"]: r["score"] for r in score_texts(df, max_frequent=500).collect()}
    kept = df.where(f"crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 != 2").select("text")
    m, table = train(kept, word_counts(kept), max_frequent=500)
    rest = {bytes(r["word"]): r for r in table.collect()}
    assert len(rest) > 1000 and not rest.keys() & m.frequent.keys()
    assert len(rest) + len(m.frequent) == m.n_words
    states = len(m.start)

    def emissions(words):
        forms, facts = [form(w) for w in words], [rest.get(w) for w in words]
        n = np.array([r["n"] if r else 0.0 for r in facts])
        even = np.full(states, 1 / states)
        shares = np.array([unpacked([bytes(r["shares"])], states)[0] if r else even for r in facts])
        return emissions_of(m, np.array(forms), n, shares)

    words = sorted(rest)
    found = dict(zip(words, emissions(words)))
    assert np.ptp([e / e.sum() for e in found.values()], axis=0).min() > 0.5  # words are learned apart
    # all words of a form, with the unknown one, share what the form has
    for f in {form(w) for w in words}:
        of_form = sum(found[w] for w in words if form(w) == f) + emissions_of(m, np.array([f]), np.zeros(1), np.full((1, states), 1 / states))[0]
        assert np.allclose(of_form, m.emits[:, f])
    for i, text in texts.items():
        tokens = [*(text or "").encode().lower().split(), b" "]
        alpha, want = None, 0.0
        for w in tokens:
            if w in m.frequent:
                e = m.emits[:, FORMS + m.frequent[w]]
            else:
                e = found[w] if w in found else emissions([w])[0]
            alpha = (m.start if alpha is None else alpha @ m.moves) * e
            want += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert math.isclose(got[i], want, rel_tol=1e-6), i


def test_awkward_rows(spark):
    rows = score_texts(awkward(spark), sample_rounds=1, rounds=1).collect()
    assert len(rows) == 14 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["id"] in (3, 4, 5)} == {1}
    assert score_texts(empty(spark)).collect() == []
    nothing = spark.createDataFrame([(2, "a b"), (2, None)], "doc_id bigint, text string")
    share = zlib.crc32(b"2") % 7
    rows = score_texts(nothing, held_out=share).collect()
    assert [(r["held_out"], r["train_tokens"], r["n_known"]) for r in rows] == [(True, 0, 0)] * 2
    assert all(math.isfinite(r["score"]) for r in rows)


TEXTS = ["A b\tc", "", None, "\x0b\x0c", " . .x ", "é\u00a0ö\x1c ÄÖ.", "word " * 300, "a" * 40 + "\n.", "Ab ab AB"]


def test_words_are_numbered_as_they_are_met():
    texts = [(t or "").encode() for t in TEXTS]
    tokens = [tokens_of(t) for t in texts]
    forms, ends = forms_in(texts)
    assert forms.tolist() == [form(w) for t in tokens for w in t]
    assert ends.tolist() == list(np.cumsum([len(t) for t in tokens]) - 1)
    index = WordIndex({b"word": 0, b" ": 1})
    assert index.symbols(tokens, forms).tolist() == [
        {b"word": FORMS, b" ": FORMS + 1}.get(w, form(w)) for t in tokens for w in t
    ]
    met = list(dict.fromkeys(w for t in tokens for w in t if w not in (b"word", b" ")))
    numbers = {b"word": FORMS, b" ": FORMS + 1} | {w: FORMS + 2 + i for i, w in enumerate(met)}
    assert index.numbers(tokens).tolist() == [numbers[w] for t in tokens for w in t]
    assert index.others() == met and index.others(3) == met[3:]


def test_the_start_counts_neighbours_in_all_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(4)
    want = np.zeros((FORMS + 1, FORMS))
    for text in TEXTS * 3:
        before = FORMS
        for word in tokens_of((text or "").encode()):
            want[before, form(word)] += 1
            before = form(word)
    assert np.array_equal(form_pairs(df), want)


def test_training_does_not_depend_on_where_rows_lie(spark):
    """Of 2,400 rows none is left out, so their order and partitions change nothing."""
    chance = np.random.default_rng(3)
    kinds = ["the a of in".split(), "run sees goes".split(), [f"word{i}s" for i in range(200)]]
    texts = [" ".join(str(chance.choice(kinds[(i + k) % 3])) for i in range(12)) for k in range(2400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    turned = spark.createDataFrame([(t,) for t in reversed(texts)], "text string").coalesce(1)
    one, other = (train(rows, word_counts(rows), states=2, max_frequent=50)[0] for rows in (df, turned))
    assert np.allclose(one.start, other.start, atol=1e-3) and np.allclose(one.moves, other.moves, atol=1e-3)
    assert np.allclose(one.emits, other.emits, atol=1e-3)
