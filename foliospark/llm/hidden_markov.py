"""Scoring texts with a hidden Markov language model over words.

Every word of the training texts has an emission of its own in every state. Words with a share
of at least 1 / ``max_frequent`` of all training tokens are symbols; there cannot be more than
``max_frequent`` of them, so their emissions have a fixed size bound and are at hand without
a join. All other words are rows of a table that grows with the corpus, one a word, with the
word's expected count in each state, and are joined where they are asked for. Until the last
round such words share a symbol by their outward form f (length and last sign); the last round
tells them apart:

    P(word | state) = P(f | state) * (N_f * e_state(word) / e_state(f) + 1) / (N_f + V_f + 1)

where e are expected counts of that round, N_f is the number of training tokens of the form
and V_f of its words. The 1 added at the end is the share of an unknown word. A word whose
states are spread as its form's are has (count + 1) / (N_f + V_f + 1) of it.

Baum-Welch counts come from all training texts, each a sequence from its first word to its end:
tasks run the scaled forward and backward recursions over their texts, and Spark sums the
expected counts by symbol, in the last round by word too. Training starts from what all texts say
of neighbours: Spark counts which form follows which, and expectation-maximisation on that matrix,
of the same size for any corpus, finds states. The score of a text is the log10 of its
exact likelihood, by the scaled forward recursion. For it, texts are numbered in slices; each
slice asks for its distinct other words once and gets what the table knows of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import bytes_of, crc_remainder, only, slices, stored

#: The token that ends every text; no word contains a space.
END = b" "
#: Symbols of words that are not frequent.
FORMS = 512
#: Expected counts are shuffled in steps of 1 / 1,024, as round numbers are packed well.
_STEPS = 1024
_FLUSH = 300_000
#: Texts are scored in slices of about so many bytes: the larger, the fewer rows ask for a word again.
SCORED_BYTES = 8 << 20


def form(word: bytes) -> int:
    """The symbol of a word that is not frequent: its length, up to 15 bytes, and its last sign."""
    size = len(word)
    return (size if size < 15 else 15) << 5 | word[-1] & 31


@dataclass
class Model:
    """What tasks need; its size is bounded by ``max_frequent`` and the number of states.

    ``frequent`` numbers the frequent words and ``counts`` has the training count of each.
    Symbols are the forms, then the frequent words. Of the other words of a form, ``form_tokens``
    and ``form_words`` are the numbers of tokens and of words, and ``form_states`` has the
    expected count of each state.
    """

    n_tokens: int
    n_words: int
    frequent: dict[bytes, int]
    counts: np.ndarray
    form_tokens: np.ndarray
    form_words: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    form_states: np.ndarray | None = None


class WordIndex(dict):
    """The symbol of a frequent word; other words are numbered on from there as they are met."""

    def __init__(self, frequent: dict[bytes, int]):
        super().__init__((word, FORMS + i) for word, i in frequent.items())
        self.n_frequent = len(frequent)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = FORMS + len(self)
        return number

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """Of all words of all texts, one after the other."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))

    def symbols(self, texts: list[list[bytes]], forms: np.ndarray) -> np.ndarray:
        """As ``numbers``, with the form of any word that is not frequent; none is remembered."""
        found = np.fromiter(map(self.get, chain.from_iterable(texts), repeat(-1)), np.int64, len(forms))
        return np.where(found < 0, forms, found)

    def others(self, start: int = 0) -> list[bytes]:
        """The words met that are not frequent, in the order of their numbers, from the one at ``start``."""
        return list(islice(self, self.n_frequent + start, None))


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(df: DataFrame) -> DataFrame:
    """``word`` (binary) and ``n`` over all texts of ``df`` (``text``), ends included."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flushed():
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
            )
            counts.clear()

        for batch in slices(batches, "text"):
            for text in bytes_of(batch, "text"):
                counts.update(tokens_of(text))
            if len(counts) > _FLUSH:
                yield from flushed()
        if counts:
            yield from flushed()

    return df.select("text").mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def forms_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The forms of all tokens of all texts, one after the other, and the places of the ends."""
    space = np.zeros(256, bool)
    space[list(b" \t\n\v\f\r")] = True
    signs = np.frombuffer(b"".join([t + b" . " for t in texts]), np.uint8)  # the point stands for the end
    edges = np.flatnonzero(np.diff(space[signs], prepend=True))  # words begin and end by turns
    begins, ends = edges[::2], edges[1::2]
    forms = np.minimum(ends - begins, 15) << 5 | signs[ends - 1] & 31
    last = np.searchsorted(begins, np.cumsum([len(t) + 3 for t in texts]) - 2)
    forms[last] = form(END)
    return forms, last


def form_pairs(df: DataFrame) -> np.ndarray:
    """How often each form (column) follows each other one (row) in all texts of ``df`` (``text``), ends
    included; the last row counts the forms that texts begin with."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FORMS + 1) * FORMS, np.int64)
        for batch in slices(batches, "text"):
            forms, last = forms_in(bytes_of(batch, "text"))
            before = np.concatenate([[FORMS], forms[:-1]])
            before[last[:-1] + 1] = FORMS
            total += np.bincount(before * FORMS + forms, minlength=len(total))
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(total[pairs])], names=["pair", "n"])

    rows = df.select("text").mapInArrow(counted, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((FORMS + 1) * FORMS)  # its size does not depend on the texts
    total[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return total.reshape(FORMS + 1, FORMS)


def segments(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, laid end to end, cut into runs of ``size``: where each begins, its length, its sequence."""
    runs = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), runs)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    begins = np.repeat(np.cumsum(lengths) - lengths, runs) + number * size
    return begins, np.minimum(size, lengths[owner] - number * size), owner


def run_matrices(symbols: np.ndarray, lengths: np.ndarray, model: Model, size: int):
    """The steps of each run of ``size`` symbols as one matrix, scaled, and the log10 of its scale.

    Runs are in the order of their sequences; the first step of a sequence has no move before it.
    """
    begins, sizes, owner = segments(lengths, size)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    starts = begins == (np.cumsum(lengths) - lengths)[owner[order]]
    emits, moves, longest = model.emits.T, np.ascontiguousarray(model.moves.T), int(sizes[0])
    # runs are the last axis, on which numpy is fast
    before = np.where(starts, np.eye(len(moves))[:, :, None], model.moves[:, :, None])
    matrices = before * emits[symbols[begins]].T
    logs = np.zeros(len(begins))
    for t in range(1, longest + 1):
        n = len(begins)
        if t < longest:
            n = int(np.searchsorted(-sizes, -t, side="left"))
            matrices[:, :, :n] = (moves @ matrices[:, :, :n]) * emits[symbols[begins[:n] + t]].T
        if t % 8 == 0 or t == longest:  # eight steps are far from the least number there is
            scale = matrices[:, :, :n].max(axis=(0, 1))
            matrices[:, :, :n] /= scale
            logs[:n] += np.log10(scale)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return matrices.transpose(2, 0, 1)[place], logs[place], owner


def in_turn(owner: np.ndarray, n: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The first runs of all ``n`` sequences, then the second ones, and so on: sequences and their runs."""
    runs = np.bincount(owner, minlength=n)
    ends = np.cumsum(runs)
    by_runs = np.argsort(-runs, kind="stable")
    for k in range(int(runs.max())):
        who = by_runs[: int(np.searchsorted(-runs[by_runs], -k, side="left"))]
        yield who, (ends[who] - 1 - k if backwards else (ends - runs)[who] + k)


def log_likelihoods(symbols: np.ndarray, lengths: np.ndarray, model: Model, size: int = 64) -> np.ndarray:
    """The log10 likelihood of each sequence; all have a symbol at least.

    The scaled forward recursion, with its steps grouped: the steps of a run of symbols make
    a matrix, all runs at the same time, and the matrices of a sequence are applied
    in turn. That is the same product, and long sequences take few steps.
    """
    matrices, logs, owner = run_matrices(symbols, lengths, model, size)
    total = np.bincount(owner, logs, len(lengths))
    alpha = np.tile(model.start, (len(lengths), 1))
    for who, run in in_turn(owner, len(lengths)):
        now = np.einsum("ns,nst->nt", alpha[who], matrices[run])
        scale = now.sum(axis=1)
        alpha[who] = now / scale[:, None]
        total[who] += np.log10(scale)
    return total


def states_between(symbols: np.ndarray, lengths: np.ndarray, model: Model, size: int):
    """What runs hand to each other: the forward state before each run and the backward state after
    it, scaled to agree; of the first run the start, of the last ones. Also which runs are first."""
    runs, states = -(-lengths // size), len(model.start)
    ends = np.cumsum(runs)
    before, after = np.tile(model.start, (int(ends[-1]), 1)), np.ones((int(ends[-1]), states))
    first = np.zeros(len(before), bool)
    first[ends - runs] = True
    cut = np.flatnonzero(runs > 1)
    if len(cut):
        tokens = np.repeat(runs > 1, lengths)
        matrices, _, owner = run_matrices(symbols[tokens], lengths[cut], model, size)
        of_run = np.flatnonzero(np.repeat(runs > 1, runs))  # the place of these runs among all
        alpha, beta = np.tile(model.start, (len(cut), 1)), np.ones((len(cut), states))
        for who, run in in_turn(owner, len(cut)):
            before[of_run[run]] = alpha[who]
            now = np.einsum("ns,nst->nt", alpha[who], matrices[run])
            alpha[who] = now / now.sum(axis=1, keepdims=True)
        for who, run in in_turn(owner, len(cut), backwards=True):
            after[of_run[run]] = beta[who]
            now = np.einsum("nst,nt->ns", matrices[run], beta[who])
            beta[who] = now / now.max(axis=1, keepdims=True)
        inner = np.flatnonzero(~first) - 1  # runs with a run after them in their sequence
        after[inner] /= (before[inner + 1] * after[inner]).sum(axis=1, keepdims=True)
    return before, after, first


def expected_counts(
    symbols: np.ndarray, lengths: np.ndarray, model: Model, labels: np.ndarray | None = None, n_labels: int = 0, size: int = 1024
):
    """The forward and backward recursions over whole sequences: how often each state is expected to
    start one, to follow another, and to emit each symbol (with ``labels``: each label).

    Sequences of more than ``size`` symbols are worked on in runs that hand their states on.
    """
    before, after, first = states_between(symbols, lengths, model, size)
    begins, sizes, _ = segments(lengths, size)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes, first = begins[order], sizes[order], first[order]
    longest, states = int(sizes[0]), len(model.start)
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    at = np.concatenate([[0], np.cumsum(active)])
    places = np.concatenate([begins[: active[t]] + t for t in range(longest)])
    flat = symbols[places]
    # single precision is enough for counts, and a row a state is what numpy is fast on
    before, beta = (np.ascontiguousarray(x[order].T, np.float32) for x in (before, after))
    emits = np.take(model.emits.astype(np.float32), flat, axis=1)
    back, forth = model.moves.astype(np.float32), np.ascontiguousarray(model.moves.T, np.float32)
    scales, alphas = np.empty(len(flat), np.float32), np.empty((states, len(flat)), np.float32)
    alpha = np.where(first, before, forth @ before)
    for t in range(longest):
        here = slice(at[t], at[t + 1])
        alpha = (alpha if t == 0 else forth @ alpha[:, : active[t]]) * emits[:, here]
        scales[here] = scale = alpha.sum(axis=0)
        alpha /= scale
        alphas[:, here] = alpha
    moves, posterior = np.zeros((states, states)), alphas
    for t in range(longest - 1, -1, -1):
        here, now = slice(at[t], at[t + 1]), beta[:, : active[t]]
        ahead = emits[:, here] * now
        ahead /= scales[here]
        posterior[:, here] *= now  # from here on the place of alpha has the posterior
        if t:
            moves += (alphas[:, at[t - 1] : at[t - 1] + active[t]] @ ahead.T) * model.moves
            beta[:, : active[t]] = back @ ahead
        else:
            moves += (before[:, ~first] @ ahead[:, ~first].T) * model.moves
    counted, n = (flat, model.emits.shape[1]) if labels is None else (labels[places], n_labels)
    emitted = np.stack([np.bincount(counted, posterior[k], n) for k in range(states)])
    return posterior[:, : active[0]][:, first].sum(axis=1, dtype=np.float64), moves, emitted


def expected_rows(df: DataFrame, model: Model, by_word: bool) -> DataFrame:
    """Expected counts of a round over all texts of ``df`` (``text``), summed by Spark.

    ``row`` 0 is the start, the next are moves, then symbols, with ``s0``, ``s1``, ... by state. With
    ``by_word`` there is a row for each word that is not frequent too: ``word`` and its count ``n``.
    """
    states, n_symbols = len(model.start), model.emits.shape[1]
    shared = df.sparkSession.sparkContext.broadcast(vars(model))
    names = [f"s{k}" for k in range(states)]

    def batch_of(rows, words, n, found: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())]
        columns += [pa.array(np.rint(found[:, k] * _STEPS) / _STEPS) for k in range(states)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "word", "n", *names])

    def expectations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = Model(**shared.value), None
        index, symbols_of = WordIndex(current.frequent), np.arange(n_symbols)
        n, found = np.zeros(0, np.int64), np.zeros((0, states))
        for batch in slices(batches, "text"):
            texts = bytes_of(batch, "text")
            tokens = [tokens_of(t) for t in texts]
            lengths = np.array([len(t) for t in tokens])
            if by_word:
                numbers = index.numbers(tokens)
                new = index.others(len(symbols_of) - n_symbols)
                symbols_of = np.append(symbols_of, np.array([form(w) for w in new], np.int64))
                start, moves, emitted = expected_counts(symbols_of[numbers], lengths, current, numbers, len(symbols_of))
                n = np.append(n, np.zeros(len(new), np.int64)) + np.bincount(numbers, minlength=len(symbols_of))[n_symbols:]
                found = np.vstack([found, np.zeros((len(new), states))]) + emitted[:, n_symbols:].T
                emitted = emitted[:, :n_symbols]
            else:
                start, moves, emitted = expected_counts(index.symbols(tokens, forms_in(texts)[0]), lengths, current)
            round_ = np.vstack([start[None, :], moves, emitted.T])
            total = round_ if total is None else total + round_
            if len(n) > _FLUSH:
                yield batch_of(np.full(len(n), -1), index.others(), n, found)
                index, symbols_of = WordIndex(current.frequent), symbols_of[:n_symbols]
                n, found = n[:0], found[:0]
        if len(n):
            yield batch_of(np.full(len(n), -1), index.others(), n, found)
        if total is not None:
            keep = np.flatnonzero(total.any(axis=1))
            yield batch_of(keep, [None] * len(keep), np.zeros(len(keep), np.int64), total[keep])

    schema = "row bigint, word binary, n bigint, " + ", ".join(f"{x} double" for x in names)
    found = df.select("text").mapInArrow(expectations, schema)
    return found.groupBy("row", "word").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])


def renewed(model: Model, summed: DataFrame, form_states: np.ndarray | None = None, smoothing: float = 0.01) -> Model:
    """The model after a round whose expected counts are ``summed``; after the last round, which
    counts by word, those of the forms are ``form_states``."""
    states, n_symbols = len(model.start), model.emits.shape[1]
    found = summed.where("row >= 0").select("row", *[f"s{k}" for k in range(states)]).toArrow()  # a row a symbol and state: bounded as the model is
    total = np.zeros((1 + states + n_symbols, states))
    total[found.column("row").to_numpy()] = np.stack([found.column(f"s{k}").to_numpy() for k in range(states)], axis=1)
    start, moves, found = total[0] + smoothing, total[1 : 1 + states] + smoothing, total[1 + states :].T
    if form_states is not None:
        found[:, :FORMS] = form_states.T
    # every word, and an unknown one in each form, counts once more: spread over states as its form
    # is, where the form has training tokens, else as all tokens are
    overall = (found.sum(axis=1) + smoothing) / (found.sum() + states * smoothing)
    tokens, words = model.form_tokens, model.form_words
    more = found[:, :FORMS] * (words + 1) / np.maximum(tokens, 1)
    once = np.broadcast_to(overall[:, None], (states, n_symbols - FORMS))
    more = np.hstack([np.where(tokens > 0, more + smoothing * overall[:, None], overall[:, None]), once])
    emits = found + more
    return replace(
        model,
        start=start / start.sum(),
        moves=moves / moves.sum(axis=1, keepdims=True),
        emits=emits / emits.sum(axis=1, keepdims=True),
        form_states=form_states,
    )


def shares_of(states: int):
    """The shares of a word's states, in steps of 1 / 255, a byte each: small where they are shuffled."""

    @F.pandas_udf("binary")
    def packed(counts):
        import pandas as pd

        found = np.stack([counts[f"s{k}"].to_numpy() for k in range(states)], axis=1).astype(np.float64)
        steps = np.rint(found / found.sum(axis=1, keepdims=True) * 255).astype(np.uint8)
        return pd.Series([row.tobytes() for row in steps])

    return packed(F.struct(*[f"s{k}" for k in range(states)]))


def unpacked(shares: list[bytes], states: int) -> np.ndarray:
    found = np.frombuffer(b"".join(shares), np.uint8).reshape(-1, states).astype(np.float64)
    return found / found.sum(axis=1, keepdims=True)


def form_sums(words: DataFrame, states: int) -> np.ndarray:
    """For every form: its words, their tokens, and these by state (``word``, ``n``, ``shares``)."""
    names = ["words", "n", *[f"s{k}" for k in range(states)]]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), FORMS))
        for batch in batches:
            forms = np.array([form(w) for w in batch.column("word").to_pylist()], np.int64)
            n = batch.column("n").to_numpy()
            weights = [np.ones(len(n)), n, *(n[:, None] * unpacked(batch.column("shares").to_pylist(), states)).T]
            total += np.stack([np.bincount(forms, w, FORMS) for w in weights])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FORMS)), *map(pa.array, total)], names=["form", *names])

    schema = "form bigint, " + ", ".join(f"{x} double" for x in names)
    rows = words.mapInArrow(summed, schema).groupBy("form").agg(*[F.sum(x).alias(x) for x in names]).collect()
    total = np.zeros((FORMS, len(names)))
    for row in rows:  # one a form
        total[row["form"]] = [row[x] for x in names]
    return total


def first_model(counts: DataFrame, states: int, max_frequent: int, seed: int = 1) -> Model:
    """The model before training, from the corpus counts (``word``, ``n``)."""
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.where(F.col("n") * max_frequent >= n_tokens).toArrow().to_pylist()
    known = sorted(((bytes(r["word"]), r["n"]) for r in frequent), key=lambda x: (-x[1], x[0]))
    others = counts.where(F.col("n") * max_frequent < n_tokens)
    words, tokens = form_sums(others.withColumn("shares", F.lit(b"\x01")), 1)[:, :2].T
    share = np.concatenate([tokens + words + 1, [n + 1.0 for _, n in known]])
    random = np.random.default_rng(seed)
    emits = share * random.uniform(0.5, 1.5, (states, len(share)))
    moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Model(
        n_tokens,
        n_words,
        {word: i for i, (word, _) in enumerate(known)},
        np.array([n for _, n in known], np.int64),
        tokens,
        words,
        np.full(states, 1 / states),
        moves / moves.sum(axis=1, keepdims=True),
        emits / emits.sum(axis=1, keepdims=True),
    )


def started(model: Model, pairs: np.ndarray, rounds: int, seed: int = 1) -> Model:
    """``model`` with the states that ``rounds`` rounds of expectation-maximisation find in ``pairs`` (of :func:`form_pairs`).

    A pair's likelihood is that of two neighbours in a hidden Markov model over forms. Each symbol's
    training count is then spread over the states as its form is.
    """
    states, random = len(model.start), np.random.default_rng(seed)
    begun, follow = pairs[FORMS], pairs[:FORMS]
    emits = (pairs.sum(axis=0) + 1) * random.uniform(0.5, 1.5, (states, FORMS))
    emits, start, joint = emits / emits.sum(axis=1, keepdims=True), model.start, model.moves / states
    for _ in range(rounds):
        first = start[:, None] * emits
        first *= begun / first.sum(axis=0)
        ratio = follow / (emits.T @ joint @ emits)
        # every state, move and form counts a little more, so none is lost
        found = first + emits * (joint @ emits @ ratio.T + joint.T @ emits @ ratio) + 0.01 / FORMS
        start, joint = first.sum(axis=1) + 0.01, joint * (emits @ ratio @ emits.T) + 0.01
        start, joint, emits = start / start.sum(), joint / joint.sum(), found / found.sum(axis=1, keepdims=True)
    spread = emits * joint.sum(axis=1)[:, None]
    of_symbols = np.array([*range(FORMS), *map(form, model.frequent)], np.int64)
    share = np.concatenate([model.form_tokens + model.form_words + 1, model.counts + 1.0])
    emits = share * (spread / spread.sum(axis=0))[:, of_symbols]
    return replace(
        model, start=start, moves=joint / joint.sum(axis=1, keepdims=True), emits=emits / emits.sum(axis=1, keepdims=True)
    )


def train(
    df: DataFrame,
    counts: DataFrame,
    states: int = 4,
    max_frequent: int = 1 << 16,
    pair_rounds: int = 200,
    rounds: int = 2,
    sample_rounds: int | None = None,
) -> tuple[Model, DataFrame]:
    """A model of the texts of ``df`` (``text``), and the table of its other words.

    ``pair_rounds`` rounds over the counts of neighbouring forms in all texts find a starting point;
    ``rounds`` rounds (one at least) over all rows make the parameters. ``sample_rounds`` is what older
    callers call ``pair_rounds``; nothing is sampled. The table has
    ``word``, ``n`` (training count) and ``shares`` (of its states) of every word that is not frequent.
    """
    model = first_model(counts, states, max_frequent)
    if model.n_tokens:
        model = started(model, form_pairs(df), pair_rounds if sample_rounds is None else sample_rounds)
        for _ in range(rounds - 1):
            model = renewed(model, expected_rows(df, model, False))
    last = expected_rows(df, model, True).withColumn("shares", F.when(F.col("row") < 0, shares_of(states)))
    names = [f"s{k}" for k in range(states)]
    last = last.select("row", "word", "n", "shares", *[F.when(F.col("row") >= 0, F.col(x)).alias(x) for x in names])
    last = stored(last, "expected")
    words = last.where("row < 0").select("word", "n", "shares")
    return renewed(model, last, form_sums(words, states)[:, 2:]), words


def emissions_of(model: Model, forms: np.ndarray, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """P(word | state) of words that are not frequent: their forms, counts (0: unknown) and shares of states."""
    tokens, words = model.form_tokens[forms][:, None], model.form_words[forms][:, None]
    of_form = model.form_states[forms]
    expected = n[:, None] * shares
    # where a state has nothing of a form, the form's words are told apart by their counts
    there = of_form > 0
    ratio = np.where(there, tokens * expected / np.where(there, of_form, 1.0), n[:, None])
    return model.emits[:, forms].T * (ratio + 1) / (tokens + words + 1)


def score_texts(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    modulus: int = 7,
    held_out: int = 2,
    **training,
) -> DataFrame:
    """Scores of all texts by a model of those that are not held out.

    A row is held out if the crc32 of its id's text modulo ``modulus`` is ``held_out``; a
    null id counts as an empty text. Words are runs of signs other than ASCII white space,
    A-Z lower-cased; an end follows the last one. A null text is an empty one: its end is
    its only token. Returns per row ``id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-one unigrams) and ``score``. Repeated rows and
    equal texts are scored alike. Without training texts every state emits every form alike.
    ``training`` goes to :func:`train`.
    """
    rows = only(df, {"id": id_column, "text": text_column}).withColumn("text", F.col("text").cast("string"))
    rows = rows.withColumn("held_out", crc_remainder(F.col("id"), modulus) == held_out)
    training_rows = rows.where("NOT held_out")
    counts = stored(word_counts(training_rows), "counts")
    model, table = train(training_rows, counts, **training)
    shared = df.sparkSession.sparkContext.broadcast(vars(model))
    kind = rows.schema["id"].dataType.simpleString()
    n_symbols, states = model.emits.shape[1], len(model.start)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", SCORED_BYTES):
            tokens, index = [tokens_of(t) for t in bytes_of(batch, "text")], WordIndex(shared.value["frequent"])
            symbols = index.numbers(tokens).astype(np.int32)
            known = index.others()
            # words are numbered as they are met, so where one is new its number need not be written
            symbols[np.diff(np.maximum.accumulate(symbols).clip(n_symbols - 1), prepend=n_symbols - 1) > 0] = -1
            forms = pa.array([form(w) for w in known], pa.int16())
            ends = np.cumsum([0, *map(len, tokens)])
            rest = np.full(len(tokens) - 1, len(known))  # the slice's words are on its first row
            once = pa.array(np.concatenate([[0, len(known)], rest]), pa.int32())
            columns = [
                pa.array(np.full(len(tokens), number)),
                pa.array(np.arange(len(tokens))),
                batch.column("id"),
                batch.column("held_out"),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(symbols)),
                pa.ListArray.from_arrays(once, pa.array(known, pa.binary())),
                pa.ListArray.from_arrays(once, forms),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "row", "id", "held_out", "symbols", "words", "forms"])
            number += 1

    schema = f"slice bigint, row bigint, id {kind}, held_out boolean, symbols array<int>, words array<binary>, forms array<smallint>"
    texts = stored(rows.mapInArrow(numbered, schema), "numbered")
    asked = texts.where(F.size("words") > 0).select("slice", F.posexplode("words").alias("place", "word"))
    found = asked.join(table, "word").select(F.col("slice").alias("of_slice"), "place", "n", "shares")
    divisor = float(np.log10(model.n_tokens + model.n_words + 1))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        current, left = Model(**shared.value), left.sort_by("row")
        forms = pc.list_flatten(left.column("forms")).to_numpy().astype(np.int64)
        n, shares = np.zeros(len(forms)), np.full((len(forms), states), 1 / states)
        places = right.column("place").to_numpy()
        n[places] = right.column("n").to_numpy()
        if len(places):
            shares[places] = unpacked(right.column("shares").to_pylist(), states)
        symbols = pc.list_flatten(left.column("symbols")).to_numpy().astype(np.int64)
        new = symbols < 0
        symbols[new] = n_symbols + np.arange(new.sum())
        lengths = pc.list_value_length(left.column("symbols")).to_numpy().astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        known = np.concatenate([np.zeros(FORMS), current.counts, n])
        emits = np.vstack([current.emits.T, emissions_of(current, forms, n, shares)]).T
        base = np.add.reduceat(np.log10(known + 1)[symbols], starts) - lengths * divisor
        columns = {
            "id": left.column("id"),
            "held_out": left.column("held_out"),
            "n_tokens": lengths,
            "n_known": np.add.reduceat((known > 0)[symbols].astype(np.int64), starts),
            "base_score": base,
            "score": log_likelihoods(symbols, lengths, replace(current, emits=emits)),
        }
        return pa.table(columns)

    parts = texts.drop("words").groupBy("slice").cogroup(found.groupBy("of_slice"))
    out = parts.applyInArrow(
        scored, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return out.select(
        "id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
