"""Quality rules in a short-circuit cascade.

A text is kept if no rule rejects it. Rules differ in cost and in how many texts they
reject, so a sample is judged by every rule first, each timed by itself. The cascade
then asks the rules in the order of rejections per second among the texts that the
rules before them let pass, and stops at the first rejection. The order changes what a
text costs, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import bytes_of, free_name, only, slices, text_slices

SYMBOLS = b"#*$%&|<>"
NO_LETTERS = bytes(i for i in range(128) if not chr(i).isalpha())
WINDOW = 5


class Measures:
    """Counts of one text (UTF-8), each made when a rule first asks for it.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed
    and carriage return, which is what ``bytes.split`` gives.
    """

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, map(bytes.decode, self.words)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """The lines that have a word."""
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(len(words), bool)
        for i in range(WINDOW):
            covered[i : i + len(starts)] |= starts
        return int(covered.sum())

    @cached_property
    def dup_line_share(self) -> float:
        """The share of the lines' bytes that is in repetitions of earlier lines."""
        total = sum(map(len, self.lines))
        return 1 - sum(map(len, set(self.lines))) / total if total else 0.0

    @cached_property
    def n_letters(self) -> int:
        """Signs that are A-Z, a-z or beyond ASCII."""
        return len(self.data.translate(None, NO_LETTERS).decode())

    @cached_property
    def n_capital_words(self) -> int:
        """Words with two letters or more, all of them capitals."""
        return sum(w.isupper() and sum(map(str.isalpha, w)) > 1 for w in map(bytes.decode, self.words))

    @cached_property
    def n_stutters(self) -> int:
        """Words that repeat the word before them."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_top_word(self) -> int:
        """How often the most frequent word occurs."""
        return max(Counter(self.words).values(), default=0)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: The production rules. The first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
    Rule("symbols", lambda m: 100 * m.n_symbols > 10 * m.n_words),
    Rule("duplicate_lines", lambda m: m.dup_line_share > 0.3),
    Rule("capital_words", lambda m: 100 * m.n_capital_words > 30 * m.n_words),
    Rule("top_word", lambda m: m.n_words >= 20 and 100 * m.n_top_word > 30 * m.n_words),
    Rule("stutters", lambda m: 100 * m.n_stutters > 30 * m.n_words),
    Rule("few_letters", lambda m: 100 * m.n_letters < 50 * m.word_chars),
    Rule("long_words", lambda m: m.word_chars > 30 * m.n_words),
)


@dataclass(frozen=True)
class Estimate:
    """What the sample showed of a rule: seconds a text, share rejected of those that reach it."""

    rule: Rule
    seconds: float
    rejected: float


def estimate_cascade(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text", sample_rows: int = 2000
) -> list[Estimate]:
    """The rules in the order in which the cascade should ask them.

    About ``sample_rows`` rows are judged, where they lie: each is taken at a rate that follows
    from the number of rows. Tasks count verdict patterns (which rules reject), so the driver
    gets a row a pattern and task that has sampled rows. The verdicts of the cascade do not depend
    on the sample. With an empty sample the order is as given.
    """
    rate = sample_rows / max(1, df.count())
    sample = only(df if rate >= 1 else df.sample(rate, seed=7), {"text": text_column})

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Counter[int] = Counter()
        seconds = np.zeros(len(rules))
        for batch in slices(batches, "text"):
            for data in bytes_of(batch, "text"):
                pattern = 0
                for i, rule in enumerate(rules):
                    start = time.perf_counter()
                    pattern |= rule.rejects(Measures(data)) << i
                    seconds[i] += time.perf_counter() - start
                patterns[pattern] += 1
        rows = [(p, n, seconds.tolist() if i == 0 else None) for i, (p, n) in enumerate(patterns.items())]
        if not rows:
            return
        columns = list(zip(*rows))
        types = (pa.int64(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], names=["pattern", "n", "seconds"]
        )

    sample = sample.withColumn("text", F.col("text").cast("string"))
    found = sample.mapInArrow(judged, "pattern bigint, n bigint, seconds array<double>").collect()
    total = sum(row["n"] for row in found)
    seconds = np.sum([row["seconds"] for row in found if row["seconds"]], axis=0) if found else None
    left: Counter[int] = Counter()
    for row in found:
        left[row["pattern"]] += row["n"]
    waiting, order = list(range(len(rules))), []
    while waiting:
        reaching = sum(left.values())
        gains = {i: sum(n for p, n in left.items() if p >> i & 1) for i in waiting}
        cost = {i: max(seconds[i] / total, 1e-9) if total else 1.0 for i in waiting}
        best = max(waiting, key=lambda i: (gains[i] / cost[i], -cost[i], -i))
        order.append(Estimate(rules[best], cost[best], gains[best] / reaching if reaching else 0.0))
        waiting.remove(best)
        left = {p: n for p, n in left.items() if not p >> best & 1}
    return order


def quality_verdicts(
    df: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text_column: str = "text",
    order: list[Estimate] | None = None,
) -> DataFrame:
    """All rows and columns of ``df``, with a struct column of the cascade's verdict.

    The new column, named by :func:`verdict_column`, has ``kept`` and ``rejected_by`` (the
    rule at which the cascade stopped; null if kept; which of several rejecting rules
    it is follows from the order). A null text is an empty one. Repeated rows are judged
    alike. ``df`` may have any other columns.
    """
    order = order or estimate_cascade(df, rules, text_column)
    cascade = [(e.rule.name, e.rule.rejects) for e in order]

    @F.pandas_udf("struct<kept: boolean, rejected_by: string>")
    def verdict(texts):
        import pandas as pd

        stops = []
        for text in texts:
            measures = Measures(text.encode() if text else b"")
            stops.append(next((name for name, rejects in cascade if rejects(measures)), None))
        return pd.DataFrame({"kept": [s is None for s in stops], "rejected_by": stops})

    text = df[f"`{text_column}`"].cast("string")
    return df.withColumn(verdict_column(df), verdict(text))


def verdict_column(df: DataFrame) -> str:
    """``quality``, or the first of ``quality_``, ``quality__``, ... that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, "quality"
    while name in taken:
        name += "_"
    return name


def keep_quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that the cascade keeps, with the columns of ``df``. A null text is an empty one."""
    cascade = [e.rule.rejects for e in estimate_cascade(df, rules, text_column)]
    judged = free_name(df, "quality_text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, judged):
            good = [not any(rejects(m) for rejects in cascade) for m in map(Measures, texts)]
            yield batch.drop_columns([judged]).filter(pa.array(good, pa.bool_()))

    return df.withColumn(judged, df[f"`{text_column}`"].cast("string")).mapInArrow(kept, df.schema)


def quality_measures(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row the base counts, whether a base rule rejects it, and the cascade's verdict.

    Returns ``id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` and ``kept``. Null texts have no words and are
    rejected. Every row gives one row, repeated ones and those without id too.
    """
    order = estimate_cascade(df, rules, text_column)
    cascade = [e.rule.rejects for e in order]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = only(df, {"id": id_column, "text": text_column})
    rows = rows.withColumn("text", rows["text"].cast("string"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, failed, kept = [], [], []
            for data in bytes_of(batch, "text"):
                m = Measures(data)
                counts.append([getattr(m, name) for name in names])
                failed.append(m.n_words < 10 or 100 * m.n_repeat_words > 20 * m.n_words)
                kept.append(not failed[-1] and not any(rejects(m) for rejects in cascade))
            flat = np.fromiter(chain.from_iterable(counts), np.int64, len(names) * len(counts))
            columns = [pa.array(c) for c in flat.reshape(-1, len(names)).T.copy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=["id", *names, "base_failed", "kept"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{name} bigint" for name in names)
    return rows.mapInArrow(measured, f"id {kind}, {longs}, base_failed boolean, kept boolean")
