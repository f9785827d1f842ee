"""Personal data in texts: patterns, labelers whose reliability is learned, and a span classifier.

Candidates come from patterns. Labelers - form and checksum, gazetteer, context words,
assignment, variety of signs, edges - each vote yes, no or nothing on a candidate.
Expectation-maximisation over how often each pattern of votes occurs in the whole corpus
estimates how reliable every labeler is, kind by kind, without labels. The probabilities it
gives train a logistic regression over votes, length and the sign after the span, which
judges the candidates. Spans of the base patterns stay whatever it says; of the other kinds
it decides.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import only, slices, texts_of

#: Kinds in the order in which spans are listed; the first four are the base.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "ssn", "iban")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does, so the look-behind changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"[0-9a-fA-F]{32,}")

# Words and prefixes that speak for or against a kind.
CONTEXT = {
    "email": ("mail", "contact", "write to", "e-mail"),
    "ip": ("ip", "server", "host", "address", "from"),
    "card": ("card", "visa", "mastercard", "amex", "payment"),
    "phone": ("call", "phone", "tel", "mobile", "fax"),
    "secret": ("token", "key", "secret", "password", "passwd", "credential", "auth"),
    "ssn": ("ssn", "social security"),
    "iban": ("iban", "account", "bank"),
}
AGAINST = ("sha", "md5", "checksum", "commit", "isbn", "version", "hash", "order", "part no")
GAZETTEER = {
    "email": (".com", ".org", ".net", ".edu", ".gov", ".io", ".de", ".fr", ".es", ".uk"),
    "card": ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "62", "35"),
    "phone": ("+1", "+33", "+34", "+39", "+44", "+49", "+61", "+81", "+86", "+91"),
    "secret": ("AKIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza"),
    "iban": ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, sign in enumerate(reversed(digits)):
        value = int(sign) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """From each ``@`` to both sides, which takes time in proportion to the text."""
    done = 0
    for match in _DOMAIN.finditer(text):
        at = start = match.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = match.end()
            yield ("email", start, done)


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind and start."""
    found = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def other_candidates(text: str, taken: list[Span]) -> list[Span]:
    """Candidates of the other kinds that overlap no base span and none before them."""
    if not _DIGIT.search(text):
        return []
    found: list[Span] = []
    for m in _SECRET.finditer(text):
        s = m.group()
        if _DIGIT.search(s) and any(c.isalpha() for c in s):
            found.append(("secret", *m.span()))
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    found += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    free: list[Span] = []
    used = _united((a, b) for _, a, b in taken)
    for kind in ("iban", "ssn", "secret"):
        starts = [a for a, _ in used]
        new = []
        for span in found:
            if span[0] == kind:
                before = bisect_left(starts, span[2]) - 1
                if before < 0 or used[before][1] <= span[1]:
                    new.append(span)
        free += new
        used = _united([*used, *((a, b) for _, a, b in new)])
    return sorted(free, key=lambda s: (KINDS.index(s[0]), s[1]))


def _united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def votes(text: str, span: Span) -> str:
    """The labelers' votes (``y``, ``n``, ``-``), then a class of the length and of the sign after the span."""
    kind, start, end = span
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 1]
    digits = _digits(s)
    before = left.lower()
    if kind == "iban":
        moved = s[4:] + s[:4]
        form = "y" if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else "n"
    elif kind == "ssn":
        form = "n" if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else "y"
    elif kind == "secret":
        form = "y" if _HEX.fullmatch(s) else "n" if len(set(s)) < 8 else "-"
    else:
        form = "y"
    known = GAZETTEER.get(kind, ())
    if kind == "email":
        listed = "y" if s.lower().endswith(known) else "n"
    elif kind in ("ip", "ssn"):
        listed = "n" if s.startswith(("0.", "127.", "255.")) or s in ("078-05-1120", "219-09-9999") else "-"
    else:
        listed = "y" if s.startswith(known) else "-" if kind == "secret" else "n"
    context = "y" if any(w in before for w in CONTEXT[kind]) else "n" if any(w in before for w in AGAINST) else "-"
    assigned = "y" if left.rstrip(" \"'")[-1:] in ("=", ":") else "-"
    variety = "n" if len(set(digits or s)) < 3 else "y" if len(set(s)) > 7 else "-"
    edge = "n" if (left[-1:].isalnum() or right.isalnum()) else "-"
    length = "s" if len(s) < 12 else "m" if len(s) < 24 else "l" if len(s) < 64 else "x"
    after = "0" if not right else "q" if right in "\"'" else "s" if right.isspace() else "p"
    return form + listed + context + assigned + variety + edge + length + after


_VOTES = "yn-"
_N_VOTES = 6


def reliabilities(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """EM over the vote patterns of one kind: each pattern's probability, and P(vote | truth) by labeler."""
    keys = list(patterns)
    codes = np.array([[_VOTES.index(v) for v in k[:_N_VOTES]] for k in keys])
    weights = np.array([patterns[k] for k in keys], float)
    balance = (codes == 0).sum(axis=1) - (codes == 1).sum(axis=1)
    truth = 1 / (1 + np.exp(-2.0 * balance))
    table = np.zeros((2, _N_VOTES, 3))
    for _ in range(rounds):
        for y, share in enumerate((1 - truth, truth)):
            for j in range(_N_VOTES):
                # a labeler is taken to be right more often than wrong before anything is seen
                prior = np.array([0.5, 1.5, 1.0] if y == 0 else [1.5, 0.5, 1.0])
                counted = np.bincount(codes[:, j], weights * share, 3) + prior
                table[y, j] = counted / counted.sum()
        rate = (weights @ truth + 1) / (weights.sum() + 2)
        logs = np.log(table[:, np.arange(_N_VOTES)[None, :], codes]).sum(axis=2)
        odds = np.clip(logs[1] - logs[0] + np.log(rate / (1 - rate)), -60, 60)
        truth = 1 / (1 + np.exp(-odds))
    return dict(zip(keys, truth.tolist())), table


def _features(pattern: str) -> np.ndarray:
    parts = [np.eye(3)[_VOTES.index(v)] for v in pattern[:_N_VOTES]]
    parts += [np.eye(4)["smlx".index(pattern[-2])], np.eye(4)["0qsp".index(pattern[-1])], np.ones(1)]
    return np.concatenate(parts)


def classifier(patterns: dict[str, int], truth: dict[str, float], steps: int = 400) -> np.ndarray:
    """Weights of a logistic regression that agrees with the probabilities, counted by pattern."""
    x = np.stack([_features(k) for k in patterns])
    n = np.array(list(patterns.values()), float)
    y = np.array([truth[k] for k in patterns])
    weights, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= 2.0 * (x.T @ (share * (p - y)) + 1e-4 * weights)
    return weights


def vote_patterns(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``kind``, ``pattern`` and ``n`` over all candidates of the corpus: some thousand rows at most."""
    rows = only(df, {"text": text_column}).withColumn("text", F.col("text").cast("string"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        for batch in slices(batches, "text"):
            for text in texts_of(batch, "text"):
                base = base_spans(text)
                counts.update((s[0], votes(text, s)) for s in [*base, *other_candidates(text, base)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in counts], pa.string()),
                pa.array([p for _, p in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["kind", "pattern", "n"],
        )

    schema = "kind string, pattern string, n bigint"
    return rows.mapInArrow(counted, schema).groupBy("kind", "pattern").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text_column: str = "text") -> dict[str, np.ndarray]:
    """The classifier's weights by kind; kinds without candidates have none."""
    rows = sorted(vote_patterns(df, text_column).collect())
    model = {}
    for kind, group in groupby(rows, key=lambda r: r["kind"]):
        patterns = {r["pattern"]: r["n"] for r in group}
        model[kind] = classifier(patterns, reliabilities(patterns)[0])
    return model


def personal_data(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The spans of personal data in every text.

    Returns per row ``id`` and ``spans``, an array of ``kind``, ``start``, ``end`` (code points,
    end exclusive), ``base`` (found by a base pattern) and ``probability`` (the classifier's), by
    kind and start. Other spans than base ones need a probability of ``threshold``. Texts are
    searched whole. Null and empty texts have no spans. Repeated rows, and rows without id, are
    rows like any other.
    """
    model = df.sparkSession.sparkContext.broadcast(train(df, text_column))
    rows = only(df, {"id": id_column, "text": text_column}).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["id"].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.value, {}

        def probability(text, span):
            key = (span[0], votes(text, span))
            if key not in known:
                known[key] = float(1 / (1 + np.exp(-_features(key[1]) @ weights[key[0]])))
            return known[key]

        for batch in slices(batches, "text"):
            lists = []
            for text in texts_of(batch, "text"):
                base = base_spans(text)
                spans = [(*s, True, probability(text, s)) for s in base]
                others = [(*s, False, probability(text, s)) for s in other_candidates(text, base)]
                spans += [s for s in others if s[4] >= threshold]
                lists.append([dict(zip(("kind", "start", "end", "base", "probability"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists, pa.list_(struct))], names=["id", "spans"])

    spans = "array<struct<kind: string, start: int, end: int, base: boolean, probability: double>>"
    return rows.mapInArrow(found, f"id {kind}, spans {spans}")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
