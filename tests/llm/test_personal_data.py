import hashlib
import random
import re
import time

from cases import SF_DIR, awkward, empty, given

from foliospark.llm.personal_data import base_spans, other_candidates, personal_data, reliabilities
from foliospark.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op7_personal_data"](spark, SF_DIR).collect()}
    for doc_id, text in given("documents", "doc_id, text"):
        spans, row = plain(text), rows[doc_id]
        joined = ",".join(":".join(map(str, s)) for s in spans)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert set(joined.split(",")) <= set(row["spans"].split(",")) or not joined
        tokens = [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', text)]
        assert [f"secret:{a}:{b}" for a, b in tokens] == [s for s in row["spans"].split(",") if s.startswith("secret")]


def test_base_spans_equal_the_patterns_on_chance_texts():
    chance = random.Random(2)
    for _ in range(3000):
        text = "".join(chance.choice("ab1290..@@+-- ()%255") for _ in range(chance.randint(0, 60)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_no_quadratic_time():
    for text in ("a" * 300_000 + " @", "1" * 300_000, "+1" * 100_000, "a.b@" * 50_000, "1." * 100_000):
        base_spans(text)


def test_other_kinds_equal_brute_force_in_linear_time():
    chance = random.Random(6)
    pieces = ["123-45-6789", "DE89370400440532013000", "a" * 19 + "7", "0123456789abcdef" * 2, "x@y.zz", " ", "-", "9", "GB00", "=", "/"]
    patterns = {"iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
                "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}"}
    for _ in range(2000):
        text = "".join(chance.choice(pieces) for _ in range(chance.randint(1, 12)))
        taken = base_spans(text)
        used, want = [s[1:] for s in taken], []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                mixed = re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
                if (kind != "secret" or mixed) and all(b <= m.start() or m.end() <= a for a, b in used):
                    used.append(m.span())
                    want.append((kind, *m.span()))
        assert sorted(other_candidates(text, taken)) == sorted(want), text
    for text in ("123-45-6789 " * 80_000, ("a.b@c.de token=" + "0123456789abcdef" * 2 + " ") * 20_000):
        start = time.process_time()
        assert len(other_candidates(text, base_spans(text))) >= 20_000
        assert time.process_time() - start < 10


def test_reliabilities_follow_agreement():
    # the first two labelers agree, the third votes by chance
    patterns = {"yyn---mp": 45, "yyy---mp": 45, "nnn---mp": 45, "nny---mp": 45, "yny---mp": 5, "nyn---mp": 5}
    truth, table = reliabilities(patterns)
    assert truth["yyn---mp"] > 0.9 and truth["nny---mp"] < 0.1
    assert table[1, 0, 0] > 0.85 and table[0, 1, 1] > 0.85 and 0.3 < table[1, 2, 0] < 0.7


def test_awkward_rows(spark):
    rows = personal_data(awkward(spark)).collect()
    assert len(rows) == 14 and all(r["spans"] == [] for r in rows)
    assert personal_data(empty(spark)).collect() == []
    text = "\U0001f600 mail a@b.co and 1.2.3.4"
    out = personal_data(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in out["spans"]] == [("email", "a@b.co", True), ("ip", "1.2.3.4", True)]
