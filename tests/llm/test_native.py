"""License scans and URL filters: results, and plans without Python."""

import re

from cases import LONG, SF_DIR, awkward, empty, given

from foliospark.llm.license_scan import TEMPLATES, WIDTH, license_notices
from foliospark.llm.queries import QUERIES
from foliospark.llm.url_filter import RULES, Rule, judge_urls


def plain_words(text):
    return re.sub(r"[^\w]|_", " ", (text or "").lower()).split()


def shingles(words):
    return {tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}


def licenses_of(text):
    """Brute force: hits of each template, split into places where they are far apart; a place counts
    unless half of its hits are those of a template that is contained more."""
    words, places = plain_words(text), []
    at = [tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)]
    for number, (name, template) in enumerate(TEMPLATES):
        own, n = shingles(plain_words(template)), len(plain_words(template))
        hits = [i for i, s in enumerate(at) if s in own]
        while hits:
            here = [i for k, i in enumerate(hits) if all(b - a <= n for a, b in zip(hits[:k], hits[1 : k + 1]))]
            hits = hits[len(here) :]
            share = len({at[i] for i in here}) / len(own)
            if share >= 0.8:
                places.append((name, number, share, here))
    found = set()
    for name, number, share, here in places:
        beaten = {i for _, _, more, there in places if more > share for i in there}
        if 2 * len(beaten & set(here)) < len(here):
            found.add((name, number))
    return found


def test_license_query_finds_what_brute_force_finds(spark):
    got = {(r["doc_id"], r["license"]) for r in QUERIES["op2_license_scan"](spark, SF_DIR).collect()}
    want = {(i, name) for i, text in given("documents", "doc_id, text") for name, _ in licenses_of(text)}
    assert got == want and want


def test_notices_side_by_side(spark):
    texts = [
        "The work is licensed under the GNU General Public License, version 3. Released under the MIT License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Released under the BSD 3-Clause License, or licensed under the GNU Lesser General Public License, version 3, as you like.",
        "This project is licensed under the MIT License. " * 50 + "Licensed under the MIT License.",
        # the second place of a template stands, the first is the longer notice's
        "This project is licensed under the MIT License. " + LONG[:2000] + " All of it is licensed under the MIT License.",
        "This work is licensed under the GNU General Public License, version 2. "
        "This work was licensed under the GNU General Public License, version 3.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["id"], r["license"], r["template"]) for r in license_notices(df).collect()}
    assert got == {(i, *x) for i, text in enumerate(texts) for x in licenses_of(text)}
    names = {i: {name for j, name, _ in got if j == i} for i in range(len(texts))}
    assert names[0] == {"GPL-3.0", "MIT"} and names[1] == {"CC-BY-NC-SA-4.0"} and names[2] == {"BSD-3-Clause", "LGPL-3.0"}
    assert {t for i, _, t in got if i == 3} >= {2} and {t for i, _, t in got if i == 4} >= {1, 2}


def test_licenses_in_changed_and_long_texts(spark):
    mit, apache = TEMPLATES[3][1], TEMPLATES[5][1]
    changed = mit.replace("free of charge", "free of any charge")
    rows = [(1, LONG + "\n" + changed.upper() + "\n" + LONG), (2, "x y " + apache.replace(" ", "\n")), (3, mit[:60]), (None, apache), (4, mit), (4, mit)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["id"] or 0, r["license"]) for r in license_notices(df).collect())
    assert got == [(0, "Apache-2.0"), (1, "MIT"), (2, "Apache-2.0"), (4, "MIT")]


def test_license_awkward_rows(spark):
    assert license_notices(awkward(spark)).collect() == [] and license_notices(empty(spark)).collect() == []


def rule_of(host, path):
    best = None
    for rule in RULES:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path):
            if best is None or len(rule.name) > len(best.name):
                best = rule
    return best


def test_url_query_follows_the_rules(spark):
    rows = {r["page_id"]: r for r in QUERIES["op4_url_filter"](spark, SF_DIR).collect()}
    pages = given("pages", "page_id, url")
    assert len(rows) == len(pages)
    for page_id, url in pages:
        match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (match[1].lower(), match[2]) if match else ("", "")
        row, rule = rows[page_id], rule_of(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule.name if rule else None)
        assert row["verdict"] == rule.verdict if rule else row["verdict"] in ("allow", "block")


def test_trees_learn_from_ruled_urls(spark):
    rows = [(i, f"http://a{i}.good/news/{i % 7}") for i in range(300)]
    rows += [(1000 + i, f"http://b{i}.bad/win-cash-{i}{i}{i}.html?a=1&b=2&c={i}") for i in range(300)]
    rows += [(5000 + i, f"http://c{i}.new/news/{i % 5}") for i in range(20)]
    rows += [(6000 + i, f"http://d{i}.new/win-cash-{i}{i}{i}.html?a=1&b=2&c={i}") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = (Rule("allow", "good", "/"), Rule("block", "bad", "/"))
    got = {r["id"]: r for r in judge_urls(df, rules, trees=5).collect()}
    assert all(got[5000 + i]["verdict"] == "allow" and got[5000 + i]["rule"] is None for i in range(20))
    assert all(got[6000 + i]["verdict"] == "block" and got[6000 + i]["score"] > 0.5 for i in range(20))


def test_suffixes_are_counted_on_all_labelled_urls(spark):
    # the verdict of a domain is known from its own rows alone, most of which are not in the sample
    rows = [(i, f"http://d{i % 600:03}.com/{'ab'[i % 2]}/{i // 600}") for i in range(3000)]
    rows += [(5000 + i, f"http://d{i:03}.com/x/7") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = (Rule("allow", "com", "/a/"), Rule("block", "com", "/b/"))
    got = {r["id"]: r["verdict"] for r in judge_urls(df, rules, trees=10, sample_rows=200).collect()}
    right = sum(got[5000 + i] == ("allow", "block")[i % 2] for i in range(600))
    assert right > 570


def test_a_rare_verdict_is_not_lost_by_sampling(spark):
    hot = [(i, "http://hot.good/page") for i in range(500)]
    rows = hot + [(1000 + i, f"http://a{i}.good/news/{i}") for i in range(500)] + [(2000 + i, f"http://b{i}.bad/win/{i}") for i in range(2)]
    df = spark.createDataFrame([*rows, (9000, "http://c77.best/news/77")], "page_id bigint, url string")
    got = {r["id"]: r for r in judge_urls(df, (Rule("allow", "good", "/"), Rule("block", "bad", "/")), trees=2, sample_rows=20).collect()}
    assert len(got) == len(rows) + 1
    assert got[9000]["score"] is not None and got[9000]["verdict"] == "allow"


def test_url_awkward_rows(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/", "http://x.com?/en/", "a://b://c/d", "http://net/es/1", "http://\u00c9.NET/fr/#x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[5])] * 2, "page_id int, url string")
    df = df.selectExpr("*", "1 AS host", "2 AS label", "3 AS url_length")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, trees=2).collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[5] == got[None] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[6][:3] == ("x.com", "", None) and got[7][:3] == ("b:", "//c/d", None)
    assert got[8] == ("net", "/es/1", "net/es/", "block") and got[9][:3] == ("\u00c9.net", "/fr/", "net/fr/")
    assert judge_urls(df.limit(0)).collect() == []


def test_no_python_in_the_plans(spark):
    for name in ("op2_license_scan", "op4_url_filter"):
        text = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", text), name
