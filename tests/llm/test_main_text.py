import html
import random
import re
import time

from cases import SF_DIR, given

from foliospark.llm.main_text import LONGEST_PATH, Matching, best_path, extract, main_texts, parse, scores, text_at
from foliospark.llm.queries import QUERIES


def test_query_equals_the_article_of_the_pages(spark):
    rows = {r["page_id"]: r for r in QUERIES["op3_main_text"](spark, SF_DIR).collect()}
    for page_id, url, page in given("pages", "page_id, url, html"):
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"<(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (rows[page_id]["url"], rows[page_id]["text"], rows[page_id]["n_chars"]) == (url, want, len(want))


PAGE = """<html><body><div id="cookie-notice">We use cookies</div><header class="top"><h1>Site</h1></header>
<div class="wrap"><div class="sidebar"><p>side</p></div><div class="post-content n7"><h2>T &amp; x</h2>
<p>One two three four five <a href="x>y">link</a> more text here &lt;ok&gt; a < b.<p>Second&nbsp;para
<script>var a="<p>no</p>";</script> ends<br>here.<ul><li>item one<li>item two</ul>
<div class="comments"><p>a reader wrote much more text in the comments than the article has, and more</p></div>
<form><p>mail</p></form><!-- <p>gone</p> --></div></div><footer>foot</footer></body></html>"""
TEXT = "T & x\nOne two three four five link more text here <ok> a < b.\nSecond para ends here.\nitem one\nitem two"


def test_what_is_not_the_article_is_left_out():
    assert extract(PAGE, None) == (TEXT, False)
    assert extract(PAGE, ">html>body>div.wrap>div.n#.post-content") == (TEXT, True)
    assert extract(PAGE, ">html>body>nowhere") == (TEXT, False)


def test_broken_pages():
    for page in ("", "<", "<p", "no markup at all", "<p>a<b>c", "</div></p>x", "<!-- open", "<script>x", "<div" * 1000, "<a b='" * 500):
        parse(page)
    assert extract("plain words", None)[0] == "plain words"
    assert extract("<p>a<b>b</p><p>c", None)[0] == "ab\nc"
    parse("<p " + "\"'" * 100_000)


def test_long_and_broken_pages_take_no_quadratic_time():
    n = 1 << 20
    pages = {
        "menus never closed": "<nav>x" * (n // 6), "nested": "<div>x" * (n // 6), "stray end tags": "<div>" * (n // 11) + "</b>" * (n // 11),
        "inline around items": "<b><li></li>" * (n // 12), "end tags behind a barrier": "<b><article>" + "<i>" * (n // 7) + "</b>" * (n // 7),
        "tags without end": "<a " * (n // 3), "nested with classes": "<div class='abc'>x" * (n // 18), "rules": "<b><hr>x" * (n // 8),
        "closed": "<div><p>x" * (n // 20) + "</div>" * (n // 20),
    }
    for name, page in pages.items():
        start = time.process_time()
        blocks, nodes = parse(page)
        found = scores(blocks, nodes)
        text_at(blocks, nodes, best_path(found) or "")
        assert time.process_time() - start < 10, name
        assert sum(map(len, found)) <= (LONGEST_PATH + 1) * len(found)


def test_end_tags_are_matched_as_by_counting():
    chance = random.Random(4)
    for _ in range(300):
        page = "".join(chance.choice(["<nav>", "</nav>", "<nav a='<nav>'>", "</NAV", "x", "<p>", ">"]) for _ in range(30))
        pairs = Matching(page, "nav")
        for m in re.finditer("<nav[^>]*>", page):
            depth, want = 1, None
            for t in re.compile(r"<(/?)nav(?=[\s/>])", re.I).finditer(page, m.end()):
                depth += -1 if t[1] else 1
                if not depth:
                    want = page.find(">", t.end()) + 1 or len(page)
                    break
            assert pairs.past(m.end()) == want


def test_hosts_agree_on_a_path(spark):
    """One page's own best container is not its article; its host's other pages put it right."""
    usual = "<body><div class='page-{0}'><p>{1}</p></div><div class='links'><p>{2}</p></div></body>"
    rows = [(i, "http://H.example/a", usual.format(i, "article text " * 30, "short")) for i in range(6)]
    rows.append((9, "http://h.example/b", usual.format(9, "brief article", "long other text " * 40)))
    rows.append((10, None, usual.format(9, "brief article", "long other text " * 40)))
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["id"]: r for r in main_texts(df).collect()}
    assert got[9]["text"] == "brief article" and got[9]["by_host"]
    assert got[10]["text"].startswith("long other") and not got[10]["by_host"]


def test_awkward_rows(spark):
    rows = [(1, None, None), (None, "http://a/", "<p>x</p>"), (2, "http://a/", ""), (2, "http://a/", ""), (3, "nowhere", "<p>y " + "z " * 100_000)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS id")
    got = main_texts(df).collect()
    assert sorted((r["text"][:3], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("", 0), ("x", 1), ("y z", 200_001)]
    assert main_texts(df.limit(0)).collect() == []
