"""The main text of web pages, by container paths on which the pages of a host agree.

First every page scores its containers: a block of text counts for the container it stands
in, half for the next one outwards, and so on; links count against it, and what menus,
adverts, forms, comments and their like hold does not count at all. A container is named by
its path of tags and classes, digits generalised. The scores are votes, which Spark sums by
host and path. Then every page is read again, and the text of the containers at its host's
winning path is taken; a page without that path gives its own best container.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import only, slices, stored, texts_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"[0-9]+")
_NAME_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# HTML elements by their role.
RAW = frozenset("script style title textarea xmp iframe noframes".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset(
    "head nav footer aside form script style title textarea xmp iframe noframes noscript template button select "
    "svg math object canvas audio video dialog menu datalist".split()
)
CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr th caption figure figcaption "
    "address header hgroup hr details summary fieldset legend nav footer aside form".split()
)
SELF_CLOSING = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    }
#: Words in classes, ids and roles that mark what is not the main text.
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side menu nav "
    "navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay comment "
    "comments disqus reply replies respond share sharing social related recommended newsletter subscribe signup footer "
    "masthead widget toolbar pagination pager skip search login contentinfo complementary dialog aside".split()
)
#: Words that speak for a container.
TOWARDS = frozenset("article content entry post story text body main".split())
#: Characters of the longest path that is kept as it is.
LONGEST_PATH = 512
_OPENS_TO_THE_END = re.compile(r"<!--|<!\[CDATA\[")
_P = frozenset({"p"})
_HOLDS = CONTAINERS | {"ul", "ol", "table", "dl"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


@dataclass
class Node:
    path: str
    parent: int
    bonus: float


@dataclass
class Block:
    tag: str
    node: int
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _same_tag(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])", re.IGNORECASE)


def _words(value: str) -> set[str]:
    return set(_NAME_PART.findall(_CAMEL.sub(" ", value).lower()))


def _attributes(rest: str) -> dict[str, str]:
    if "=" not in rest and not rest.strip(" /\t\r\n"):
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _is_away(tag: str, own: dict[str, str], inside_article: bool) -> bool:
    if tag in OUTSIDE or (tag == "header" and not inside_article):
        return True
    if not own or tag in ("html", "body"):
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        return True
    names = _words(" ".join((own.get("class", ""), own.get("id", ""), own.get("role", ""))))
    return bool(names & AWAY) and tag not in ("main", "article") or bool(names & {"comment", "comments", "reply", "teaser", "related"})


def path_of(parent: str, step: str) -> str:
    """The path of a container; where it gets long, a digest stands for it, so that no path is."""
    path = f"{parent}>{step}"
    if len(path) > LONGEST_PATH:
        path = "#" + hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=16).hexdigest()
    return path


class Matching:
    """The end tags of one name, found in one pass over the page."""

    def __init__(self, page: str, tag: str):
        self.page = page
        self.starts, self.ends, self.level = [], [], [0]
        self.closing: dict[int, list[int]] = defaultdict(list)  # tags that end a level, by the level after them
        for i, m in enumerate(_same_tag(tag).finditer(page)):
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.level.append(self.level[-1] + (-1 if m[1] else 1))
            if m[1]:
                self.closing[self.level[-1]].append(i)

    def past(self, start: int) -> int | None:
        """Behind the end tag that closes an element begun before ``start``, if there is one."""
        first = bisect_left(self.starts, start)
        candidates = self.closing.get(self.level[first] - 1, [])
        at = bisect_left(candidates, first)
        if at == len(candidates):
            return None
        done = self.page.find(">", self.ends[candidates[at]])
        return len(self.page) if done < 0 else done + 1


def parse(page: str) -> tuple[list[Block], list[Node]]:
    """The blocks of text outside of what is put away, in page order, and the containers they stand in."""
    nodes = [Node("", -1, 1.0)]
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, container, in an article
    node, inside, links = 0, False, 0
    block: Block | None = None
    open_at: dict[str, list[int]] = defaultdict(list)  # where in the stack the elements of a name are
    open_blocks: list[str] = []
    pairs: dict[str, Matching] = {}

    def text(value: str) -> None:
        nonlocal block
        if not value:
            return
        if block is None:
            if value.isspace():
                return
            block = Block(open_blocks[-1] if open_blocks else "", node)
            blocks.append(block)
        value = html_entities.unescape(value) if "&" in value else value
        block.parts.append(value)
        if links:
            block.link_chars += len(value)

    def pop_to(depth: int) -> None:
        nonlocal node, inside, block, links
        for tag, _, _ in stack[depth:]:
            open_at[tag].pop()
            if tag in BLOCKS:
                block = None
                open_blocks.pop()
            elif tag == "a":
                links -= 1
        del stack[depth:]
        node, inside = stack[-1][1:] if stack else (0, False)

    def innermost(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    at, end, last_tag = 0, len(page), page.rfind(">")
    while at < end:
        if at > last_tag:  # no tag ends any more
            rest = _OPENS_TO_THE_END.search(page, at)
            text(page[at : rest.start() if rest else end])
            if rest and rest[0] != "<!--":
                text(page[rest.end() :].removesuffix("]]>"))
            break
        match = _TOKEN.search(page, at)
        if match is None:
            text(page[at:])
            break
        text(page[at : match.start()])
        at = match.end()
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            if match[0].startswith("<![CDATA["):
                text(match[0][9:].removesuffix("]]>"))
            continue
        if match["close"] or match["close2"]:
            depth = innermost((tag,))
            if depth >= 0 and (tag in BLOCKS or depth >= innermost(("article", "body", "td"))):
                pop_to(depth)
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            if close is None:
                break
            done = page.find(">", close.end())
            at = end if done < 0 else done + 1
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in EMPTY:
            if tag == "hr":
                block = None
            continue
        is_block = tag in BLOCKS
        if is_block:
            block = None
            closed = SELF_CLOSING.get(tag, _P)
            while (depth := max(innermost(closed), innermost(_P))) >= max(0, innermost(_HOLDS)):
                pop_to(depth)
                if tag != "tr":
                    break
        rest = match["rest"] if match["tag"] else match["rest2"]
        own = _attributes(rest)
        if _is_away(tag, own, inside):
            if tag not in pairs:
                pairs[tag] = Matching(page, tag)
            after = pairs[tag].past(at)
            # an element that is never closed ends with its start tag, as far as its text goes
            at = at if after is None else after
            continue
        if tag in CONTAINERS:
            named = own.get("class", "")
            names = "".join("." + c for c in sorted(_DIGITS.sub("#", named).split())) if named else ""
            bonus = 3.0 if tag in ("article", "main") or own.get("itemprop") == "articleBody" else 1.0
            if bonus == 1.0 and own and _words(named + " " + own.get("id", "")) & TOWARDS:
                bonus = 1.5
            nodes.append(Node(path_of(nodes[node].path, tag + names), node, bonus))
            node = len(nodes) - 1
            inside = inside or tag in ("article", "main")
        if rest.endswith("/") and not is_block and tag != "a":
            continue
        if tag == "a":
            links += 1
        open_at[tag].append(len(stack))
        if is_block:
            open_blocks.append(tag)
        stack.append((tag, node, inside))
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text], nodes


def scores(blocks: list[Block], nodes: list[Node]) -> dict[str, float]:
    """How much of the text each path holds: of a container's score half counts for the one around it."""
    held = [0.0] * len(nodes)
    for block in blocks:
        held[block.node] += max(0, len(block.text) - 2 * block.link_chars)
    found: dict[str, float] = defaultdict(float)
    for i in range(len(nodes) - 1, -1, -1):  # a container comes after the one around it
        if held[i] > 0:
            found[nodes[i].path] += held[i] * nodes[i].bonus
            if nodes[i].parent >= 0:
                held[nodes[i].parent] += held[i] / 2
    return found


def best_path(found: dict[str, float]) -> str | None:
    return max(found, key=lambda p: (found[p], -len(p), p), default=None)


def text_at(blocks: list[Block], nodes: list[Node], path: str) -> str:
    """The blocks in containers at ``path``, with headings that stand before them in the same parent."""
    inside = [False] * len(nodes)
    parents = set()
    for i, node in enumerate(nodes):
        inside[i] = node.path == path or (node.parent >= 0 and inside[node.parent])
        if node.path == path:
            parents.add(node.parent)
    taken, begun = [], False
    for block in blocks:
        if inside[block.node]:
            begun = True
            taken.append(block.text)
        elif not begun and block.tag == "h1" and block.node in parents:
            taken.append(block.text)
    return "\n".join(taken) if begun else ""


def extract(page: str, agreed: str | None) -> tuple[str, bool]:
    """The main text, and whether it comes from the host's path."""
    blocks, nodes = parse(page)
    if agreed is not None and (text := text_at(blocks, nodes, agreed)):
        return text, True
    own = best_path(scores(blocks, nodes))
    return (text_at(blocks, nodes, own) if own is not None else ""), False


def host_of(url):
    """The host of a URL column; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_votes(rows: DataFrame) -> DataFrame:
    """``host``, ``path``, ``votes``: of every page each path's share of the best path's score, summed."""

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            votes: dict[tuple[str, str], float] = defaultdict(float)
            for host, page in zip(batch.column("host").to_pylist(), texts_of(batch, "html")):
                found = scores(*parse(page))
                top = max(found.values(), default=0.0)
                for path, score in found.items():
                    votes[host, path] += score / top
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in votes], pa.string()),
                    pa.array([p for _, p in votes], pa.string()),
                    pa.array(list(votes.values()), pa.float64()),
                ],
                names=["host", "path", "votes"],
            )

    given = rows.where("host <> ''").select("host", "html")
    summed = given.mapInArrow(voted, "host string, path string, votes double").groupBy("host", "path")
    return summed.agg(F.round(F.sum("votes"), 6).alias("votes"))


def main_texts(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The main text of every page.

    Returns per row ``id``, ``url``, ``text``, ``n_chars`` and ``by_host`` (whether the host's
    path gave the text). Character references are decoded, white space in a block is one
    space, blocks are joined by a line break, in page order. A null or empty page has the
    empty text. Pages without a host agree with no other. Repeated rows, and rows without id, are
    rows like any other. Of paths with the same votes the last by name wins.
    """
    rows = only(df, {"id": id_column, "url": url_column, "html": html_column})
    rows = rows.select("id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    votes = path_votes(rows).groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("agreed"))
    agreed = stored(votes, "agreed")
    both = rows.join(agreed, "host", "left").select("id", "url", "html", "agreed")
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("id", "url")}

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [extract(*x) for x in zip(texts_of(batch, "html"), batch.column("agreed").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("url"),
                    pa.array([t for t, _ in found], pa.string()),
                    pa.array([len(t) for t, _ in found], pa.int64()),
                    pa.array([h for _, h in found], pa.bool_()),
                ],
                names=["id", "url", "text", "n_chars", "by_host"],
            )

    return both.mapInArrow(extracted, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint, by_host boolean")
