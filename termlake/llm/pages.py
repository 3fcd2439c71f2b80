"""Main text of web pages by consensus host paths.

Each page's containers are scored; the path of its best one, in tags and classes without digits, is a vote for its host;
Spark counts the votes; each page is then extracted again from the containers on its host's winning path.  Words in class
names speak against an element only as far as its host's pages agree, but for names made of such words alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

#: Up to so many characters the hosts' paths are broadcast; beyond it they are joined by salted keys.
BROADCAST_BYTES = 20_000_000
SALTS = 32

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select title canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center div main section td".split())
BOILERPLATE = frozenset("aside button dialog fieldset footer form head label menu nav search".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WHOLE = frozenset(("article", "main"))
#: Words in class names and ids that speak against an element.  A name of such words alone is a strong mark, one that has
#: other words too a weak one: it counts only where most pages of the host have an element on this path.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus feedback "
    "footer form login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promotion promoted "
    "recommendations recommended related replies reply respond share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Words that make no name weaker: parts of a page, and whose or which text it is about.
NEUTRAL = frozenset(
    "area article articles bar blog block body bottom box button buttons container content count entry guest icon icons inner item items latest left link links list main new "
    "outer page post posts reader readers right section site stories story thread threads top user users visitor visitors wrap wrapper".split()
)
#: Of the marks those of what readers write.
TALK = frozenset("comment comments commentlist disqus feedback replies reply respond".split())
#: A weak mark is a strong one where so much of the element's text stands in links, or, of readers' words, where so many
#: parts of one shape stand in it.
LINKED, ALIKE = 0.5, 2
#: Marks that count outside an article only, as articles have headers of their own.
HEADERS = frozenset(("header", "topbar"))
WEAK, STRONG = 1, 2
#: Pages that a host needs before weak marks count, and the share of them that have the path.
VOTERS, SHARE = 3, 0.5
#: Value of text under a strong mark, and under a weak one, when containers are scored.
DOUBT = {STRONG: 0.01, WEAK: 0.5, 0: 1.0}
#: A path longer than this goes on from its hash, so that deep pages take no more.
LONG_PATH = 1000
#: An open element that the start of another ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile("[>\"']")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_DIGITS = re.compile(r"[0-9]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    """A container or marked block: its parent's number, its generalised path, whether it is an article's whole, its mark."""

    parent: int
    path: str
    whole: bool
    mark: int = 0
    container: bool = True
    score: float = 0.0


@dataclass(slots=True)
class Open:
    tag: str
    node: int
    junk: bool
    link: bool
    whole: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """The page's pieces in order: ("text", text, ""), ("open", tag, attributes), ("close", tag, "").

    Comments, declarations and elements without running text are left out.  A tag ends at the first > outside quotes, or,
    if quotes leave none, at the first > at all.  One pass: what was found to have no end is not searched again.
    """
    pos, size = 0, len(html)
    dead: set[int] = set()  # places after a quoted value from which no > outside quotes follows
    unclosed: set[str] = set()

    def tag_end(at: int) -> int:
        seen, now = [], at
        while now not in dead:
            seen.append(now)
            m = _SPECIAL.search(html, now)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            close = html.find(m[0], m.end())
            if close < 0:
                break
            now = close + 1
        dead.update(seen)
        return html.find(">", at)

    while pos < size:
        at = html.find("<", pos)
        if at < 0:
            yield "text", html[pos:], ""
            return
        if at > pos:
            yield "text", html[pos:at], ""
        closing = html.startswith("/", at + 1)
        name = _NAME.match(html, at + 2 if closing else at + 1)
        if name is None:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 2)
                pos = size if end < 0 else end + 3
            elif html.startswith("<![CDATA[", at):
                end = html.find("]]>", at)
                pos = size if end < 0 else end + 3
            elif closing or html.startswith(("!", "?"), at + 1):
                end = html.find(">", at)
                pos = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                pos = at + 1
            continue
        tag = name[0].lower()
        end = html.find(">", name.end()) if closing else tag_end(name.end())
        if end < 0:  # the page ends inside a tag
            return
        pos = end + 1
        if closing:
            yield "close", tag, ""
            continue
        if tag in RAW and tag not in unclosed:
            close = _CLOSE[tag].search(html, pos)
            if close is not None:
                end = html.find(">", close.end())
                pos = size if end < 0 else end + 1
                continue
            if tag in ("script", "style"):
                return
            unclosed.add(tag)
        if tag not in RAW:
            yield "open", tag, html[name.end() : end]


def _mark(names: str, whole: bool) -> int:
    """The mark that class names and an id give an element."""
    mark = 0
    for name in names.split():
        words = [w for w in _PARTS.split(_HUMPS.sub("-", name).lower()) if w and not w.isdigit()]
        against = [w in MARKS or (not whole and w in HEADERS) for w in words]
        if any(against):
            mark = max(mark, STRONG if all(x or w in NEUTRAL for x, w in zip(against, words, strict=True)) else WEAK)
    return mark


def parse(html: str) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """All containers and marked blocks and, in page order, all blocks of text outside boilerplate as (node, text, characters in links)."""
    nodes = [Node(-1, "", False)]
    blocks: list[tuple[int, str, int]] = []
    stack = [Open("", 0, False, False, False)]
    held: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((stack[-1].node, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        gone = stack[depth:]
        if any(o.tag in BLOCKS for o in gone):
            flush()
        for o in gone:
            held[o.tag] -= 1
        del stack[depth:]

    for kind, tag, raw in tokens(html):
        if kind == "text":
            top = stack[-1]
            if not top.junk:
                text = unescape(tag) if "&" in tag else tag
                parts.append(text)
                if top.link:
                    linked += len(text)
            continue
        if kind == "close":
            if not held[tag]:
                if tag in BLOCKS:
                    flush()
                continue
            depth = len(stack) - 1
            while stack[depth].tag != tag:
                depth -= 1
            close(depth)
            continue
        top, block = stack[-1], tag in BLOCKS
        if block:
            for depth in range(len(stack) - 1, 0, -1) if held["p"] else ():  # a block ends an open paragraph
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCKS:
                    break
            if tag in ENDS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in SCOPES[tag]:
                        break
                    if stack[depth].tag in ENDS[tag]:
                        close(depth)
                        break
            if tag in ("body", "html") and held[tag]:
                continue
            flush()
            top = stack[-1]
        if tag in VOID:
            if tag == "br" and not top.junk:
                parts.append(" ")
            continue
        junk, node, whole, mark = top.junk, top.node, top.whole, 0
        classes = ""
        if tag in BOILERPLATE or (tag == "header" and not whole):
            junk = True
        if raw and not junk and not raw.isspace():
            a = _attributes(raw)
            if a:
                classes = a.get("class", "")
                role = a.get("role", "").lower()
                junk = role in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").lower().replace(" ", "")
                if tag not in ("body", "html"):
                    mark = _mark(f"{classes} {a.get('id', '')}", whole)
                    if not block:  # a mark inside a line
                        junk, mark = junk or mark == STRONG, 0
                whole = whole or role == "main"
        if not junk and (mark or tag in CONTAINERS):
            names = sorted({_DIGITS.sub("", c) for c in classes.lower().split()} - {""})
            is_whole = not mark and (tag in WHOLE or (whole and not top.whole))
            way = nodes[node].path
            if len(way) > LONG_PATH:
                way = f"~{xxhash.xxh3_128_hexdigest(way)}"
            nodes.append(Node(node, f"{way}/{'.'.join([tag, *names])}", is_whole, mark, tag in CONTAINERS))
            node = len(nodes) - 1
            whole = whole or is_whole
        stack.append(Open(tag, node, junk, top.link or tag == "a", whole))
        held[tag] += 1
    flush()
    _settle(nodes, blocks)
    return nodes, blocks


def _settle(nodes: list[Node], blocks: list[tuple[int, str, int]]) -> None:
    """Weak marks that the page itself bears out become strong, by the same rule however many pages its host has."""
    if not any(n.mark == WEAK for n in nodes):
        return
    size, linked, parts = [0] * len(nodes), [0] * len(nodes), Counter()
    for node, text, in_links in blocks:
        size[node] += len(text)
        linked[node] += in_links
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        parent = nodes[k].parent
        size[parent] += size[k]
        linked[parent] += linked[k]
        parts[parent, nodes[k].path] += 1
    most = Counter()
    for (parent, _), n in parts.items():
        most[parent] = max(most[parent], n)
    for k, n in enumerate(nodes):
        if n.mark == WEAK and size[k] and (linked[k] >= LINKED * size[k] or (most[k] >= ALIKE and not TALK.isdisjoint(_PARTS.split(n.path.rsplit("/", 1)[-1])))):
            n.mark = STRONG


def best_path(nodes: list[Node], blocks: list[tuple[int, str, int]]) -> str | None:
    """Path of the container with the best score, or of the article around it; None if the page has no text.

    A block counts its characters outside links, less those inside, for its container, and half for that one's parent;
    under a mark it counts less, and under a strong one for no container around that mark.
    """
    if not blocks:
        return None
    above, doubt = [], []  # the container that a node's blocks count for, and the least worth of marks on the way up
    for k, n in enumerate(nodes):
        above.append(k if n.container or n.parent < 0 else above[n.parent])
        doubt.append(min(DOUBT[n.mark], doubt[n.parent] if n.parent >= 0 else 1.0))
    tried = set()
    for node, text, linked in blocks:
        own = above[node]
        value = (len(text) - 2 * linked) * doubt[node]
        if doubt[own] == doubt[node] or doubt[node] > DOUBT[STRONG]:
            nodes[own].score += value
            tried.add(own)
        parent = above[nodes[own].parent] if nodes[own].parent >= 0 else -1
        if parent >= 0 and (doubt[node] > DOUBT[STRONG] or doubt[parent] == doubt[node]):
            nodes[parent].score += value / 2
            tried.add(parent)
    if not tried:
        return None
    best = max(tried, key=lambda k: (nodes[k].score, -k))
    around = best
    while around > 0:
        if nodes[around].whole:
            best = around
        around = nodes[around].parent
    return nodes[best].path


def weak_paths(nodes: list[Node]) -> set[str]:
    """Paths of the page's weakly marked elements."""
    return {n.path for n in nodes if n.mark == WEAK}


def extract(html: str, path: str | None, junk: frozenset[str] | set[str] = frozenset()) -> str:
    """The blocks inside containers on ``path``, one a line, without those under a strong mark or on a path of ``junk`` in there.

    A page without such containers is judged by itself.
    """
    nodes, blocks = parse(html)
    for way in (path, None):
        if way is None:
            way = best_path(nodes, blocks)
        inside = []
        for n in nodes:
            from_above = n.parent >= 0 and inside[n.parent]
            inside.append((n.path == way and not (from_above and n.mark)) or (from_above and n.mark != STRONG and not (n.mark and n.path in junk)))
        text = "\n".join(b[1] for b in blocks if inside[b[0]])
        if text:
            return text
    return ""


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """host, path, votes, junk: for each host the path that most of its pages vote for (ties: the first path), and the weakly
    marked paths that the share SHARE of its pages has, if there are VOTERS pages or more.  A page votes for each path once."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, kinds = [], [], []
            for host, h in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                nodes, blocks = parse(h or "")
                said = [(best_path(nodes, blocks), False), *((p, True) for p in weak_paths(nodes))]
                said = [x for x in said if x[0] is not None]
                hosts += [host] * len(said)
                paths += [p for p, _ in said]
                kinds += [k for _, k in said]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], names=["host", "path", "weak"])

    votes = map_arrow(pages.select(_host(url).alias("host"), F.col(html).alias("html")), vote, "host string, path string, weak boolean")
    counted = cut(votes.groupBy("host", "path", "weak").agg(F.count("*").alias("votes")))
    best = counted.where("NOT weak").groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("b"), F.sum("votes").alias("voters"))
    # at most one path for each two weakly marked elements of an average page is kept
    often = counted.where("weak").join(best.select("host", "voters"), "host").where(f"voters >= {VOTERS} AND votes >= {SHARE} * voters")
    junk = often.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("junk"))
    return best.join(junk, "host", "left").select("host", F.col("b.path").alias("path"), (-F.col("b.v")).alias("votes"), "junk")


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null html is empty and gives an empty text; pages without a host share one; null ids and urls stay null; repeated rows
    each vote and are each extracted; other columns are not read; an empty table gives no rows.
    """
    winners = cut(host_paths(pages, id_col, url, html).drop("votes"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(url).alias("host"))
    size = winners.agg(F.sum(F.length("host") + F.length("path") + F.coalesce(F.length(F.array_join("junk", "")), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("html", "path", "junk"))
            texts = [extract(h, p, frozenset(j or ())) if h else "" for h, p, j in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    return map_arrow(rows.select("page_id", "url", "html", "path", "junk"), run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
