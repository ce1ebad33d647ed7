"""Main text of web pages by consensus of their host.

Every page scores its containers by the text of the paragraphs in them, less links, halved with each level between; its best one, or the article it lies
in, is a vote for the container's generalised path (tags with classes, digits masked). Spark counts the votes per (host, path), and every page
meets the votes for the paths it has itself; the most voted one is its text, and a page that has none of them uses its own best
container. So a page with an odd balance of text follows the template of its siblings, however many templates the host has. Paths go by 64-bit hashes.

Menus, headers and footers of the page, side bars, notices, adverts, forms, scripts, styles, hidden parts and reader comments never count
and are left out of what is extracted. What tags, roles or hiding say holds. What a class or id says is weighed: a name made of markers and words that
mean nothing (`sidebar`, `cookie-notice`, `commentList`) drops its element unless that holds the page's article, or most of its text where the page has
no article; a name that has a marker among other words (`post-related-to-x`) drops it only while it holds little of the page's text or is mostly links; a name
that says the part is absent or only there (`has-sidebar`, `ad-free`) says nothing.

Blocks are separated by two line ends, white space inside a block is one space, character
references are decoded. Null and empty pages have an empty text, and so have pages without a paragraph. Pages of a null or odd url have
no host and use their own best container. Every row is read by itself, also where a page_id repeats. Time and memory follow the length of a page, whatever
its nesting and however many of its tags, quotes or comments aren't closed.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modiste.llm.common import in_runs, stored, unused

OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
CONTAINERS = frozenset("html body main article section div td th center details".split())
BLOCKS = CONTAINERS | frozenset("address blockquote dd dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr li ol p pre summary table tbody tfoot thead tr ul caption aside footer form nav menu dialog search".split())
DROPPED = frozenset("head nav aside footer form menu dialog search button select datalist svg math canvas object audio video map template iframe".split())
#: their content is no markup
RAW = frozenset("script style textarea title noscript xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = frozenset("br hr img input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: words of a class or id that mark a part as something else than the article
REMARKS = frozenset("comment comments commentlist comentarios kommentare disqus respond reply replies discussion".split())
OTHER = REMARKS | frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising adslot adunit sponsor sponsored sponsors promo promoted promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav aside rail footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations teaser teasers widget widgets pagination pager search searchbox form skip".split()
)
#: marks that hold for a page's head only, not for the head of an article
HEADS = frozenset(["header"])
#: words beside a marker that mean nothing, and such that take its meaning away
NEUTRAL = frozenset(
    "list area section wrapper wrap box thread container body content contents item items user users reader readers block entry count meta author text post posts page site main top bottom left right primary "
    "secondary global inner outer link links button buttons bar title heading panel group slot unit holder zone module column col mobile desktop sticky fixed article articles story stories news tag tags label view".split()
)
ABSENT = frozenset("has have no non not with without free is hide less".split())
#: a new block of the kind ends an open one of the same family
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: which no such end reaches beyond
FENCES = ("ul", "ol", "dl", "table", *sorted(CONTAINERS - {"td", "th"}))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NOTHING, WEAK, STRONG, REMARK = range(4)
#: parts of a page's text: below the first a weak mark holds, from the second on a strong one doesn't where there is no article
LITTLE, MOST = 0.25, 0.6
VOTE = T.StructType([T.StructField("path", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("have", T.ArrayType(T.LongType()))])


def attributes(text: str) -> dict[str, str]:
    if not text or "=" not in text and not text.strip(" /\t\r\n"):
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


@functools.lru_cache(1 << 14)
def mark_of(names: str, in_article: bool) -> int:
    """What the names of an element's class and id say."""
    out = NOTHING
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        marks = [w for w in words if w in OTHER or (w in HEADS and not in_article)]
        if not marks or any(w in ABSENT for w in words):
            continue
        if all(w in NEUTRAL or w in marks for w in words):
            out = max(out, REMARK if any(w in REMARKS for w in marks) else STRONG)
        else:
            out = max(out, WEAK)
    return out


def left_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether tag, role or hiding make an element something else than the article."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or HIDDEN.search(attrs.get("style", "")) is not None)


def step(path: int, tag: str, names: str) -> int:
    """The path of a container below another path: the tag with its classes, digits masked."""
    said = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in names.split()})])
    return int(np.uint64(xxhash.xxh64_intdigest(said, path & 0xFFFFFFFFFFFFFFFF)).astype(np.int64))


@dataclass
class Page:
    """A page's elements in the order of their beginnings (parent, tag, path, nearest container, whether tags drop it, mark, whether in an article), and its
    blocks: a container and pieces (element, text, linked)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    holder: list[int] = field(default_factory=list)
    out: list[bool] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, list[tuple[int, str, bool]]]] = field(default_factory=list)

    def add(self, parent: int, tag: str, path: int, container: bool, out: bool, mark: int, article: bool, main: bool) -> int:
        at = len(self.tag)
        for column, value in ((self.parent, parent), (self.tag, tag), (self.path, path), (self.holder, at if container or parent < 0 else self.holder[parent]), (self.out, out), (self.mark, mark), (self.article, article), (self.main, main)):
            column.append(value)
        return at


class Ends:
    """Where tags end. Quotes that are never closed don't count, and no search for what isn't there is made twice."""

    def __init__(self, html: str):
        self.html, self.last = html, {c: html.rfind(c) for c in ">\"'"}

    def after(self, at: int) -> int:
        """The place of the > that ends the tag of which `at` is a part, or -1."""
        while at <= self.last[">"]:
            m = STOP.search(self.html, at)
            if m is None or m[0] == ">":
                return -1 if m is None else m.start()
            if m.end() <= self.last[m[0]]:
                close = self.html.find(m[0], m.end())
                if close < self.last[">"]:
                    at = close + 1
                    continue
            return self.html.find(">", m.end())
        return -1


def parsed(html: str) -> Page:
    """The elements and blocks of a page, in one pass."""
    page = Page()
    stack = [page.add(-1, "", 0, True, False, NOTHING, False, False)]
    places: dict[str, list[int]] = {}
    held: list[tuple[int, str, bool]] = []
    ends, link = Ends(html), False
    out, tags = page.out, page.tag

    def flush() -> None:
        if held:
            page.blocks.append((page.holder[stack[-1]], held.copy()))
            held.clear()

    def add(text: str) -> None:
        if text and not out[stack[-1]]:
            held.append((stack[-1], text, link))

    def close(i: int) -> None:
        nonlocal link
        if any(tags[e] in BLOCKS and not out[e] for e in stack[i:]):
            flush()
            link = False
        while len(stack) > i:
            places[tags[stack.pop()]].pop()

    def last(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    at, n = 0, len(html)
    while at < n:
        m = OPENING.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        if not m[2]:
            if m[0] == "<!--":
                end = html.find("-->", m.end() - 2)
                at = end + 3 if end >= 0 else n
            else:
                end = html.find(">", m.end())
                at = end + 1 if end >= 0 else n
            continue
        end = ends.after(m.end())
        if end < 0:  # no tag ends from here on
            add(html[m.start() :])
            break
        said, at = html[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            if places.get(tag):
                close(places[tag][-1])
            elif tag == "p" and not out[stack[-1]]:
                flush()
            continue
        if tag in RAW:
            finish = closing(tag).search(html, at)
            at = finish.end() if finish else n
            continue
        if tag in SPACE:
            add(" ")
        if tag in VOID:
            if tag == "hr" and not out[stack[-1]]:
                flush()
            continue
        attrs = attributes(said)
        top = stack[-1]
        if tag == "a":
            link = not out[top]
        if tag in BLOCKS:
            if tags[top] == "head":
                close(len(stack) - 1)
                top = stack[-1]
            if not out[top]:
                flush()
                link = False
            if tags[stack[-1]] == "p":
                close(len(stack) - 1)
            if tag in CLOSED_BY:
                i = last(CLOSED_BY[tag])
                if i > last(FENCES):
                    close(i)
            top = stack[-1]
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
        gone = out[top] or left_out(tag, attrs, page.article[top])
        mark = NOTHING if gone or not names.strip() or tag in ("html", "body", "main") else mark_of(names, page.article[top])
        if tag not in BLOCKS and (said.rstrip().endswith("/") or (not mark and not (gone and not out[top]) and not (out[top] and tag in places and places[tag]))):
            continue
        main = tag in ("article", "main") or attrs.get("role") == "main"
        path = step(page.path[top], tag, attrs.get("class", "")) if tag in CONTAINERS else page.path[top]
        stack.append(page.add(top, tag, path, tag in CONTAINERS, gone, mark, page.article[top] or main, main))
        places.setdefault(tag, []).append(len(stack) - 1)
    flush()
    return page


@functools.lru_cache(64)
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def weighed(page: Page) -> list[bool]:
    """Which elements are left out, marks weighed by the text they hold."""
    n = len(page.tag)
    text, links, mains, heads = [0] * n, [0] * n, [0] * n, [0] * n
    for _, pieces in page.blocks:
        for e, said, linked in pieces:
            size = len(said.strip())
            text[e] += size
            links[e] += size if linked else 0
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        text[up] += text[e]
        links[up] += links[e]
        own = page.mark[e] == NOTHING and text[e] > 0
        mains[up] += mains[e] + (page.main[e] and own and page.tag[e] != "main")
        heads[up] += heads[e] + (own and (page.tag[e] in ("h1", "main") or (page.main[e] and page.tag[e] != "article")))
    whole, articles = text[0], mains[0] + heads[0] if n else 0
    anywhere = any(page.main[e] and page.mark[e] == NOTHING and text[e] > 0 for e in range(n)) if articles else False
    out = list(page.out)
    for e in range(1, n):
        mark = page.mark[e]
        if out[page.parent[e]]:
            out[e] = True
        elif mark and not out[e]:
            holds = heads[e] > 0 or (mark != REMARK and mains[e] > 0)
            if holds:
                continue
            if mark == WEAK:
                out[e] = text[e] <= LITTLE * whole or 2 * links[e] > text[e]
            elif mark == REMARK or (anywhere and not page.main[e]):
                out[e] = True
            else:
                out[e] = page.main[e] and anywhere or text[e] < MOST * whole
    return out


@dataclass
class Block:
    owner: int
    text: str
    linked: int


def blocks_of(html: str) -> tuple[Page, list[Block]]:
    """A page and its text blocks outside dropped parts, in page order."""
    page = parsed(html)
    out, blocks = weighed(page), []
    for owner, pieces in page.blocks:
        kept = [(said, linked) for e, said, linked in pieces if not out[e]]
        text = " ".join(unescape("".join(said for said, _ in kept)).split())
        if text:
            blocks.append(Block(owner, text, sum(len(said) for said, linked in kept if linked)))
    return page, blocks


def best_of(page: Page, blocks: list[Block]) -> tuple[int, float] | None:
    """The best container of a page and its score: text of paragraphs less links, halved per level between, half as much again for article and main. If it
    lies in an article, or else in a main part, that one."""
    value, seen = [0.0] * len(page.tag), [False] * len(page.tag)
    for b in blocks:
        value[b.owner] += max(0.0, len(b.text) - 2.0 * b.linked)
        seen[b.owner] = True
    for e in range(len(value) - 1, 0, -1):
        if page.holder[e] == e and seen[e]:
            up = page.holder[page.parent[e]]
            value[up] += value[e] / 2
            seen[up] = True
    found = [e for e in range(len(value)) if seen[e]]
    if not found:
        return None
    scored = [value[e] * (1.5 if page.tag[e] in ("article", "main") else 1.0) for e in found]
    best = found[max(range(len(found)), key=lambda i: scored[i])]
    score, e, main = max(scored), best, -1
    while e > 0:
        if page.tag[e] == "article":
            return e, score
        if page.tag[e] == "main" and main < 0:
            main = e
        e = page.parent[e]
    return (main if main >= 0 else best), score


def vote_of(html: str | None) -> tuple[int, float] | None:
    page, blocks = blocks_of(html or "")
    best = best_of(page, blocks)
    return None if best is None or best[1] <= 0 else (page.path[best[0]], best[1])


def paths_of(page: Page, blocks: list[Block]) -> list[int]:
    """The distinct paths of the containers that have text."""
    seen, out = [False] * len(page.tag), set()
    for b in blocks:
        e = b.owner
        while e >= 0 and not seen[e]:
            seen[e] = True
            out.add(page.path[e])
            e = page.holder[page.parent[e]] if page.parent[e] >= 0 else -1
    return sorted(out)


def text_of(html: str | None, path: int | None) -> str:
    """The blocks of a page under `path` if it has it, else under its own best container."""
    page, blocks = blocks_of(html or "")

    def under(chosen) -> list[str]:
        inside = [False] * len(page.tag)
        for e in range(len(inside)):
            inside[e] = (page.parent[e] >= 0 and inside[page.parent[e]]) or (page.holder[e] == e and chosen(e))
        return [b.text for b in blocks if inside[b.owner]]

    found = under(lambda e: page.path[e] == path) if path is not None else []
    if not found:
        best = best_of(page, blocks)
        if best is None:
            return ""
        found = under(lambda e: page.path[e] == page.path[best[0]])
    return "\n\n".join(found)


def hosted(pages: DataFrame, host: str, h: str, g: str) -> DataFrame:
    """(host, h, g, vote) of every page with a host: its vote, and the distinct paths of its containers with text."""

    @F.arrow_udf(VOTE)
    @in_runs
    def vote(htmls: pa.Array) -> pa.Array:
        out = []
        for text in htmls.to_pylist():
            page, blocks = blocks_of(text or "")
            best = best_of(page, blocks)
            on = best is not None and best[1] > 0
            out.append({"path": page.path[best[0]] if on else None, "score": best[1] if on else None, "have": paths_of(page, blocks)})
        return pa.array(out, pa.struct([("path", pa.int64()), ("score", pa.float64()), ("have", pa.list_(pa.int64()))]))

    return pages.where(F.col(host) != "").select(F.col(host).alias("host"), F.col(h).alias("h"), F.col(g).alias("g"), vote("html").alias("vote"))


def winners(pages: DataFrame, host: str, h: str, g: str) -> DataFrame:
    """(host, h, g, path): of the paths a page has, the one with most votes of its host. Equal pages of a host have one row."""
    read = stored(hosted(pages, host, h, g), "page-paths")
    votes = read.where("vote.path IS NOT NULL").groupBy("host", F.col("vote.path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("vote.score").cast("decimal(38,6)")).alias("score"))
    own = read.select("host", "h", "g", F.explode("vote.have").alias("path"))
    met = own.join(stored(votes, "host-paths"), ["host", "path"])
    best = met.groupBy("host", "h", "g").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")).alias("b"))
    return best.select("host", "h", "g", F.col("b.path").alias("path"))


def extracted(pages: DataFrame, out: str = "__text") -> DataFrame:
    """`pages` (url, html and whatever else) with the main text in `out`."""

    @F.arrow_udf(T.StringType())
    @in_runs
    def main_text(htmls: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([text_of(x, p) for x, p in zip(htmls.to_pylist(), paths.to_pylist())], pa.string())

    host, h, g, path = unused(pages, "host", "h", "g", "path")
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = pages.withColumn(host, name).withColumn(h, F.xxhash64("html")).withColumn(g, F.xxhash64(F.lit(7), "html"))
    found = stored(winners(keyed, host, h, g).toDF(host, h, g, path), "page-winners")
    return keyed.join(found, [host, h, g], "left").select(*[F.col(f"`{c}`") for c in pages.columns], main_text("html", path).alias(out))
