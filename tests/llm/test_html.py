"""Main text of pages: what names say, consensus against a plain voter, pages of every shape in linear time."""

from __future__ import annotations

import random
import resource
import time
from collections import defaultdict
from decimal import Decimal
from urllib.parse import urlsplit

import pytest

from modiste.llm import html

STORY = "An article sentence of some words here. " * 13
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["content has-sidebar", "site no-sidebar", "long-form", "with-banner", "layout--rail-right", "post-related-to-x", "noAds", "social-science", "form-content", "widget"])
def test_a_name_never_takes_the_article(name):
    for page in ("<html><body><div class='{}'><p>{}</p></div></body></html>", "<body><nav><a href=x>menu</a></nav><section id='{}'><h1>Head</h1><p>{}</p></section><footer>end</footer>"):
        assert STORY.strip() in html.text_of(page.format(name, STORY), None)
    assert html.text_of(f"<body><div id='{name}'><main><p>{STORY}</p></main></div></body>", None) == STORY.strip()


def test_main_inside_an_ad_free_part():
    assert html.text_of(f"<body><div id='ad-free'><main><p>{STORY}</p></main></div></body>", None) == STORY.strip()


@pytest.mark.parametrize("name", ["sidebar", "ad", "cookie-notice", "main-nav", "related-posts", "newsletterSignup", "share-buttons", "commentList", "user-comments", "site-header", "advert"])
@pytest.mark.parametrize("page", ["<body><article><h1>T</h1><p>{1}</p></article><div class='{0}'><p>{2}</p></div></body>", "<body><div class='{0}'><p>{2}</p></div><div class=story><p>{1}</p></div></body>",
                                  "<body><main><p>{1}</p><section id='{0}'><p>{2}</p></section></main></body>"])
def test_other_parts_go(page, name):
    if name == "site-header" and "<main>" in page:
        page = page.replace("<main>", "<div>").replace("</main>", "</div>")
    text = html.text_of(page.format(name, STORY, "Words that are no part of it. " * 3), None)
    assert STORY.strip() in text and "no part" not in text


def test_more_comments_than_article():
    remarks = "".join(f"<div class='comment'><article class='comment-body'><p>{'A reader says this. ' * 20}</p></article></div>" for _ in range(30))
    for part in (f"<div class='comments'>{remarks}</div>", f"<section id='comment-list'>{remarks}</section>", remarks):
        assert html.text_of(f"<body><article><p>{STORY}</p></article>{part}</body>", None) == STORY.strip()
        assert html.text_of(f"<body><div class='post'><p>{STORY}</p></div>{part}</body>", None) == STORY.strip()


def test_inline_parts_and_unclosed_ones():
    assert html.text_of("<p>One <span class=ad>buy</span> two <b class='share'>tell</b> three</p>" + f"<p>{STORY}</p>", None).startswith("One two three\n\n")
    assert html.text_of(f"<div><p>One <span class=ad>buy</p><p>{STORY}</p></div>", None) == "One\n\n" + STORY.strip()
    assert html.text_of("<p>a <b c</p>d", None) == "a d" and html.text_of("<p>1 < 2 and <3</p>", None) == "1 < 2 and <3"
    assert html.text_of("<p title='a > b'>x</p>", None) == "x" and html.text_of("<p>a<p title=\"b>c</p>", None) == "a\n\nc"


def test_an_article_of_several_sections_is_whole():
    assert html.text_of(f"<body><article><section><p>{STORY}</p></section><section><p>Short end.</p></section></article></body>", None) == STORY.strip() + "\n\nShort end."


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<a " * 350_000, '<a "' * 250_000, "<a b='" * 170_000, "<li>x" * 100_000, "<ul><li>x" * 50_000, "</b>" * 100_000 + "<div>" * 50_000 + "</b>" * 100_000, "<!--" * 100_000,
                                  "<p>a<b class=ad>" * 50_000, "<table><tr><td>x" * 30_000, "<div class='comment'><p>x" * 40_000, "<" * 500_000, "<blockquote>" * 50_000 + "<li>x" * 50_000])
def test_pages_of_any_shape_in_linear_time(page):
    began = time.time()
    html.text_of(page, 5)
    html.vote_of(page)
    assert time.time() - began < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 4_000_000


def plain(pages):
    """Votes counted by a loop, every page read with the most voted path it has."""
    votes = defaultdict(lambda: [0, Decimal(0)])
    read, host = {}, lambda u: (urlsplit(u or "").hostname or "")
    distinct = {(host(u), h) for _, u, h in pages if host(u)}
    rows = [(host(u), h) for _, u, h in pages if host(u)]
    for at, h in rows:
        page, blocks = html.blocks_of(h or "")
        best = html.best_of(page, blocks)
        if best is not None and best[1] > 0:
            v = votes[at, page.path[best[0]]]
            v[0] += 1
            v[1] += Decimal(repr(best[1])).quantize(Decimal("0.000001"))
    for at, h in distinct:
        page, blocks = html.blocks_of(h or "")
        known = [(-votes[at, p][0], -votes[at, p][1], p) for p in html.paths_of(page, blocks) if (at, p) in votes]
        read[at, h] = min(known)[2] if known else None
    return sorted((i, html.text_of(h, read.get((host(u), h)))) for i, u, h in pages)


def test_consensus_equals_a_plain_voter(spark):
    rng = random.Random(4)
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html").collect()]
    pages = [(i, u, h) for i, u, h in given]
    parts = ["<div class='story'><p>{}</p></div>", "<div class='list'><p>{}</p></div>", "<section><div class='x1'><p>{}</p></div></section>", "<article><p>{}</p></article>", "<div class='side-note'><p>{}</p></div>"]
    for i in range(150):
        body = "".join(p.format("word " * rng.choice([3, 9, 30, 80])) for p in rng.sample(parts, rng.randint(1, 4)))
        pages.append((10_000 + i, f"https://{rng.choice('abc')}.example/{i}", f"<body>{body}</body>"))
    pages += pages[:3] + [(20_000, None, "<p>x</p>"), (20_001, "https://a.example/", None), (20_002, "odd", ""), (20_003, "https://a.example/", "<body>")]
    df = spark.createDataFrame([(*p, 1, "x", "y", 2) for p in pages], "page_id long, url string, html string, host int, path string, h string, g int").repartition(4)
    out = html.extracted(df)
    assert out.columns == [*df.columns, "__text"]
    assert sorted((r.page_id, r["__text"]) for r in out.collect()) == plain(pages)
