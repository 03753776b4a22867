"""Pages of several layouts with their main text written by hand, alone and as pages of one host."""

from __future__ import annotations

import pytest

from postroom.llm import html_extraction as he

LONG = "This is the long main text of the page, which tells the story from its start to its end."

LAYOUTS = {
    "teaser article beside main prose": (
        f"<main><h1>Title</h1><p>{LONG}</p><div><article><a href=/x>Teaser card</a></article></div></main>",
        f"Title {LONG} Teaser card",
    ),
    "read-next article after the post": (
        f"<div class=post>{LONG}</div><article><a href=/n>Read next</a></article>", f"{LONG} Read next",
    ),
    "names that sound like boilerplate inside the article": (
        "<article><h2 class=section-header>What we did</h2><p>We did this.</p><p class=notice>It was noticed.</p>"
        "<ul class=menu-of-ideas><li>One idea</ul><p class=legal>It was legal.</p><p id=search-results>We found it.</p></article>",
        "What we did We did this. It was noticed. One idea It was legal. We found it.",
    ),
    "news": (
        "<header>Daily</header><nav><a href=/>Home</a></nav><main><article><h1>Rain &amp; wind</h1><p>It rained.</p>"
        "<figure><img src=x><figcaption>Clouds</figcaption></figure><p>It <em>poured</em>.</p></article></main><footer>c</footer>",
        "Rain & wind It rained. Clouds It poured.",
    ),
    "blog without article": (
        "<div id=sidebar><ul><li>Archive</ul></div><div class=entry><h2>Bread</h2><p>Mix the flour.</p><blockquote>Knead.</blockquote></div>"
        "<div class=comments><p>Nice!</p></div>",
        "Bread Mix the flour. Knead.",
    ),
    "table layout": (
        "<table><tr><td class=sidebar><a href=/>Home</a><td><h1>Tides</h1><p>High at noon.</p></table>", "Tides High at noon.",
    ),
    "several articles": (
        "<main><article><h2>First</h2><p>One thing.</p></article><article><h2>Second</h2><p>Another thing.</p></article></main>",
        "First One thing. Second Another thing.",
    ),
    "form around the page": (
        "<form><div class=topmenu><a href=/>Home</a></div><main><h1>Rules</h1><ol><li>Be kind.<li>Be brief.</ol></main></form>",
        "Rules Be kind. Be brief.",
    ),
    "list in a menu class": ("<main><p>Choose a dish.</p><ul class=menu><li>Home</ul><dl><dt>Soup<dd>Warm</dl></main>", "Choose a dish. Soup Warm"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, text = LAYOUTS[name]
    assert he.main_text(f"<html><body>{page}</body></html>") == text


def test_layouts_as_hosts(spark):
    """Six different pages a host: the site's own frame goes, the text that differs stays."""
    frame = "<body><div class=x1>Welcome to the site</div><div>{0}</div><div class=x2>All rights reserved</div></body>"
    forms = {
        "main": "<main><h1>Title {i}</h1><p>Main text number {i} is long enough.</p><article><a href=/x>Card</a></article></main>",
        "article": "<article><h1>Title {i}</h1><p>Main text number {i} is long enough.</p></article><p>Same on all pages</p>",
        "plain": "<h1>Title {i}</h1><p>Main text number {i} is long enough.</p>",
    }
    rows = [
        (f"{host}{i}", f"http://{host}.example/{i}", frame.format(form.format(i=i))) for host, form in forms.items() for i in range(6)
    ]
    got = he.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts == {f"{h}{i}": f"Title {i} Main text number {i} is long enough." for h in forms for i in range(6)}


def test_relative_urls_share_no_template(spark):
    rows = [(i, f"/p/{i}", f"<body><p>A common line</p><p>Page {i}</p></body>") for i in range(6)]
    got = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"A common line Page {i}" for i in range(6)}


def test_long_class_names_are_told_apart():
    same = "flex grow items-center justify-between rounded border "
    a, b = he.element("div", f'class="{same}left"'), he.element("div", f'class="{same}right"')
    assert a.label != b.label
