"""Main text of pages: layouts, broken markup, and whole tables against the articles they were made with."""

import html
import re
import time

import pytest

from tessera.llm import extract
from tessera.llm.common import table

from .test_llm import SF

PROSE = "The first sentence is here, and it goes on; the second follows. A third one ends the paragraph."


def article(page: str) -> str:
    """The blocks of the one <article> of a page of the tables, cut by its two block tags."""
    inside = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", inside[1] if inside else "")
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b).replace("<b>", "")).split()) for b in blocks) if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    folder = SF.rsplit("/", 1)[0] + "/" + sf
    got = {r["page_id"]: r for r in extract.op12_extract(spark, folder).collect()}
    pages = table(spark, folder, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        row = got[p["page_id"]]
        assert row["text"] == article(p["html"]) and row["n_chars"] == len(row["text"]) and row["url"] == p["url"]


OTHER = (
    '<header><h1>The Site</h1><p>All the news, every day.</p></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More, and more.</a></li></ul></nav>'
    f'<div class="cookie-notice"><p>{PROSE}</p></div><aside><p>{PROSE}</p></aside><div id="sidebar"><p>{PROSE}</p></div>'
    f'<form action="/s"><p>{PROSE}</p><input name="q"><button>Search, please.</button></form>'
)
AFTER = f'<section class="reader-comments"><h2>Comments</h2><p>{PROSE}</p><p>{PROSE}</p></section><footer><p>{PROSE}</p></footer>'


@pytest.mark.parametrize("page", [
    f"<html><body>{OTHER}<article><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></article>{AFTER}</body></html>",
    f'<html><body class="has-sidebar">{OTHER}<div id="main"><div class="post"><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div></div>{AFTER}</body></html>',
    f'<body>{OTHER}<main><header><h1>Title</h1></header><p>{PROSE}<p>{PROSE}{AFTER}</main>',
    f"<h1>Title</h1><p>{PROSE}<p>{PROSE}",
    f'<form id="aspnet"><div class="with-sidebar"><article><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>{AFTER}</article></div></form>',
    f'<body><div class="x7"><a href="/">Latest</a></div>{OTHER}<article><h1>Title</h1><p>{PROSE}</p><div class="ad">{PROSE}</div><p>{PROSE}</p></article>',
])
def test_layouts(page):
    assert extract.main_text(page) == f"Title\n\n{PROSE}\n\n{PROSE}"


def test_lists_and_headings_of_an_article_stay():
    page = f"<body><div>Buy now</div><article><h1>A</h1><p>{PROSE}</p><h2>B</h2><ul><li>one<li>two</ul><p>{PROSE}</p><table><tr><td>c<td>d</table></article>"
    assert extract.main_text(page).split("\n\n") == ["A", PROSE, "B", "one", "two", PROSE, "c", "d"]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   \n ", ""), ("plain text", "plain text"), ("<p>a &lt; b &amp;amp; c&nbsp;d &eacute;&#233;&#xe9; &am", "a < b &amp; c d ééé &am"),
    ("<p>a <b>b<br>c</b>\n\n d</p>", "a b c d"), ("<p>un<b>fold</b>ed</p>", "unfolded"), ("1 < 2 and <3", "1 < 2 and <3"), ("<!-- <p>x</p> --><p>y</p><!-- open", "y"),
    ("<script>var t='</p>';</script><p>y</p><SCRIPT>x", "y"), ("<style>p{}</style><noscript>n</noscript><p>y</p>", "y"), ("<p title='a>b'>y</p>", "y"),
    ("<p title='open>y</p>", "y"), ("</div></p>y</p>", "y"), ("<title>t</title><p>y", "y"), ("<nav>x</nav><footer>z</footer>", ""), ("<textarea>t</textarea><p>y", "y"),
    ("<head><title>t</title><body><p>y", "y"), ("<?xml version='1'?><!DOCTYPE html><p>y", "y"), ("<p>y<", "y<"), ("<p>y</p><a", "y"),
])
def test_small_pages(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize("page", ["<" * 300_000, "<div>" * 60_000 + "x." , "<a '" * 100_000, "<!--" * 100_000, "<p>a.</p>" * 60_000, "<b>" * 100_000, "&" * 300_000, "</p>" * 100_000, "x " * 1_000_000, '<a "> ' * 50_000, "<x>y." * 30_000])
def test_time_is_linear(page):
    began = time.time()
    extract.main_text(page)
    assert time.time() - began < 12


def test_nothing_is_capped():
    page = "<article>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(20_000)) + "</article>"
    assert extract.main_text(page) == "\n\n".join(f"Paragraph {i}, of many." for i in range(20_000))
    assert extract.main_text(f"<p>{'word, ' * 500_000}") == ("word, " * 500_000).strip()


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "", ""), (3, "v", "<nav>n</nav>")]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(str, (tuple(r) for r in extract.extract(pages).collect())))
    assert got == sorted(map(str, [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "", "", 0), (3, "v", "", 0)]))
    assert extract.extract(pages.limit(0)).count() == 0
