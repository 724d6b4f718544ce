"""Main text of pages: known formats, broken markup, and pages without an article element."""

import html
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernmill.llm import html_text as H

ARTICLE = "<article><h1>Title</h1><p>First paragraph with enough words to read.</p><p>Second &amp; last, <b>bold</b>\n and  <a href=x>linked</a>.</p></article>"
TEXT = "Title\nFirst paragraph with enough words to read.\nSecond & last, bold and linked."


@pytest.mark.parametrize(
    "around",
    [
        "@@",
        "<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>@@<footer>&copy; me</footer>",
        "<header><h1>Site</h1><p>motto</p></header><div class='sidebar-left'><p>Some side text that is long enough to matter</p></div>@@",
        "<div id=cookie-notice><p>We use cookies to improve all of your visits here.</p></div>@@<section class='comments'><p>Great article, thanks!</p></section>",
        "<form><label>Mail</label><input><button>Send it now</button></form>@@<aside>Related: other things to read</aside>",
        "<script>var a='</p><article>no</article>';</script><style>p{margin:0}</style>@@<div class='ad'>Buy this now, it is cheap</div>",
        "<!-- <article>old</article> -->@@<div role=dialog>Sign up</div><p hidden>secret</p>",
    ],
)
def test_article_without_its_surroundings(around):
    page = "<!DOCTYPE html><html><head><title>Title</title></head><body>" + around.replace("@@", ARTICLE) + "</body></html>"
    assert H.main_text(page) == TEXT


def test_inside_the_article():
    inner = "<article><header><h1>T</h1><p>by someone</p></header><p>Body text one.</p><div class='advert'>Ad</div><div class='share-buttons'><a>Tweet</a></div><ul><li>item</ul><p>Body text two<br>after.</p><div id='comments'><p>hi</p></div></article>"
    assert H.main_text(inner) == "T\nBody text one.\nitem\nBody text two after."


def test_broken_markup():
    assert H.main_text("<article><p><b>One.<br><p>Two.</p><p>Three</article><footer>f") == "One.\nTwo.\nThree"
    assert H.main_text("<article><p>a &am b &lt c &#233; &bogus;</p>") == "a &am b < c é &bogus;"
    assert H.main_text("</div></p><p>Only text") == "Only text"
    assert H.main_text("plain text, no markup") == "plain text, no markup"
    assert [H.main_text(x) for x in (None, "", "   ", "<script>x</script>", "<!--")] == ["", "", "", "", ""]
    assert [H.main_text("<p>x</p>" + tail) for tail in ("<!-- cut", "<p clas", "</articl", "<a href='", "<script>var")] == ["x"] * 5 and H.main_text("a < b") == "a < b"
    assert len(H.main_text("<p>" + "word " * 300_000)) == 5 * 300_000 - 1
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_without_an_article_element():
    page = "<body><div><a href=1>Home page</a> <a href=2>All the news</a></div><div><h2>Head</h2>" + "".join(f"<p>Paragraph {i} with a good number of words in it, as articles have.</p>" for i in range(5)) + "<p>End.</p></div><div><a href=3>Imprint</a></div></body>"
    lines = H.main_text(page).split("\n")
    assert lines[0] == "Head" and lines[-1] == "End." and len(lines) == 7


def test_generated_pages_are_exact(spark):
    """Pages whose article is plain: its blocks are found by splitting at block tags."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select("html", H.extract(F.col("html")).alias("text")).collect()
    assert rows
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|li|ul|div)>", article))
        assert r.text == "\n".join(b for b in blocks if b)


def test_column_on_edge_rows(spark, edges, nothing):
    rows = edges.select(H.extract(F.col("text")).alias("t")).collect()
    assert len(rows) == edges.count() and all(r.t is not None for r in rows)
    assert nothing.select(H.extract(F.col("text"))).count() == 0


def renamed(page):
    """A page whose layout tags are all divs and whose classes say nothing."""
    page = re.sub(r"<(/?)(nav|article|footer|header|main|aside|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r' class="[^"]*"', ' class="x1"', page)


def test_pages_without_telling_tags_or_classes(spark):
    """The ratio alone finds the article: given pages with every layout tag and class renamed."""
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    whole = missed = extra = 0
    for page in rows:
        want, got = (Counter(H.main_text(x).split("\n")) for x in (page, renamed(page)))
        if sum(map(len, want)) > 400:
            whole += sum(len(x) * n for x, n in want.items())
            missed += sum(len(x) * n for x, n in (want - got).items())
            extra += sum(len(x) * n for x, n in (got - want).items())
    assert whole > 500_000 and missed <= 0.001 * whole and extra <= 0.02 * whole


def test_the_ratio_decides(spark, monkeypatch):
    rows = [renamed(r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    before = [H.main_text(x) for x in rows]
    monkeypatch.setattr(H, "_smooth", lambda ratio, homes: np.ones(len(ratio)) * 1e9)
    assert sum(H.main_text(x) != y for x, y in zip(rows, before, strict=True)) >= 0.9 * len(rows)


def test_nothing_else_is_dropped_inside():
    page = "<article><h1>T</h1><p class='legal-news'>News of law.</p><p>A &lt; b <math><mi>x</mi></math> <label>term</label> rest.</p><section id='discussion'><p>We discuss this at length.</p></section></article>"
    assert H.main_text(page) == "T\nNews of law.\nA < b x term rest.\nWe discuss this at length."


def test_sibling_sections_all_count():
    words = "a paragraph that has a good number of words in it, as articles do, and goes on. "
    page = "<body><div><a href=1>Home</a><a href=2>News</a></div><div><div><h2>One</h2>" + f"<p>{words * 3}</p>" * 9 + f"</div><div><h2>Two</h2><p>{words * 2}</p></div></div><div><a href=3>Imprint</a></div></body>"
    lines = H.main_text(page).split("\n")
    assert lines[0] == "One" and lines[10] == "Two" and len(lines) == 12


def test_pieces_change_nothing(spark, monkeypatch):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").limit(60).collect()]
    whole = [H.main_text(x) for x in rows]
    monkeypatch.setattr(H, "PIECE", 7)
    assert [H.main_text(x) for x in rows] == whole


PARAGRAPHS = [f"Paragraph {i} tells of many things at some length, as an article does, and it ends here." for i in range(4)]


@pytest.mark.parametrize(
    "open_",
    [
        '<form id="aspnetForm"><div id="content">', '<div class="page-sidebar-left"><div>', '<div class="layout header-fixed"><div>', '<section id="ad-tech-history"><div>', '<div class="promo-page"><div>', '<div class="comments-off"><div>',
        '<div class="nav-open"><div>', '<div class="legal-notice"><div>', '<form><fieldset>', '<div class="ads"><div class="widget banner">',
    ],
)
def test_a_name_never_empties_a_page(open_):
    close = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", open_)))
    inner = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    aside = "<nav><a href=1>Home</a></nav><div class='footer'>Imprint of the company and its address</div>"
    assert H.main_text(f"<body>{open_}{inner}{close}{aside}</body>") == "\n".join(PARAGRAPHS)
    replies = "<div class='comments'>" + "<p>I think so too, and would like to add a thing or two to that, if I may.</p>" * 9 + "</div>"
    assert H.main_text(f"<body>{open_}<article>{inner}</article>{replies}{close}{aside}</body>") == "\n".join(PARAGRAPHS)


def test_long_comments_stay_out():
    replies = "<section class='comments'>" + "<p>I think so too, and would like to add a thing or two to that, if I may.</p>" * 40 + "</section>"
    for tag in ("article", "main", "div"):
        inner = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
        assert H.main_text(f"<body><{tag}>{inner}</{tag}>{replies}</body>") == "\n".join(PARAGRAPHS)


def test_deep_nesting_takes_linear_time():
    def seconds(n):
        page = "".join(f"<div class='ad'><p>Block {i} has some text.</p>" for i in range(n))
        start = time.perf_counter()
        assert H.main_text(page).startswith("Block 0 has some text.\nBlock 1")
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(40_000) < 10 * seconds(10_000) + 0.5
