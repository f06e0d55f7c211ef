"""HTML extraction: pages of known text, site trees, tolerant reading, worst cases."""

import html
import random
import re
import time

import pytest

from kelasflow.llm import html_extract, queries_audit
from kelasflow.llm.common import table
from kelasflow.llm.html_blocks import Reader, main_text
from tests.conftest import SF001


def read(page):
    return main_text(Reader().read(page))


def frame(spark, rows):
    """page_id, url, html and columns whose names clash with what the operator adds."""
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, (u, h) in enumerate(rows)],
                                 "page_id long, url string, html string, text string, host int, removed int")


def test_query_gives_the_articles_of_the_table(spark):
    rows = table(spark, SF001, "pages").collect()
    got = {r.page_id: r for r in queries_audit.op12_html_extraction(spark, SF001).collect()}
    assert len(got) == len(rows) > 0
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == " ".join(b for b in blocks if b)
        assert (got[r.page_id].n_chars, got[r.page_id].url) == (len(got[r.page_id].text), r.url)


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain  text\n", "plain text"), ("a < b &lt; c &amp d &nbsp; &eacute; &#233; &#x41; &am", "a < b < c & d é é A &am"),
    ("<p>one<p>two<br>three</p>four", "one two three four"),
    ("<p><b>a<i>b</b>c</i> d<br><p>e", "abc d e"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
    ("<table><tr><td>a<td>b<tr><th>c</table>d", "a b c d"),
    ("x<script>if (a<b) '</p>'</script>y<style>p{}</style>z<!-- no <p>no -->w", "xyzw"),
    ("<SCRIPT>no</ScRiPt >yes<script>to the end", "yes"),
    ("<title>no</title><h1>yes</h1><textarea>no<p>no</textarea>", "yes"),
    ("<nav>no<div>no</nav>yes</div> too", "yes too"),
    ("<p>a<span class='ad box'>no<span>no</span> no</span>b</p>", "ab"),
    ("<header>no<h1>no</h1></header><article><header><h1>T</h1><p>by me</p></header><p>x</p><footer>no</footer></article>", "T x"),
    ("<div>out</div><main><h1>T</h1><article><p>a</p></article><div class='user-comments'><p>no</p></div></main>", "T a"),
    ("<div id='cookie_notice'>no</div><div class='post no-sidebar'>yes</div><form>no</form><aside>no</aside>", "yes"),
    ("<article class='comment'>no</article><p>yes</p><div style='display: none'>no</div><p hidden>no</p>", "yes"),
    ("<article><p>a</p><section class='comments'><article><p>no</p></article></section><p>b</p>", "a b"),
    ("</p></div>a<//>b</>c<?php no ?>d<!doctype no>e", "abcde"),
    ("<div title='a>b'>x</div><div title=\"<p>\">y</div>", "x y"),
    ("<p>a&nbsp;\t\r\n b</p>", "a b"),
])
def test_reading(page, text):
    assert read(page) == text


def site(rnd, n):
    """Pages of one template without telling names; the part that repeats is noise."""
    for i in range(n):
        own = [" ".join(rnd.choices("abcdefghijklmnop", k=12)) + f" {i}" for _ in range(4)]
        yield (f"https://Site.example.org/{i}",
               "<body><div id=top><ul>" + "".join(f"<li><a href=/{x}>{x}</a>" for x in "home shop about".split())
               + "</ul></div><div id=b7>" + "".join(f"<p>{t}</p>" for t in own)
               + "<p class=z>Follow us for more stories like this one</p></div><div id=q>All rights kept by us</div>",
               " ".join(own))


def test_site_tree_removes_what_repeats_on_a_host(spark):
    rows = list(site(random.Random(1), 12))
    lone = ("https://lone.example.org/", "<div id=q>All rights kept by us</div><p>text</p>", "All rights kept by us text")
    got = {r.page_id: r.text for r in html_extract.extract_text(frame(spark, [(u, h) for u, h, _ in [*rows, lone]])).collect()}
    assert [got[i] for i in range(len(rows) + 1)] == [t for _, _, t in [*rows, lone]]


def test_copies_of_one_page_keep_their_text(spark):
    u, h, t = next(site(random.Random(2), 1))
    page = h.replace("<div id=b7>", "<article>").replace("<p class=z>", "<p>").replace("</div><div id=q>", "</article><div id=q>")
    got = html_extract.extract_text(frame(spark, [(u, page)] * 30)).collect()
    assert len(got) == 30 and {r.text for r in got} == {t + " Follow us for more stories like this one"}
    got = html_extract.extract_text(frame(spark, [(u, h)] * 30)).collect()     # nothing tells noise from text
    assert len({r.text for r in got}) == 1 and t in got[0].text


def test_importance_is_entropy_over_pages(spark):
    rows = [(u, h) for u, h, _ in site(random.Random(3), 8)]
    pages = frame(spark, rows).selectExpr("'h' AS host", "html")
    found = html_extract.branch_importance(html_extract.style_trees(pages)).collect()
    values = sorted(round(r.importance, 3) for r in found)
    assert all(r.m == 8 for r in found) and values[0] < 0.05 and values[-1] > 0.85


def test_edge_cases(spark):
    long = "<p>" + "kata " * 200_000
    rows = [(None, None), (None, "<p>a</p>"), ("no host", "<p>a</p>"), ("x://", ""), ("http://a/", None),
            ("http://a/", long), ("http://a/", "<p>a</p>"), ("http://a/", "<p>a</p>"), ("http://A/", "<p>a</p>")]
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in
                 html_extract.extract_text(frame(spark, rows)).fillna("-", ["url"]).collect())
    texts = ["", "a", "a", "", "", ("kata " * 200_000).strip(), "a", "a", "a"]
    assert got == [(i, u or "-", t, len(t)) for i, ((u, _), t) in enumerate(zip(rows, texts))]
    assert html_extract.extract_text(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("piece", ["<div>", "<p>", "</div>", '<a "', "<!--", "<li>", "<b class=ad>", "&amp", "<", "<div class=x",
                                   "<div><p></div>", "<script>", "<a '\"", "<ul><li>", "<table><tr><td>", "<p></span>",
                                   "<div class=ad><p>", "<x>"])
def test_a_megabyte_of_one_piece(piece):
    start = time.time()
    read(piece * (1_000_000 // len(piece)))
    read("<div>" * 50_000 + piece * (500_000 // len(piece)))
    assert time.time() - start < 30
