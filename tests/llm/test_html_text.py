"""Main text of pages: planted parts, odd markup, and the driver's pages against their article elements."""

import html as entities
import re
import time

import pytest

from quillspark.llm import html_text
from quillspark.llm.html_text import main_text

LONG = "This paragraph is long enough, with commas, to pass points to what stands around it, and then some more."
PARTS = [f"Part {k}: {LONG}" for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARTS)
WANT = "\n\n".join(PARTS)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1>{BODY}</article><footer>&copy; me</footer>", "Title\n\n" + WANT),
        (f'<div class="cookie-notice">We use cookies, and we like them, really we do, yes.</div><div id="content">{BODY}</div><div id="sidebar"><p>{LONG}</p></div>', WANT),
        (f'<div class="content with-sidebar">{BODY}</div>', WANT),
        (f"<article>{BODY}<section class='comments'><p>{LONG}</p><article class=comment>{BODY}</article></section></article>", WANT),
        (f"<article><header><h1>Head</h1><p>by me, today, at home, and so on, and so on</p></header>{BODY}<footer>tags</footer></article>", "Head\n\n" + WANT),
        (f"<article>{BODY}<form><p>{LONG}</p><input name=x></form><aside>{LONG}</aside></article>", WANT),
        (f"<div>{BODY}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></div>", WANT),
        (f"<div><ul><li>an item of a list, plain<li>another one</ul>{BODY}</div>", "an item of a list, plain\n\nanother one\n\n" + WANT),
        (f"<article><p>one&nbsp;two &amp; three<br>four\n\n five</p><p hidden>no</p><p style='display: none'>no</p>{BODY}", "one two & three four five\n\n" + WANT),
        (f"<article><p>a &lt;b&gt; c<script>var t = '</p>'; if (a < b) x();</script>d<style>p > a {{}}</style></p>{BODY}</article>", "a <b> cd\n\n" + WANT),
        (f"<article><p><b>open bold<p>next, and <i>mis<b>nested</i> ends</b></p>{BODY}", "open bold\n\nnext, and misnested ends\n\n" + WANT),
        (f"<article><table><tr><td>cell one<td>cell two<tr><td>cell three</table>{BODY}</article>", "cell one\n\ncell two\n\ncell three\n\n" + WANT),
        (f"<article><p title='a > b' data-x=it's>text</p><!-- <p>no</p> -->{BODY}<!-- open", "text\n\n" + WANT),
        (f"<article>3 < 4 and 5 > 2{BODY}</article>", "3 < 4 and 5 > 2\n\n" + WANT),
        (f"<form id=aspnet><div>{BODY}</div></form>", WANT),
        (f"<article><h1></h1></article><div>{LONG}</div>", ""),
        ("<article><h1>One</h1><p>word</p></article><div class=ad>Buy, buy, buy, all of it, now and here, today.</div>", "One\n\nword"),
        (f"<h1>Title</h1><div>{BODY}</div>", "Title\n\n" + WANT),
        (f"<body><div><div>{BODY}</div><div>{BODY}</div></div></body></html> tail", WANT + "\n\n" + WANT),
        (f"<head><title>t</title></head><main><p>{PARTS[0]}</p><div role=navigation>menu, menu, menu</div><p>{PARTS[1]}</p></main>", PARTS[0] + "\n\n" + PARTS[1]),
        (f"<script>never closed <article>{BODY}</article>", ""),
        (f"<article>{BODY}<p>last <a href='x", WANT + "\n\nlast"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_time_in_proportion():
    """Deep trees, unclosed quotes, stray ends and many blocks."""
    for make in (lambda n: "<div>" * n + LONG, lambda n: "<b><p>x" * n, lambda n: '<a href="' * n, lambda n: "</p></x>" * n, lambda n: f"<p>{LONG}</p>" * n, lambda n: "<ul><li><a>x</a>" * n, lambda n: "<" * n, lambda n: "<!--" * n, lambda n: "<a ='" * n):
        took = []
        for n in (2000, 8000):
            began = time.thread_time()
            main_text(make(n))
            took.append(time.thread_time() - began)
        assert took[1] < 8 * took[0] + 0.2


def test_query(spark, sf):
    """The pages' articles, told apart by plain patterns."""
    got = {r.page_id: r for r in html_text.op13_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


def test_odd_rows(spark):
    """Nulls anywhere, repeated rows, clashing names, an empty table."""
    rows = [(None, None, None, "x"), (1, None, "<p>one</p>", "x"), (1, None, "<p>one</p>", "x"), (2, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extracted(pages).collect()) == [(0, None, "", 0), (1, None, "one", 3), (1, None, "one", 3), (2, "u", "", 0)]
    assert html_text.extracted(pages.limit(0)).collect() == []
