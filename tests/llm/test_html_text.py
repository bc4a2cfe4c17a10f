from __future__ import annotations

import time

import numpy as np
import pytest

from cohortlake.llm import html_text

LONG = "Some words of the article that go on for quite a while, as articles do."

CASES = {
    "plain": (f"<article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article>", f"Title\n{LONG}\nShort."),
    "open tags": (f"<article><p><b>{LONG}<br><p>Two <i>in</i>line\n\t words<p>x</article><footer>f</footer>",
                  f"{LONG}\nTwo inline words\nx"),
    "beside": (
        f'<header>Site</header><nav><a href="/">Home</a></nav><article><p>{LONG}</p><aside>Side</aside>'
        f'<div class="ad">Buy</div><p>More.</p><form>Name <input></form><section id="comments"><article class="comment">'
        f"Nice!</article></section></article><footer>&copy; site</footer>", f"{LONG}\nMore."),
    "scripts": (f"<script>var t='</p><p>no';</script><style>p{{}}</style><article><p>{LONG}<script>x</script></p><!-- <p>no</p> --></article>", LONG),
    "references": ("<article><p>a &lt; b &amp;&amp; c&nbsp;&#233; &#x1F600; &am</p><p>&amp</article>", "a < b && c é \U0001f600 &am\n&"),
    "quotes": ('<article><p title="a > b">one</p><p class=\'x">\'>two</p></article>', "one\ntwo"),
    "list": ("<article><ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>a<td>b</table></article>", "one\ntwo\nthree\na\nb"),
    "unfinished": (f"<article><p>{LONG}</p><p>cut he", f"{LONG}\ncut he"),
    "no article": (
        f'<body><ul><li><a href="/a">Link one</a></li><li><a href="/b">Link two</a></li></ul><div class="sidebar">Side</div>'
        f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='footer'>foot</div></body>", f"{LONG}\n{LONG}"),
    "main": (f"<div>outside</div><main><p>{LONG}</p></main>", LONG),
    "closing paragraph": (
        f'<body><div><p>{LONG}</p><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li></ul>'
        f"<p>Short end.</p></div><div>&copy; site</div></body>", f"{LONG}\nShort end."),
    "names": (
        f"<article><header><h1>Title</h1></header><h2 class='section-header'>Part</h2><section class='related-work'><p>{LONG}</p></section>"
        f"<p class='notice-of-terms'>Terms.</p><div class='site-footer'>foot</div><div class='cookie-notice'>eat</div>"
        f"<div id=share-buttons>share</div></article>", f"Title\nPart\n{LONG}\nTerms."),
    "formula": ("<article><p>Then <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</article>", "Then x=1 holds."),
    "linked heading": (f"<article><h1><a href='/'>Title</a></h1><p>{LONG}</p><p><a href='/s'>Source</a></p></article>", f"Title\n{LONG}\nSource"),
    "menu in an article": (
        f"<article><p>{LONG}</p><ul><li><a href=/1>a</a><li><a href=/2>b</a><li><a href=/3>c</a></ul><p>End.</p></article>", f"{LONG}\nEnd."),
    "only links": ("<article><p><a href=/>one</a><p><a href=/>two</a><p><a href=/>three</a></article>", "one\ntwo\nthree"),
    "head": ("<head><title>t</title><meta charset=x><body><article>x</article>", "x"),
    "no markup": ("just  text", "just text"),
    "empty": ("", ""),
    "null": (None, ""),
    "only tags": ("<article><p></p></article><br><", "<"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert html_text.main_text(page) == want


def test_the_window_matters():
    """Two links in a row are text for a window of three lines and a menu for one of two."""
    page = f"<article><p>{LONG}</p><p><a href=/1>one</a></p><p><a href=/2>two</a></p><p>End.</p></article>"
    assert html_text.main_text(page, 3) == f"{LONG}\none\ntwo\nEnd."
    assert html_text.main_text(page, 2) == f"{LONG}\nEnd."
    # Without an article, a wide window joins what a narrow one keeps apart.
    gap = "<ul><li><a href=/a>x</a></li><li><a href=/b>y</a></li></ul>"
    page = f"<body><div><p>{LONG}</p></div>{gap}<div><p>Far.</p></div></body>"
    assert html_text.main_text(page, 2) == LONG and html_text.main_text(page, 4) == LONG
    page = f"<body><div><p>{LONG}</p>{gap}</div><div><p>{LONG[:30]}</p></div></body>"
    assert html_text.main_text(page, 2) == f"{LONG}\n{LONG[:30]}" and "x\ny" in html_text.main_text(page, 4)


def test_unclosed_elements_take_linear_time():
    many = 20_000
    page = "<article>" + "<b><font><a href=x>" * many + "<hr></i></section></nav>" * many + "<p>text</p></article>" + "</div>" * many
    start = time.perf_counter()
    assert html_text.main_text(page) == "text"
    assert time.perf_counter() - start < 20


def test_surges_and_dives():
    lengths = np.array([0, 5, 0, 0, 0, 0, 7, 0, 8, 0, 0, 0, 1])
    assert html_text.surges(lengths, 3) == [(1, 2), (6, 9), (12, 13)]
    assert html_text.surges(lengths, 5) == [(1, 13)]
    assert html_text.surges(np.zeros(4, int)) == [] and html_text.surges(np.zeros(0, int)) == []


def test_frames(spark):
    rows = [(i, f"http://x/{i}", page, "clash") for i, (page, _) in enumerate(CASES.values())]
    rows += [(None, None, "<article>" + "<p>a b</p>" * 50000, "x"), (0, "http://x/0", rows[0][2], "x"), (99, "u", "<<>><p", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_text.extract_text(pages).collect()
    assert len(got) == len(rows)
    want = [w for _, w in CASES.values()]
    of = {r.page_id: r for r in got}
    assert [of[i].text for i in range(len(want))] == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert of[None].text == "\n".join(["a b"] * 50000)
    assert html_text.extract_text(pages.limit(0)).collect() == []
