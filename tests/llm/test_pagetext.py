import time

import pytest

from weftline.llm import pagetext
from weftline.llm.pagetext import Page
from weftline.session import literal_rows

ARTICLE = "<h1>Title &amp; more</h1><p>First   paragraph,\n with <b>bold</b>text.<br>Next line.<p>Second one &eacute;&#x20AC;&nbsp;end.</p>"
ARTICLE_TEXT = "Title & more\n\nFirst paragraph, with boldtext. Next line.\n\nSecond one é€ end."
AROUND = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p><article>no</article>";</script></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu entry</a><li><a href="/b">Other</a></ul></nav><!-- <p>no</p> -->'
    '<div class="cookie-notice">We use cookies.</div><div id="sidebar-2"><p>Side words</p></div><aside><p>Aside words.</p></aside>'
    '{body}<form action="/s"><p>Your mail</p><select><option>One<option>Two</select></form>'
    '<section class="comments"><h2>Comments</h2><p>{comment}</p></section><footer>&copy; Site</footer></body></html>'
)


def page(body, comment="I agree."):
    return AROUND.format(body=body, comment=comment)


@pytest.mark.parametrize("body", [
    f"<article>{ARTICLE}</article>", f'<div class="post-body item7">{ARTICLE}</div>', f"<main><div><section>{ARTICLE}</section></div></main>",
    f'<article><div hidden>no</div><div style="display: none"><p>no</p></div>{ARTICLE}<div class="share social"><a href="x">Share</a></div></article>',
    f'<div class="content has-sidebar">{ARTICLE}<span class="ad">Buy</span><button>Click</button></div>',
    f"<table><tr><td><a href='/x'>Home</a><td><div>{ARTICLE}</div></table>",
])
def test_article_alone(body):
    assert Page(page(body)).text([]) == ARTICLE_TEXT


def test_hosts_agree(spark):
    """Where readers wrote more than the author, the page alone is wrong and the host's other pages are right."""
    plain = '<div class="story n{i}">{body}</div><div class="talk n{i}">{talk}</div>'
    short, long = "<p>Short story.</p>", "".join(f"<p>Word {i} of a long text that goes on and on.</p>" for i in range(9))
    rows = [(i, f"http://www.h.example/{i}", plain.format(i=i, body=long, talk=short)) for i in range(9)]
    rows += [(20, "https://H.example:80/x", plain.format(i=20, body="<p>Short story.</p>", talk=long))]
    rows += [(30, "http://other.example/", plain.format(i=30, body="<p>Short story.</p>", talk=long)), (40, None, f"<div>{short}</div>"), (50, "nothing", "loose words")]
    pages = literal_rows(spark, rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["main_text"] for r in pagetext.extracted(pages).collect()}
    assert found[20] == "Short story." and found[0] == Page(long).text([])
    assert found[30] == Page(long).text([])  # nobody to agree with
    assert found[40] == "Short story." and found[50] == "loose words"
    counted = {(r["host"], r["path"]): r["votes"] for r in pagetext.votes(pages).collect()}
    assert counted == {("h.example", ">div.n0.story"): 9, ("h.example", ">div.n0.talk"): 1, ("other.example", ">div.n0.talk"): 1}


def test_second_template_of_a_host(spark):
    body = "".join(f"<p>Sentence {i} of some length.</p>" for i in range(5))
    rows = [(i, "http://h.example/", f"<main>{body}</main>") for i in range(20)] + [(90, "http://h.example/", f'<div class="old">{body}</div>')]
    found = pagetext.extracted(literal_rows(spark, rows, "page_id long, url string, html string")).collect()
    assert {r["main_text"] for r in found} == {Page(body).text([])}


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p>cut <b", "cut"), ("<p>x<!-- open", "x"), ("<script>never closed <p>x", ""),
    ("<p title='a > b'>x</p>", "x"), ("<p title=\"open>x</p>", "x"), ("</div></p>x", "x"), ("<ul><li>a<li>b</ul>", "a\n\nb"),
    ("<form id=aspnetForm><p>All of it.</p></form>", "All of it."), ("<p>&amp;lt; &unknown; &#xD800; &amp</p>", "&lt; &unknown; � &"),
    ("<nav>only a menu</nav>", ""), ("<P>Upper</P><SCRIPT>x</SCRIPT>", "Upper"), ("<pre>a\n  b</pre>", "a b"), ("<x-story><p>own element</p></x-story>", "own element"),
])
def test_odd_markup(html, text):
    assert Page(html).text([]) == text


def test_hostile_pages_take_linear_time():
    started = time.perf_counter()
    deep = "<div class=a1>" * 30_000 + "x"
    assert Page(deep).text([]) == "x" and max(map(len, Page(deep).paths)) <= pagetext.LONGEST_PATH
    for html in ("<" * 300_000, "<p a='" * 60_000, "<a href=\"x" * 60_000, "</div>" * 60_000, "<p>" * 60_000, "<b" * 100_000, "&" * 300_000):
        Page(html).text([])
    assert time.perf_counter() - started < 30


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "http://a.example/", "<p>x</p>", 2), (1, "http://a.example/", "<p>x</p>", 2), (2, "http://a.example/", "", 3), (3, "", "<p>y", 4)]
    pages = literal_rows(spark, rows, "page_id long, url string, html string, main_text long").withColumnRenamed("page_id", "host")
    found = pagetext.extracted(pages)
    assert found.columns == [*pages.columns, "_main_text"]
    assert sorted(r["_main_text"] for r in found.collect()) == ["", "", "x", "x", "y"]
    assert pagetext.extracted(pages.limit(0)).count() == 0
