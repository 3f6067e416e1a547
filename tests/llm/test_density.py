"""Main text of hand-written pages, of the given pages against their known frame, and of broken pages."""

import random
import re
from html import unescape

from sparkmill.llm import density as D
from sparkmill.llm.common import table
from tests.conftest import SF01

LONG = "A sentence of the article that goes on for a while, with commas, so that it is dense. " * 3


def test_article_among_everything_else():
    page = f"""<!doctype html><html><head><title>T</title><style>p>{{}}</style><script>if (a<b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
    <header class="top"><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use cookies.</div><div id=adSlot1 class=ad>Buy {LONG}</div>
    <main><article class="post no-comments"><header><h1>Ti&shy;tle &amp; more</h1><p>by me</p></header><p>One<br>two <b>th</b>ree&nbsp;four<p>{LONG}<ul><li>item 1<li>item <i>2</i></ul>
    <table><tr><td>a<td>b<tr><td>c</table><form><input value=x>Send</form><aside>Side</aside><blockquote>Short.</blockquote><div class="share-buttons">Share</div>
    <section class="comments"><p>Reader says {LONG}</p></section></article></main><div class="sidebar"><p>{LONG}</p></div><footer>&copy; us</footer></body></html>"""
    want = ["Ti\xadtle & more", "One two three four", LONG.strip(), "item 1", "item 2", "a b", "c", "Short."]
    assert D.main_text(page).split("\n") == want


def test_without_article_tags():
    page = f"""<body><div class=a><a href=1>Home</a> <a href=2>News</a> <a href=3>About us</a></div><div class=b><h2>Head</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>
    <ul><li><a href=1>Other story</a><li><a href=2>Another story</a></ul></div><div class=c><a href=4>Imprint</a> 2020</div></body>"""
    assert D.main_text(page).split("\n") == ["Head", LONG.strip(), "Short one.", LONG.strip()]
    parts = "<body><div class=m><a href=1>x</a><a href=2>y</a></div>" + f"<section class=s><p>{LONG}</p><p>{LONG}</p></section>" * 2 + "</body>"
    assert D.main_text(parts) == "\n".join([LONG.strip()] * 4)
    assert D.main_text("only text &lt;b&gt; &#233;&eacute") == "only text <b> éé"
    assert D.main_text("<p>a<p>b") == "a\nb"


def test_broken_pages():
    cases = {None: "", "": "", "<": "<", "a < b": "a < b", "<p>x</p><a href='unclosed": "x", "<script>never closed": "", "<!-- open": "", "<!--> x -->y": "x -->y",
             "<p>a</b></div></p>b": "a\nb", "<b><p>x</b>y</p>z": "xy\nz", "<nav>only</nav>": "", "</p>x": "x", "<p>&am": "&am", "<p title=a>b>c</p>": "b>c", "<article></article><p>x</p>": "x",
             "<p>a\x00b 　 c</p>": "a\x00b c", "<textarea><p>no</p></textarea><p>yes": "yes"}
    for page, text in cases.items():
        assert D.main_text(page) == text, page
    deep = "<div>" * 20_000 + "x" + "</b>" * 20_000
    assert D.main_text(deep) == "x"
    assert D.main_text("<article>" + "<p>word <b>" * 30_000).count("\n") == 29_999
    r = random.Random(3)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b", ">", "<a href=\"", "\"", "'", "text", "<li>", "</ul>", "<td>", "<!--", "-->", "<article>", "</article>", "<script>", "</script>", "&amp", "=", "<h1>", "</", "<head>", "<body>"]
    for _ in range(2000):
        D.main_text("".join(r.choice(bits) for _ in range(r.randrange(1, 40))))


def test_given_pages(spark):
    pages = table(spark, SF01, "pages").collect()
    got = {r.page_id: r for r in D.extract(table(spark, SF01, "pages")).collect()}
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "clash"), (1, None, "<p>x", None), (None, "v", None, "c"), (2, "w", "", "c")], "page_id bigint, url string, html string, text string")
    rows = [tuple(r) for r in D.extract(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, "u", "x", 1), (1, None, "x", 1), (None, "v", "", 0), (2, "w", "", 0)], key=str)
    assert D.extract(df.limit(0)).collect() == []
