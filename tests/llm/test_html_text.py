"""Blocks on hand-made pages, alignment against brute force, differencing over ranges."""

import html as h
import random
import re

from fieldloom.llm import html_text as t
from fieldloom.llm import queries

SF = "/root/testdata/sf0.01"


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>no &amp; no</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice"><p>We use cookies</div>
    <article id=x><header><h1>Head&amp;amp;line</h1></header><p><b>One<br>two &eacute;&#33; <i>th</i>ree<p>Four <script>var a="</p><p>no";</script>five
    <!-- <p>no</p> --><div class='ad'><div>no</div></div><ul><li>a<li>b</ul><a title="x>y">link</a> &lt;b&gt;
    <form><input name=q><label>no</label></form><section class="comments"><p>no</p></section></p>last &nbsp; one</article>
    <aside>no</aside><footer>no</footer></body>"""
    content, undecided, seen = t.blocks(page)
    assert seen and undecided == []
    assert content == ["Head&amp;line", "One two é! three", "Four five", "a", "b", "link <b>", "last one"]
    assert t.blocks("") == ([], [], False)
    assert t.blocks("plain  text\n<p>and <em>m</em>ore") == ([], ["plain text", "and more"], False)
    assert t.blocks("<p>a</p><script>never closed <p>b") == ([], ["a"], False)
    assert t.blocks('<p class="x>broken <p>b</p>')[1]
    assert t.blocks("<p>" * 30_000 + "x") == ([], ["x"], False)


def test_names_that_only_hold_a_mark_lose_no_article():
    for page in (
        '<div class="content has-sidebar"><article><p>Kept</article></div>',
        '<article class="post comments-open"><p>Kept</article>',
        '<div id="search-results"><article><p>Kept</article></div>',
        '<article><p class="ad-hoc">Kept</article>',
        '<article><p class="social-history">Kept</article>',
        '<article><xmp>Kept</xmp></article>',
        '<article><p><math><mi>Ke</mi><mi>pt</mi></math></article>',
    ):
        assert t.blocks(page)[0] == ["Kept"], page
    assert t.blocks("<article><xmp>a <b>&amp; c</xmp>d</article>")[0] == ["a <b>&amp; c", "d"]
    for name in ("ad", "AD-slot", "cookie-notice", "share_buttons", "x sidebar", "comment-list", "newsletter-box"):
        assert t.blocks(f'<article><p>Kept</p><div class="{name}">no</div></article>')[0] == ["Kept"], name


def lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    r = random.Random(0)
    for n in range(400):
        monkeypatch.setattr(t, "TABLE_BITS", 9 if n % 2 else 1 << 26)
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        got = sorted(t.shared_lines(a, b))
        assert len(got) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def bare_page(k):
    return f"<div>Menu</div><div>Shop news</div><p>Own text {k}</p><div>Contact us</div>"


def test_differencing_finds_the_nearest_url(spark, monkeypatch):
    monkeypatch.setattr(t, "PAGES_PER_RANGE", 7)
    rows = [(k, f"https://Hot.example.org/a/{k:04d}.html?x={k}", bare_page(k), 0) for k in range(40)]
    rows += [(100, "http://one.example.org/p", bare_page(100), 0), (101, None, bare_page(101), 0), (102, "http://two.example.org/", None, 0), (103, "http://two.example.org/b", "", 0)]
    rows += [(104, "http://c.example.org/a", "<p>same", 0), (105, "http://c.example.org/b", "<p>same", 0), (105, "http://c.example.org/b", "<p>same", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in t.extract(df).collect()}
    assert t.extract(df).count() == len(rows)
    for k in range(40):
        assert got[k].text == f"Own text {k}" and got[k].n_chars == len(got[k].text)
    whole = "Menu\nShop news\nOwn text {}\nContact us"
    assert got[100].text == whole.format(100) and got[101].text == whole.format(101) and got[102].text == got[103].text == ""
    assert got[104].text == got[105].text == "same"
    assert t.extract(df.limit(0)).count() == 0


def test_an_article_that_another_page_shares_stays(spark):
    page = "<div>Shop news</div><article><p>Same story</article><p class=comment>no</p>"
    rows = [(k, f"http://x.example.org/{k}", page) for k in range(3)]
    got = [r.text for r in t.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert got == ["Same story"] * 3


def test_a_very_long_page(spark):
    lines = [f"<p>line {k % 700}" for k in range(9_000)]
    rows = [(0, "http://x.example.org/a", "".join(lines)), (1, "http://x.example.org/b", "".join(lines[::-1]) + "<p>own")]
    got = {r.page_id: r.text.split("\n") for r in t.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][-1] == "own" and 0 < len(got[1]) < 9_001


def test_differencing_decides_beside_a_content_element(spark):
    page = lambda k: f"<div>Shop news</div><article><p>Teaser {k}<p>Licence</article><div>Body text {k}</div><div>Contact us</div>"
    rows = [(k, f"http://x.example.org/{k}", page(k)) for k in range(6)] + [(9, "http://alone.example.org/", page(9))]
    got = {r.page_id: r.text for r in t.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.pop(9) == "Shop news\nTeaser 9\nLicence\nBody text 9\nContact us"
    assert got == {k: f"Teaser {k}\nLicence\nBody text {k}" for k in range(6)}


def test_query_on_the_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op5_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        want = [" ".join(h.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|li|ul|div)[^>]*>", body)]
        assert r.text == "\n".join(x for x in want if x) and r.url == pages[r.page_id].url
