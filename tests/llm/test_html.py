import random
import time
from collections import defaultdict
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from logweave.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; &eacute;&#x41;</h1><p><b>One &lt;two&gt;<br><p>three
   four</p><div class="share">share</div><ul><li>a<li>b</ul><form><input value=q>find</form><!-- hidden --></article>
<div id="comments"><p>reader</p></div><footer>&copy; x</footer></body></html>"""


def test_article_without_fixed_roles():
    assert H.main_text(H.parse(PAGE)) == "Head & éA\nOne <two>\nthree four\na\nb"


def test_pages_without_article_and_broken_pages():
    assert H.main_text(H.parse("<body><header>h</header><p>a<p>b<aside>x</aside><div>c <i>d</i>e</div>")) == "a\nb\nc de"
    assert H.main_text(H.parse("plain &amp text")) == "plain & text"
    assert H.main_text(H.parse("<p title='x>y'>a</b></p></div><script>never closed <p>b")) == "a"
    assert H.main_text(H.parse('<p class="un>b<q>c')) == "bc"
    assert H.main_text(H.parse("")) == "" and H.main_text(H.parse("<article></article><p>x")) == "x"
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert H.main_text(H.parse(deep)) == "x"


def _text(page):
    return H.main_text(H.parse(page))


def test_names_are_whole_tokens_and_attributes_have_names():
    for attributes in (
        'class="has-sidebar"', 'id="no-sidebar"', 'class="widget-content wide"', 'class="menu-open"', 'class="overflow-hidden"',
        'data-id="menu"', 'data-role="banner"', 'title="hidden text"', 'aria-hidden="false"', 'data-hidden="1"',
    ):
        assert _text(f"<body><div {attributes}><p>kept</p></div></body>") == "kept", attributes
    for attributes in (
        'class="wide Sidebar"', "id=comments", 'class="cookie-notice"', 'class="ad-1"', "hidden", 'hidden=""', 'aria-hidden="true"',
        'style="color: red; display : none"', "role=navigation",
    ):
        assert _text(f"<body><div {attributes}><p>gone</p></div><p>kept</p></body>") == "kept", attributes


def test_named_wrappers_do_not_hide_article_or_main():
    for core in ("article", "main"):
        assert _text(f'<body><div class="widget"><p>a</p><div id="menu"><{core}><p>kept</p></{core}></div></div></body>') == "kept"
    assert _text('<body><main><div class="widget"><article>kept</article></div></main></body>') == "kept"
    assert _text('<body><article>kept</article><div id="comments"><article>reader</article></div></body>') == "kept"
    assert _text('<body><div class="widget" hidden><article>gone</article></div><p>kept</p></body>') == "kept"


def test_text_of_main_outside_its_article_stays():
    assert _text('<main><p>before</p><article>a</article><div class="ad">x</div><p>behind</p></main><p>y</p>') == "before\na\nbehind"


def _site(i, host="http://a.example"):
    # a block without any telling name, the same on all pages of a host
    return (i, f"{host}/p{i}", f"<body><div><p>Site motto</p><a href=/>go</a></div><div><p>Story {i} of its own</p><p>end</p></div></body>")


def test_templates_are_learnt_per_host(spark):
    rows = [_site(i) for i in range(12)] + [(50, "http://b.example/1", _site(1)[2]), (51, None, _site(2)[2])]
    rows += [(60 + i, "http://c.example/same", _site(3)[2]) for i in range(12)]  # copies of one page
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[4] == "Story 4 of its own" and "Site motto" in got[50] and "Site motto" in got[51]
    assert got[60] == got[71] == "Site motto\ngo\nStory 3 of its own\nend"


def test_repeated_prose_of_articles_stays(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>Unique {i}</p><p>Same words</p><div><a>x</a> box</div></article>") for i in range(20)]
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[7] == "Unique 7\nSame words"


def test_edges(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int, _host int, _page int, _template int"
    rows = [(1, None, None, "t", 1, 1, 1, 1), (None, "x", "", "t", 1, 2, 2, 2), (2, "http://u/", "<p>" + "word " * 50_000, "t", 1, 3, 3, 3)]
    out = H.extract_main_text(spark.createDataFrame(rows + rows, schema))
    assert out.columns == ["page_id", "url", "html", "_host", "_page", "_template", "text", "n_chars"]
    assert sorted(r.n_chars for r in out.collect()) == [0, 0, 0, 0, 249_999, 249_999]
    assert H.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = H.extract_main_text(pages).collect()
    assert len(rows) == pages.count() and all(r.text and r.n_chars == len(r.text) for r in rows)


def test_articles_keep_what_a_host_repeats(spark):
    body = "<p>Unique {0}</p><ul><li>same item</li></ul><table class=t><tr><td>same cell</td></tr></table><div class=notice>read this {1}</div>"
    rows = [(i, f"http://a.example/{i}", f"<article>{body.format(i, i if i % 2 else 'always')}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Unique 3\nsame item\nsame cell\nread this 3"  # a name alone does not take it out
    assert got[4] == "Unique 4\nsame item\nsame cell"


BROKEN = ["<span>x", "<a ", "<b>", "</p>", "<li><p>", "<a '", "<![CDATA[ ", "<!-- ", "<!", "<title>x", "</title", "<div><b>", "<table><tr><td>", "<"]


@pytest.mark.parametrize("piece", BROKEN)
@pytest.mark.parametrize("tail", ["", "<p>end</p>"])
def test_long_broken_pages_take_linear_time(piece, tail):
    def seconds(size):
        page = "<article>one" + piece * (size // len(piece)) + tail
        began = time.process_time()
        H.main_text(H.parse(page))
        return time.process_time() - began

    seconds(10_000)
    assert seconds(1_000_000) < 20 and seconds(800_000) < 12 * max(seconds(200_000), 0.02)


def test_two_broken_kinds_take_linear_time():
    for page in ("<b>" * 150_000 + "</p>" * 150_000, "<p><b>" * 100_000 + "</i>" * 100_000, "<span>" * 100_000 + "<p>" * 100_000):
        began = time.process_time()
        H.main_text(H.parse(page))
        assert time.process_time() - began < 20


def test_query_equals_a_plain_count(spark):
    """Subtrees counted in dictionaries, page by page: sites made of recurring blocks, and the whole given table."""
    rng = random.Random(6)
    rows = []
    for host in range(4):
        pool = [f"<{t} class=x{k}><p>box {k} of {host}</p>{'<a href=/>link</a>' if k % 2 else ''}</{t}>" for k, t in enumerate(("div", "section", "ul", "div", "table", "p", "div"))]
        for page in range(25):
            body = "".join(rng.sample(pool, rng.randrange(5))) + f"<p>own words {host} {page}</p>"
            body = f"<article>{body}</article>" if host % 2 else body
            rows += [(len(rows), f"https://H{host}.example/{page}", f"<html><body>{body}</body></html>")] * (1 + page % 2)
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").withColumn("page_id", F.col("page_id") + 1000)
    table = table.union(given)
    rows = [(r.page_id, (urlsplit(r.url or "").hostname or "").lower(), r.html or "") for r in table.collect()]
    holders, pages = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        pages[host].add(text)
        for h in H.subtree_hashes(H.parse(text)):
            holders[host, h].add(text)
    recurring = defaultdict(set)
    for (host, h), found in holders.items():
        if host and len(found) >= H.MIN_PAGES and len(found) >= H.MIN_SHARE * len(pages[host]):
            recurring[host].add(h)
    want = sorted((page, H.main_text(H.parse(text), frozenset(recurring[host]))) for page, host, text in rows)
    got = sorted((r.page_id, r.text) for r in H.extract_main_text(table).collect())
    assert got == want and all(len(recurring[f"h{host}.example"]) >= 1 for host in range(4))
