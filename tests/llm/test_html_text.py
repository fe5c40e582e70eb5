import random
import re
import time

import numpy as np
import pytest
from fixtures import clashing

from seamline.llm import html_text, queries
from seamline.llm.html_text import main_text, regions

LONG = "A sentence of the article that has enough text to make a window of lines surge, and then some more."


def test_regions_by_definition():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.choice([0, 0, 0, -20, 5, 30, 90], rng.integers(0, 30))
        got = regions(x, 80)
        sums = [x[k : k + 3].sum() for k in range(len(x))]
        least = max(1, min(80, 0.25 * max(sums, default=0)))
        inside = set()
        for a, b in got:
            assert x[a] > 0 and sums[a] >= least and x[b + 1 : b + 4].sum() <= 0
            assert all(sums[k] > 0 for k in range(a, b + 1))
            inside |= set(range(a, b + 1))
        assert all(i in inside for i in range(len(x)) if x[i] > 0 and sums[i] >= least)


def test_surge_and_dive_decide(sf, spark):
    from pyspark.sql import functions as F

    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    # The same pages without the elements and names that say what is what: the distribution alone finds the article.
    plain = lambda p: re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", p).replace('class="ad"', "")
    found = 0
    for p in pages:
        lines = [x for x in html_text.lines_of(plain(p)) if not x.away]
        kept = main_text(plain(p)).split("\n")
        assert set(kept) <= {x.text for x in lines}
        found += set(main_text(p).split("\n")) <= set(kept)
        assert len(kept) < len(lines), "menus weigh nothing: a page is never kept whole"
    assert found >= 0.97 * len(pages)


def test_linear_on_hostile_pages():
    n = 40000
    began = time.time()
    for page in ("<a " * n, "<div>" * n + "</span>" * n, "<!" * n, "<p><div>" + "<b>" * n + "<div></div>" * n, "<ul>" + "<div>" * n + "<li></li>" * n, "<p title=\"x" * n, "<script" * n, "</script" * n, "<!--" * n, "&" * n, "<a href='" * n, "< " * n, "<script>" + "</script" * n, "<p>" * n + "</p>" * n, "class=" * n):
        main_text(page)
        main_text(f"<article>{page}</article>")
    assert time.time() - began < 60
    assert main_text("<article><p title=\"abc>in</p></article>") == "in"
    big = "<article>" + f"<p>{LONG}</p>" * 50_000 + "</article>"
    assert len(main_text(big)) == 50_000 * (len(LONG) + 1) - 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
        (f"<article><h1>Title</h1><p>{LONG}</p></article>", f"Title\n{LONG}"),
        ("<article><p>Short.</p><p>a &lt;b&gt; &amp;amp; &copy;&nbsp;c</p></article>", "Short.\na <b> &amp; © c"),
        ("<article><p>one\n  two<br>three<p>four <b>bo</b>ld</article>", "one two three\nfour bold"),
        ("<article><p>in</p><div class='ad'>Buy this now</div><p>out</p><aside>side</aside><form><p>mail</p></form></article>", "in\nout"),
        ("<article><p>in</p><section id=comments><p>First!</p><article>me too</article></section></article><footer>f</footer>", "in"),
        ("<article><p>x<script>var t='</p><p>no';</script>y<style>p{}</style><!-- <p>no --></p></article>", "xy"),
        ("<body><div class='cookie-notice'>We use cookies</div><main><p>text 1 < 2</p></main></body>", "text 1 < 2"),
        (f"<body><div>Home | News</div><ul><li><a href=a>link one is long</a></li><li><a href=b>link two</a></li></ul><div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div class=footer>bye</div></body>", f"{LONG}\nYes.\n{LONG}"),
        ("<article><p>unclosed <i>tags", "unclosed tags"),
        ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>", "a b\nc"),
        ("<div class='layout has-sidebar no-ads'><article><div class=post-header><h1>T</h1></div><p>x</p></article><div class='main-sidebar'>s</div></div>", "T\nx"),
        ("<body><div id=wrap><div class=site-header>Site</div><p>Short text.</p></div></body>", "Short text."),
        (f"<div id=w><p>{LONG}</p><div class=advert>Buy</div><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div></div>", f"{LONG}\n{LONG}"),
        ("<article><header><h1>Head</h1></header><p>body</p></article>", "Head\nbody"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_random_pages():
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "beta", "x", "Über", "a&b", "1 < 2", "c"])
    para = lambda: " ".join(word() for _ in range(rng.randint(1, 40)))
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    junk = ["<nav><ul><li><a href='/'>Home</a></ul></nav>", "<div class='ad banner'>Ad text that goes on</div>", "<aside><p>Side note text</p></aside>", "<form action=x>Name <input></form>", "<!-- c --><script>if (a<b) { '</p>' }</script>", "<div id='newsletter-signup'><p>Join</p></div>", "<div role=navigation>x</div>"]
    for _ in range(200):
        paras = [para() for _ in range(rng.randint(1, 8))]
        body = "".join(f"<p>{esc(p)}</p>" + (rng.choice(junk) if rng.random() < 0.3 else "") for p in paras)
        page = f"<html><head><title>T</title></head><body>{rng.choice(junk)}<article>{body}</article>{rng.choice(junk)}<div class=comments><p>{para()}</p></div></body></html>"
        assert main_text(page) == "\n".join(paras)


def test_frame(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article>" + "<p>w</p>" * 20000 + "</article>"), (3, "u", "<article><p>é€</p></article>"), (None, "u", "<p>")]
    d = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_text.extract(d)
    assert got.columns == [*d.columns, "text", "n_chars"]
    out = got.collect()
    assert [r["n_chars"] for r in out] == [0, 0, 39999, 2, 0] and all(r["text"] is not None and r["_id"] == "mine" for r in out)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op1_html_main_text(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]])[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><h1>Short headline</h1><div class=share>Share this</div><p>{LONG}</p></body>", f"Short headline\n{LONG}"),
        (f"<body><p>{LONG}</p><div class=advert>Buy</div><p>The end.</p><div class=footer>bye</div></body>", f"{LONG}\nThe end."),
        ("<article><p>in</p><section id='discussion'><h2 id='related-work'>Related work</h2><p>a</p></section><section id='social-impact'><p>b</p></section><h2 id=search-strategy>Search</h2></article>", "in\nRelated work\na\nb\nSearch"),
        ("<article><p>one</p><p class=alert>two</p><p class='lead follow'>three</p><div class=search>Find</div><ul class=notices><li>four</li></ul></article>", "one\ntwo\nthree\nfour"),
        ("<article><p>in</p><section class=related id=more><p>x</p></section><section id=comments><p>y</p></section></article>", "in"),
    ],
)
def test_short_blocks_and_anchors_stay(page, text):
    assert main_text(page) == text
