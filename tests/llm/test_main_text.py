import random

import numpy as np
from pyspark.sql import functions as F

from hopledger.llm.main_text import blocks, covered, main_text, settle_pages, suffix_array


def kept(html):
    return settle_pages([blocks(html)])[0]


def test_suffix_array_against_sorting():
    draw = random.Random(1)
    for n in (1, 2, 7, 60, 300):
        tokens = np.array([draw.randrange(4) for _ in range(n)])
        assert suffix_array(tokens).tolist() == sorted(range(n), key=lambda k: tokens[k:].tolist())


def test_cover_against_brute_force():
    draw = random.Random(2)
    for _ in range(60):
        pages = [[draw.randrange(3) for _ in range(draw.randrange(0, 25))] for _ in range(5)]
        tokens = np.array([t for p in pages for t in p], np.int64)
        page = np.array([k for k, p in enumerate(pages) for _ in p], np.int64)
        where = {}
        for k, p in enumerate(pages):
            for i in range(len(p) - 3):
                where.setdefault(tuple(p[i:i + 4]), set()).add(k)
        expected = []
        for p in pages:
            mark = [False] * len(p)
            for i in range(len(p) - 3):
                if len(where[tuple(p[i:i + 4])]) >= 3:
                    mark[i:i + 4] = [True] * 4
            expected += mark
        assert covered(tokens, page, 4, 3).tolist() == expected


def test_article_without_the_rest():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body>
    <header><a>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice"><p>We use cookies</p></div><!-- <p>no</p> -->
    <article class="post"><header><h1>Head &amp;amp; line</h1></header><p>First&nbsp;  para<b>graph</b> &lt;b&gt;<br>next<p class=lead>Second
    one<div class="ad">Buy</div><blockquote>Said &eacute;</blockquote><ul><li>a<li>b</ul><aside>Side</aside><form>Name <input></form>
    <table><tr><td>x<td>y</table><footer>By me</footer></article><section id="comments"><article class="comment">I agree</article></section>
    <footer>&copy; 2024</footer></body></html>"""
    assert kept(html).split("\n") == ["Head &amp; line", "First paragraph <b> next", "Second one", "Said é", "a", "b", "x", "y"]


def test_broken_markup_does_not_lose_text():
    assert kept("<article><p>a <b>b</p><p title='x>c</p></article>").startswith("a b")
    assert kept("plain < text & more") == "plain < text & more"
    assert kept("<form action=x><main><p>inside</p></main></form>") == "inside"
    assert kept("<script>never closed <p>x</p>") == "" and kept("") == ""


def test_custom_and_unclosed_elements_do_not_lose_text():
    for name in ("svg-icon", "video-player", "audio-player", "title-bar", "select-box"):
        assert kept(f"<article><p>a</p><{name} x=y></{name}><p>rest</p></article>") == "a\nrest"
    for name in ("video", "object", "select", "noscript", "svg", "audio"):
        assert kept(f"<article><p>a</p><{name}><p>rest</p></article><nav>menu</nav>") == "a\nrest"
        assert kept(f"<article><p>a</p><{name} x=y>gone<b>too</b></{name}><p>rest</p></article>") == "a\nrest"
    assert kept("<article><p>a<svg/>b</p><svg><g>x</g></svg></article>") == "ab"
    assert kept("<article><p>a</p><style>never closed <p>x</p></article>") == "a"


def test_boilerplate_without_an_article_is_found_by_repetition(spark):
    menu, foot = "home news sport weather about us contact", "all rights reserved by the owners of this site"
    rows = [(k, f"https://h.example/{k}", f"<div>{menu}</div><div>text number {k} is unlike any other text {k * 7}</div><div>{foot}</div>")
            for k in range(300)]
    rows += [(900, "https://other.example/", f"<div>{menu}</div><p>alone here</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(found[k] == f"text number {k} is unlike any other text {k * 7}" for k in range(300))
    assert found[900] == f"{menu}\nalone here"


def test_copies_of_an_article_stay(spark):
    html = "<nav>a b c d e f g h</nav><article><p>the very same article on many pages of one host</p></article>"
    df = spark.createDataFrame([(k, "https://h.example/x", html) for k in range(9)], "page_id long, url string, html string")
    assert {r.text for r in main_text(df).collect()} == {"the very same article on many pages of one host"}


def test_repetition_decides_around_articles_and_leaves_them_whole(spark):
    menu, notice = "home news sport weather about us contact", "please support our work with a small gift today"
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    html = lambda k: (f"<div>{menu}</div><div>{body(k)}</div>"  # noqa: E731
                      f"<article class=teaser><p>{body(k + 1000)}</p><p>{notice}</p></article><div>alone {k}</div>")
    rows = [(k, f"https://h.example/{k}", html(k)) for k in range(9)]
    # Copies of one page, and of one article with small changes, are not boilerplate.
    rows += [(100 + k, "https://h.example/c", f"<div>{body(5000)}</div>") for k in range(9)]
    rows += [(200 + k, "https://h.example/d", f"<article><p>{body(6000)}</p><p>version {k}</p></article>") for k in range(9)]
    found = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(9):
        assert found[k] == f"{body(k)}\n{body(k + 1000)}\n{notice}\nalone {k}"
        assert found[100 + k] == body(5000)
        assert found[200 + k] == f"{body(6000)}\nversion {k}"


def test_an_article_is_kept_in_any_wrapper_that_is_not_named():
    for wrapper in ('div class="layout has-sidebar"', 'div class="ad-free content"', 'div id=related-work-page', "dialog open", "form action=x", "body class=menu"):
        assert kept(f"<{wrapper}><div><article><h1>head</h1><p>hello world</p></article></div></{wrapper.split()[0]}>") == "head\nhello world"
    inside = '<article><div class="social-science"><p>about it</p></div><p class="share-price">rose</p><div class="share">Share</div></article>'
    assert kept(inside) == "about it\nrose"
    for wrapper in ("aside", 'div class="comments list"', 'section id="sidebar"', "nav", "dialog", "div hidden", 'div role="complementary"'):
        assert kept(f"<article>main</article><{wrapper}><article>card</article></{wrapper.split()[0]}>") == "main"
    # A hint drops what stands around an article, and nothing of a page without one.
    assert kept('<div class="site-footer">foot</div><article>main</article>') == "main"
    assert kept('<div class="site-footer">foot</div><p>main</p>') == "foot\nmain"


def test_article_text_stays_however_often_it_is_repeated(spark):
    head = "the same seven words head every article"
    rows = [(k, f"https://h.example/{k}", f"<article><h1>{head}</h1><p>Les.</p><p>text {k}</p></article>") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in main_text(df).collect()} == {k: f"{head}\nLes.\ntext {k}" for k in range(200)}


def test_shards_give_the_same_texts_as_one(spark):
    draw = random.Random(5)
    lines = [" ".join(f"v{draw.randrange(50)}" for _ in range(draw.randrange(3, 12))) for _ in range(60)]
    rows = []
    for k in range(150):
        own = [" ".join(f"u{k}x{j}x{i}" for j in range(12)) for i in range(6)]
        rest = [f"<p>{draw.choice(lines)}</p>" for _ in range(draw.randrange(3))] + [f"<p>{t}</p>" for t in own]
        draw.shuffle(rest)
        cut = draw.randrange(len(rest))
        html = "".join(rest) if k % 3 else "".join(rest[:cut]) + "<article>" + "".join(rest[cut:]) + "</article>"
        rows += [(1000 * k + c, f"https://h.example/{k}", html) for c in range(draw.choice((1, 1, 1, 4)))]
    notice = "this notice stands on three pages of the host only"
    rows += [(10**6 + k, "https://h.example/n", f"<p>alone {k}</p><p>{notice}</p>") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ({r.page_id: r.text for r in main_text(df, shard_pages=n).collect()} for n in (10**6, 5))
    assert one == many and len(one) == len(rows)
    assert all(many[10**6 + k] == f"alone {k}" for k in range(3))
    assert any(len(many[i].split("\n")) < html.count("<p>") for i, _, html in rows[:-3])


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "https://a", "<p>x"), (4, "https://a", "<p>" + "long words " * 50_000), (4, "https://a", "<p>y</p>"),
            (4, "https://a", "<p>y</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("host"), F.lit(3).alias("n"))
    found = sorted(((r.page_id or -1, r.n_chars) for r in main_text(df).collect()))
    assert found == [(-1, 1), (1, 0), (2, 0), (4, 1), (4, 1), (4, 549_999)]
    assert main_text(df.limit(0)).count() == 0
