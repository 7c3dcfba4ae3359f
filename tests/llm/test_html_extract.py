import pytest

from provender.llm import html_extract as H

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{{}}</style>
<script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy</div><header>Site</header>
<article><h1>Head {n}</h1><p><b>One &lt;two&gt;
  three&nbsp;{n}</b> four<br><p>Five{n} long enough to be the main part of it<i>six</i> {body}</p><aside>aside</aside><form><p>Name</p></form>
<div class="comments"><p>First!</p></div></article><div id="sidebar"><p>side</p></div><footer>&copy; me</footer></body></html>"""
TEXT = "Head {n}\nOne <two> three {n} four\nFive{n} long enough to be the main part of itsix {body}"


def test_main_text():
    assert H.main_text(PAGE.format(n=1, body="b")) == TEXT.format(n=1, body="b")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a\nb"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut</p><foo", "cut"),
        ("<article><p>a < b and c<d</p></article>", "a < b and c"),
        ("<p>x</p><script>never closed <p>y</p>", "x"),
        ("<article><header><h1>Title</h1></header><p>x</p></article>", "Title\nx"),
        ("<div hidden>no</div><p title='a > b'>yes</p>", "yes"),
        ("<main><p>&#72;i &#x49; &amp;amp; &copy 1</p></main><p>out</p>", "Hi I &amp; © 1"),
        ("<ul><li>one<li>two</ul></p>three", "one\ntwo\nthree"),
        ("<div class='article-body'>a</div><div class='post-comments'>b</div>", "a"),
    ],
)
def test_odd_pages(page, text):
    assert H.main_text(page) == text


def test_long_and_broken_pages_take_linear_time():
    for page in ("<p>" * 40_000, "<a href='" * 40_000, "<!--" * 40_000, "<" * 200_000, "&" * 200_000):
        H.main_text(page)


@pytest.mark.parametrize("tag", ["<div class='row col'>", "<span>", "<article>", "<main><article class='a b'>"])
def test_nested_pages_take_bounded_memory(tag):
    import tracemalloc

    page = tag * 20_000 + "<p>The text.</p>"
    tracemalloc.start()
    found, text = H.tokens(page), H.main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text == "The text." and len(found) > 20_000
    assert max(len(path) for _, _, path in found) <= H.MAX_PATH + 20
    assert peak < 100e6


def test_long_paths_keep_their_outer_elements_and_differ():
    path, seen = "", set()
    for depth in range(2_000):
        path = H.path_below(path, f"div.c{depth % 3}")
        seen.add(path)
    assert len(seen) == 2_000
    assert all(p.startswith("/div.c0/div.c1/") for p in seen if len(p) > 20)
    assert H.path_below(path, "p") != H.path_below(path, "q")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main><p>The text.</p><article class='comment'><p>Me too</p></article></main>", "The text."),
        ("<article><p>The text.</p><article class='comment even' id='c1'><p>No</p></article></article>", "The text."),
        ("<main><p>The text.</p><article id='comment-12'><p>Me too</p></article></main>", "The text."),
        ("<main><article class='reply'><article><p>The text.</p></article></article></main>", "The text."),
        ("<article class='post has-comments'><p>The text.</p></article>", "The text."),
        ("<p>The text.</p><div class='cookie-law'>Cookies</div><div id='discussion'><p>No</p></div>", "The text."),
        ("<p>The text.</p><ol class='commentlist'><li>No</ol>", "The text."),
    ],
)
def test_comments_and_notices_are_left_out(page, text):
    assert H.main_text(page) == text


SCHEMA = "page_id long, url string, html string, host string"


def site(n):
    fixed = '<div class="x"><p>Subscribe to all our letters</p></div>'
    return [
        (i, f"https://Host.example/{i}", PAGE.format(n=i, body=f"body {i % 5}").replace("</h1>", "</h1>" + fixed), "h")
        for i in range(n)
    ]


def test_template_texts_are_no_slots(frame):
    rows = site(12) + [(100, "http://small.example/", site(1)[0][2], "h"), (101, None, None, ""), (None, "x", "", ""), (0, *site(1)[0][1:])]
    got = {(r["page_id"], r["url"]): r["text"] for r in H.extract(frame(rows, SCHEMA)).collect()}
    for i in range(12):
        assert got[i, f"https://Host.example/{i}"] == TEXT.format(n=i, body=f"body {i % 5}")
    # Too few pages to tell what is fixed.
    assert "Subscribe" in got[100, "http://small.example/"]
    assert got[101, None] == "" and got[None, "x"] == ""
    assert H.extract(frame(rows, SCHEMA)).count() == len(rows)
    assert {r["n_chars"] - len(r["text"]) for r in H.extract(frame(rows, SCHEMA)).collect()} == {0}


def test_copies_of_one_article_are_kept(frame):
    rows = [(i, f"http://a/{i}", PAGE.format(n=1, body="same"), "") for i in range(14)]
    texts = {r["text"] for r in H.extract(frame(rows, SCHEMA)).collect()}
    assert texts == {TEXT.format(n=1, body="same")}


def test_joined_templates_give_the_same(frame, monkeypatch):
    df = frame(site(15), SCHEMA)
    want = sorted(map(tuple, H.extract(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_TEXTS", 0)
    assert sorted(map(tuple, H.extract(df).collect())) == want


def test_texts_of_some_pages_are_kept(frame):
    """A passage on most pages of a host is no template: its vector is that of no tags."""
    rows = [(i, f"http://a/{i}", f"<body><article><p>own {i}</p>{'<p>common passage</p>' if i % 4 else ''}</article></body>", "") for i in range(24)]
    for r in H.extract(frame(rows, SCHEMA)).collect():
        assert ("common passage" in r["text"]) == (r["page_id"] % 4 != 0)


def test_classes_are_nested(frame):
    from pyspark.sql import functions as F

    pages = frame(site(12), SCHEMA).select(F.lit("h").alias("host"), "html")
    rows = H.templates(pages).collect()
    assert {r["below"] for r in rows if r["class"] == 0} == {None}
    assert all(r["below"] is not None and r["below"] < r["class"] for r in rows if r["class"])


def test_empty(frame):
    assert H.extract(frame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("attributes", [
    "div class='content-sidebar-wrap'", "div class='main with-sidebar'", "div class='has-header'", "section class='no-comments'",
    "main class='widget'", "article class='post no-comments'", "article class='teaser'",
])
def test_names_do_not_drop_the_article(attributes):
    page = f"<body><{attributes}><p>The text.</p></{attributes.split()[0]}></body>"
    assert H.main_text(page) == "The text."


def test_a_named_wrapper_of_the_article_stays_and_named_parts_go():
    page = """<body><div class="sidebar"><div id="site-header">Top</div><main><article class="post"><p>The text.</p></article>
    <div id="comments" class="comments-area"><article class="comment-body"><p>Me too</p></article></div></main>
    <div class="sidebar-1">Side</div><div class="cookie-banner">Cookies</div></div></body>"""
    assert H.main_text(page) == "The text."
