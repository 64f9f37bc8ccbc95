import pytest
from pyspark.sql import functions as F

from folioscope.functions import html, markdown
from folioscope.operators import pages


def apply(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_ranges_and_links(spark):
    body = "a `$x$` $y^2$ é [t](u) ![i](p.png \"T\") \n```\n[no](x)\n```\n$5 and $6"
    (math,) = apply(spark, markdown.math_ranges, body)
    assert [(body[m.start : m.end], m.value) for m in math] == [("$y^2$", "$y^2$")]
    (links,) = apply(spark, markdown.links, body)
    assert [(x.image, x.label, x.target, body[x.start : x.end]) for x in links] == [(False, "t", "u", "[t](u)"), (True, "i", "p.png", '![i](p.png "T")')]


def test_plain_text(spark):
    got = apply(spark, markdown.plain_text, "# T\n\n- **bold** and *it* `c`<br>x ![a](b) [l](m)\n> q")
    assert got == ["T bold and it c x l q"]


def test_alignment(spark):
    rows = [("# A\n\np\n\n```\nx\n```", "# B\n\nq\n\n```\nx\n```"), ("# A\n\np", "# B"), ("# A\n\n```\nx\n```", "p\n\n```\ny\n```")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(markdown.alignment_errors(markdown.blocks(F.col("a")), markdown.blocks(F.col("b")))).collect()]
    assert got == [[], ["2 blocks, 1"], ["0: heading, paragraph", "1: changed"]]


def test_lead(spark):
    df = spark.createDataFrame([("Body text.", "A dek.", "p.png"), ("A dek. Body ![](p.png)", "A dek.", "p.png"), ("Body", None, None)], "b string, d string, p string")
    got = [tuple(r[0]) for r in df.select(markdown.with_lead(F.col("b"), F.col("d"), F.col("p"))).collect()]
    assert got == [("merged", "A dek.\n\n![](p.png)\n\nBody text."), ("unchanged", "A dek. Body ![](p.png)"), ("unchanged", "Body")]


PAGE = """<html><head><title>Head &amp; Site</title><meta property="og:title" content="Head"><meta content="A. B." name="author">
<script type="application/ld+json">{"headline": "H", "description": "D", "datePublished": "2026-01-01"}</script></head>
<body><main><a href="/x">many linked words are here in the page</a></main><article><h1>Head</h1><p>Some long text that is not linked at all.</p></article></body></html>"""


def test_claims_and_main_part(spark):
    (c,) = apply(spark, html.claims, PAGE)
    assert tuple(c) == ("Head", "D", "A. B.", "2026-01-01", None)
    assert apply(spark, html.shown_title, PAGE) == ["Head"]
    assert apply(spark, lambda h: html.text(html.main_part(h)), PAGE) == ["Head Some long text that is not linked at all."]


@pytest.mark.parametrize("url, target", [
    ("https://b.org/", "https://b.org/"), ("//b.org/x", "https://b.org/x"), ("/r", "https://a.org/r"), ("s", "https://a.org/p/s"), ("../s", "https://a.org/s"),
    ("./s?q", "https://a.org/p/s?q"), ("#f", "https://a.org/p/q?z#f"), ("?y", "https://a.org/p/q?y"), ("mailto:x@y.z", None), ("javascript:1", None),
])
def test_absolute(spark, url, target):
    assert apply(spark, lambda u: html.absolute(u, F.lit("https://a.org/p/q?z#old")), url) == [target]


@pytest.mark.parametrize("url, key", [
    ("https://c.org/w_300/https%3A%2F%2Fo.org%2Fa%2Fpic.jpg", "a/pic.jpg"), ("https://o.org/a/Pic-300x200.webp?x=1", "a/pic.webp"), ("https://o.org/x/a/pic-scaled.PNG", "a/pic.png"),
    ("https://o.org/b/pic-e1234567890-20x20.jpg", "b/pic.jpg"), ("https://o.org/_next/image?w=2&url=%2Fm%2Fpic.jpg&q=1", "m/pic.jpg"), ("https://o.org/p?url=https%3A%2F%2Fq.org%2Fr%3Furl%3Dhttps%253A%252F%252Fs.org%252Ft%252Fu.png", "t/u.png"),
    ("https://o.org/cdn-cgi/image/w=5/https://s.org/t/u.png", "t/u.png"), ("https://o.org/one.jpg", "one.jpg"), ("https://o.org/", None), ("pic.jpg", None), (None, None), ("https://o.org/a/1.png", "a/1.png"), ("https://o.org/b/1.png", "b/1.png"),
])
def test_picture_key(spark, url, key):
    assert apply(spark, html.picture_key, url) == [key]


def test_search_needs_every_term(spark):
    docs = spark.createDataFrame([(1, "red fox", "x"), (2, "red", "fox fox"), (3, "red", None)], "doc_id int, title string, body string")
    got = pages.matching_all(pages.search_index(docs, ["title", "body"]), ["red", "fox"])
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 3)]
