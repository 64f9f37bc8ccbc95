import pytest

from folioscope.operators.offsets import addresses, candidates, inside, page_addresses, ranges, text_ranges


@pytest.mark.parametrize("html, values", [
    ('<a href="x">', [("href", "x")]), ("<A HREF = 'x y' src=z>", [("href", "x y"), ("src", "z")]), ('<!-- <a href="x"> --><img src=p/q.png/>', [("src", "p/q.png/")]), ("5 < 6 href=\"x\"", []),
    ('<img srcset="data:image/png;base64,AA 1x, b.png 2x">', [("srcset", "data:image/png;base64,AA"), ("srcset", "b.png")]), ('<img srcset="a.png, b.png?w=1,2 800w,c.png">', [("srcset", "a.png"), ("srcset", "b.png?w=1,2"), ("srcset", "c.png")]),
    ('<a title="a>b" href="x">', [("href", "x")]), ('<a disabled href>', []), ('<!doctype html><a data-href="n" href="y"', [("href", "y")]), ('<a href="open', [("href", "open")]), ("", []), (None, []), ("<" * 5000, []), ('<a ="" href=q>', [("href", "q")]),
])
def test_addresses(html, values):
    found = addresses(html)
    assert [(n, html[a:b]) for n, a, b in found] == values


def test_candidates():
    assert candidates("") == [] and candidates(" , ") == [] and candidates("a") == [(0, 1)] and candidates("a,, b 2x ,") == [(0, 1), (4, 5)]


@pytest.mark.parametrize("text, values", [
    ("a `b` $c$ [d](e) <i>x</i>", [("code", "`b`"), ("math", "$c$"), ("target", "(e)"), ("html", "<i>"), ("html", "</i>")]),
    ("- x\n  ```\n  `y`\n  ```\n  z `w`", [("code", "```\n  `y`\n  ```"), ("code", "`w`")]), ("> ~~~\n> a\n> ~~~\n> `b`", [("code", "~~~\n> a\n> ~~~"), ("code", "`b`")]), ("1. ```\n   open", [("code", "```\n   open")]),
    ("```\n$x$\n```\n\n$$\ny\n$$", [("code", "```\n$x$\n```"), ("math", "$$\ny\n$$")]), ("- https://a.org/`b` c", [("target", "https://a.org/`b`")]), (r"\`a` b", []), ("", []), (None, []),
])
def test_ranges(text, values):
    found = ranges(text)
    assert [(k, text[a:b]) for k, a, b in found] == values and all(x[2] <= y[1] for x, y in zip(found, found[1:]))


def test_points():
    assert inside([0, 1, 2, 5, 9], [(1, 2), (5, 9)]) == [False, True, False, True, False] and inside([3], []) == [False]
    assert sum(inside(range(100000), [(k, k + 1) for k in range(0, 100000, 2)])) == 50000


def test_rows(spark):
    pages = spark.createDataFrame([(1, '<a href="x">'), (None, None)], "page_id long, html string")
    assert [tuple(r) for r in page_addresses(pages).collect()] == [(1, 0, "href", 9, 10, "x")] and page_addresses(pages.limit(0)).count() == 0
    assert text_ranges(spark.createDataFrame([(2, "`a`")], "doc_id long, text string")).first() == (2, 0, "code", 0, 3, "`a`")
