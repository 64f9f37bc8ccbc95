import pytest

from folioscope.operators import leads

BODY = "<article>" + "".join(f"<p>Body paragraph {i} tells of many things that happened, one after the other, at length and in order.</p>" for i in range(8)) + "</article>"
HEAD = '<head><title>The big story — Site</title><meta name="description" content="How one small town changed its mind about rain"><meta property="og:image" content="https://c.org/x/a/pic-300x200.jpg"></head>'
DEK = "<p class=dek>How one small town changed its mind about rain.</p>"
PICTURE = '<img src="/i/x?url=https%3A%2F%2Fo.org%2Fz%2Fa%2Fpic.jpg" width=900 height=600>'


def page(header, head=HEAD, body=BODY):
    return f"<html>{head}<body><div class=page><header><h1>The big story</h1>{header}</header>{body}</div></body></html>"


@pytest.mark.parametrize("html, result", [
    (page(DEK + PICTURE), ("merged", "How one small town changed its mind about rain.", "https://o.org/i/x?url=https%3A%2F%2Fo.org%2Fz%2Fa%2Fpic.jpg", None)),
    (page(DEK), ("merged", "How one small town changed its mind about rain.", None, None)), (page("<figure><img src=/other.png></figure>"), ("merged", None, "https://o.org/other.png", None)),
    (page("<p>Nothing that the page says of itself at all</p><img src=/other.png>"), ("unchanged", None, None, None)), (page(f"<div class=related>{DEK}</div>"), ("unchanged", None, None, None)),
    (page('<figure><img src=/logo.png alt="Site logo"></figure>'), ("unchanged", None, None, None)), (page("<figure><img src=/small.png width=90></figure>"), ("unchanged", None, None, None)),
    (page(DEK, body=BODY.replace("</article>", DEK + "</article>")), ("refused", None, None, "sentence")), (page(DEK + PICTURE, body=BODY.replace("</article>", "<img src=https://e.org/q/a/pic-80x80.jpg></article>")), ("refused", None, None, "picture")),
    (page(DEK + "<p>" + "long header words " * 400 + "</p>"), ("refused", None, None, "header")), (page(DEK, head=HEAD.replace("big story", "other thing")), ("unchanged", None, None, None)), (page(DEK, body="<article><p>short</p></article>"), ("unchanged", None, None, None)),
    ("<article><h1>The big story</h1>" + DEK + BODY + "</article>", ("unchanged", None, None, None)), (None, ("unchanged", None, None, None)), ("", ("unchanged", None, None, None)),
])
def test_lead(html, result):
    assert leads.lead(html, "https://o.org/p") == result


def test_tokens_and_rows(spark):
    assert leads.tokens("Ab c. 中文字 日") == {"ab", "c", "中文", "文字", "日"}
    rows = spark.createDataFrame([(1, "https://o.org/p", page(DEK)), (None, None, None)], "page_id long, url string, html string")
    assert sorted((r.kind, str(r.page_id)) for r in leads.leads(rows).collect()) == [("merged", "1"), ("unchanged", "None")]
