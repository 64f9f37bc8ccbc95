import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.functions import html, markdown, tags, text, urls
from folioscope.operators import library
from folioscope.streaming import inbox


def apply(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


@pytest.mark.parametrize("raw, normal", [
    ("https://Example.COM/a/b/?utm_source=x&id=3#top", "https://example.com/a/b?id=3"),
    ("http://example.com:80", "http://example.com/"),
    ("https://example.com:443/x//", "https://example.com/x"),
    ("https://example.com/?q=a%20b&ref=z", "https://example.com/?q=a+b"),
    ("https://example.com/?q=a%20b", "https://example.com/?q=a%20b"),
    ("https://example.com/a?gclid=1", "https://example.com/a"),
    ("https://arxiv.org/pdf/2404.19756v2.pdf#page=3", "https://arxiv.org/abs/2404.19756"),
    ("https://GitHub.com/Own/Rep/blob/main/A.md?plain=1", "https://github.com/own/rep/blob/main/A.md"),
    ("no url", None), (None, None), ("", None),
])
def test_normalize(spark, raw, normal):
    assert apply(spark, urls.normalize, raw) == [normal]


def test_slug(spark):
    url = "https://www.example.com/Some/Path-to/" + "x" * 80
    (got,) = apply(spark, urls.slug, url)
    assert got == ("example-com-some-path-to-" + "x" * 80)[:60] + "-" + hashlib.sha256(url.encode()).hexdigest()[:8]
    assert apply(spark, urls.short_id, got, "none") == [got[-8:], None]


@pytest.mark.parametrize("raw, normal", [
    ("AI 安全", "AI安全"), ("AI-安全", "AI安全"), ("open-source", "open source"), ("GPT-4", "GPT-4"), ("  #tag. ", "tag"), ("a_b c", "a b c"),
    ("“quoted”", "quoted"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), (".name tld", ".name tld"), ("C++", "C++"), ("CI/CD", "CI/CD"), ("GPT-4-发布", "GPT-4发布"), ("、。", ""),
])
def test_normalized_tag(spark, raw, normal):
    assert apply(spark, tags.normalized, raw) == [normal]
    assert apply(spark, tags.normalized, normal) == [normal]


def fnv(t):
    h = 0x811C9DC5
    data = t.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[i : i + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


def test_tag_slug(spark):
    long = "字" * 40
    got = apply(spark, tags.slug, "CI/CD", "ai/安全", "..", "C#", long, "😀!!", "a  b")
    assert got == ["ci-cd", "ai安全", "tag-" + fnv(".."), "c", "字" * 20 + "-" + fnv(long), "😀!!", "a-b"]


def test_listed_tags(spark):
    df = spark.createDataFrame([(["b", "B", "x-y", "", "drop", "c", "d", "e", "f", "g"],), (None,), ([],)], "t array<string>")
    aliases = F.create_map(F.lit("drop"), F.lit(None).cast("string"), F.lit("c"), F.lit("Sea"))
    assert [r[0] for r in df.select(tags.listed(F.col("t"), aliases)).collect()] == [["b", "x y", "Sea", "d", "e", "f"], None, []]


def test_text_measures(spark):
    assert apply(spark, text.reading_minutes, "word " * 375, "字" * 600, "", "don't stop-now 3.14") == [2, 2, 1, 1]
    assert apply(spark, text.count_words, "two words — 中文 x") == [5]
    assert apply(spark, text.han_ratio, "中文ab", "```\ncode\n```\n中", "12") == [0.5, 1.0, 0.0]
    assert apply(spark, text.is_finished, "Done.", "So...", "他说“好。”", "No", "wait…") == [True, False, True, False, False]
    assert apply(spark, text.simplified_quotes, "「『x』」") == ["“‘x’”"]
    assert apply(spark, text.first_paragraph, "\n\n a\n b\n\nc", "x" * 301) == ["a b", "x" * 300 + "…"]


def test_blocks(spark):
    body = "# T\n\npara\nmore\n\n```py\nx\n\ny\n```\n- a\n- b\n\n> q\n\n| a | b |\n| - | - |\n\n---\n\n$$\nx\n$$\n\n<div>\n"
    (rows,) = apply(spark, markdown.blocks, body)
    assert [r.type for r in rows] == ["heading", "paragraph", "code", "list", "blockquote", "table", "thematicBreak", "math", "html"]
    assert rows[2].text == "```py\nx\n\ny\n```"


def test_pager(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (5, 10), (3, 5), (4, 7)], "c int, l int")
    assert [r[0] for r in df.select(library.pager(F.col("c"), F.col("l"))).collect()] == ["1", "1 2 … 5", "1 … 4 5 6 … 10", "1 2 3 4 5", "1 2 3 4 5 6 7"]


def test_first_link(spark):
    got = apply(spark, inbox.first_link, "see https://a.org/x.", "(http://b.org/y_(z))", "none", "https://c.org")
    assert got == ["https://a.org/x", "http://b.org/y_(z)", None, "https://c.org"]


@pytest.mark.parametrize("url, normal", [
    ("HTTP://Me:Pw@A.org:80/a/../b/./c?x=1#f", "http://Me:Pw@a.org/b/c?x=1"), ("https://a.org/a/%2e%2E/b/%2e", "https://a.org/b"), ("https://a.org/../../x", "https://a.org/x"), ("https://a.org\\p\\q", "https://a.org/p/q"),
    ("https://a.org/a b/é\"<", "https://a.org/a%20b/%C3%A9%22%3C"), ("https://a.org/%7Eu?q=a b'", "https://a.org/%7Eu?q=a%20b%27"), ("https://a.org/?utm_x=1&q=a%20b+c&n", "https://a.org/?q=a+b+c&n="),
    ("https://a.org/?utm%5Fx=1&q=%C3%A9", "https://a.org/?q=%C3%A9"), ("https://a.org/a//b/", "https://a.org/a//b"), ("https://a.org/..", "https://a.org/"), ("https://a.org/x?", "https://a.org/x"), ("no url", None), (None, None),
])
def test_url_parts(spark, url, normal):
    assert apply(spark, urls.normalize, url) == [normal]


def test_html(spark):
    page = "<html><head><title>A &amp; B</title></head><body><nav>no</nav><h1>Head</h1><p>One <b>two</b><p>Three<ul><li>x</ul></body>"
    assert apply(spark, html.title, page) == ["A & B"]
    assert apply(spark, html.text, page) == ["Head One two Three x"]
