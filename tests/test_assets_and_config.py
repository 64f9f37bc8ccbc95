import struct

import pytest
from pyspark.sql import functions as F

from folioscope.operators import assets, validate
from folioscope.sources import config, sinks


def test_sizes_from_first_bytes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 30, 20) + b"\0"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 50, 70) + b"\0" * 8
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 8
    files = spark.createDataFrame([("p", png), ("g", gif), ("j", jpeg), ("w", lossless), ("x", b"text"), ("n", None), ("e", b"")], "path string, content binary")
    got = {r.path: (r.width, r.height, r.bytes) for r in assets.with_sizes(files).collect()}
    assert got == {"p": (640, 480, 24), "g": (30, 20, 11), "j": (70, 50, len(jpeg)), "w": (100, 50, len(lossless)), "x": (None, None, 4), "n": (None, None, 0), "e": (None, None, 0)}


def test_pictures_in_order(spark):
    df = spark.createDataFrame([('![a](x.png "T") <img src="y.png?a&amp;b"> ![b](x.png) ![c](<z.png>)',)], "b string")
    assert df.select(assets.pictures(F.col("b"))).first()[0] == ["x.png", "z.png", "y.png?a&b"]


def test_config():
    got = config.read("minutes: 5\naliases: {llm: LLM, drop: null}\nmodels: {default: a, tags: b}\ncategories: [x, y]")
    assert (got.minutes, got.model("tags"), got.model("title"), got.categories) == (5, "b", "a", ("x", "y"))
    assert config.read("") == config.Config()
    for bad in ("minutes: 0", "han_share: 2", "unknown: 1", "aliases: {a: b, b: c}", "aliases: {A: x, a: y}"):
        with pytest.raises(ValueError):
            config.read(bad)


def test_translation_rules(spark):
    block = lambda t: [(0, t, "x")]
    schema = "slug string, lang string, processed boolean, failed boolean, blocks array<struct<pos:int,type:string,text:string>>, zh_blocks array<struct<pos:int,type:string,text:string>>"
    rows = [("pending", "en", None, None, block("list"), None), ("ok", "en", True, None, block("list"), block("list")), ("lost", None, True, None, block("list"), None), ("zh", "zh", True, None, block("list"), None), ("both", "zh", True, None, block("list"), block("list"))]
    got = validate.translation_problems(spark.createDataFrame(rows, schema)).collect()
    assert {(r.slug, r.problem) for r in got} == {("lost", "missing"), ("both", "of a Chinese article")}


def test_feed_items_are_escaped(spark):
    df = spark.createDataFrame([("s", 'A & "B" <c>', "https://x.org/?a&b", None, "short")], "slug string, title string, url string, summary string, excerpt string")
    assert sinks.feed_items(df).first().item == "<item><title>A &amp; &quot;B&quot; &lt;c&gt;</title><link>https://x.org/?a&amp;b</link><description>short</description></item>"


def test_caps_don_t_depend_on_the_order_of_rows(spark):
    rows = [("a", 1, 80), ("a", 2, 30), ("a", 2, 5), ("b", 0, 91), ("b", 0, 90)]
    for own in (rows, rows[::-1]):
        got = assets.within_caps(spark.createDataFrame(own, "slug string, pos long, bytes long").coalesce(1), 3, 90).collect()
        assert sorted(map(tuple, got)) == [("a", 1, 80, True), ("a", 2, 5, True), ("a", 2, 30, False), ("b", 0, 90, True), ("b", 0, 91, False)]
