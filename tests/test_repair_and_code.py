import pytest
from pyspark.sql import functions as F

from folioscope.functions import code, paths, repair, tags
from folioscope.operators import maintenance, pdf, translate
from folioscope.streaming import queue


def apply(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


REPAIRS = [
    ("[\n\n![a](b)\n two\n \n](u) b", "[![a](b) two](u) b"),
    ("a [plain\nbreak](u) b", "a [plain\nbreak](u) b"),
    ("x \\[\n\n1\\] y", "x \\[1\\] y"),
    ("x \\[\n\nno\\] y", "x \\[\n\nno\\] y"),
    ("| | |\n| - | - |\n| a | b |\n| c | d |", "| a | b |\n| - | - |\n| c | d |"),
    ("1. (1) text", "1. text"),
    ("## Title [#](#title)", "## Title"),
    ("```\n1. (1) text\n```\n1. (1) text", "```\n1. (1) text\n```\n1. text"),
    ("plain $5 prose", "plain $5 prose"),
    ("", ""),
]


@pytest.mark.parametrize("raw, repaired", REPAIRS)
def test_repairs_are_idempotent(spark, raw, repaired):
    assert apply(spark, repair.body, raw) == [repaired]
    assert apply(spark, repair.body, repaired) == [repaired]


def test_masks(spark):
    raw = "see `code` and $x^2$ at [a](http://u.org/x) ```y```"
    df = spark.createDataFrame([(raw,)], "v string").select(repair.masked(F.col("v")).alias("m"))
    row = df.first().m
    assert "code" not in row.text and "http" not in row.text and len(row.spans) == 4
    back = lambda t: df.select(repair.unmasked(F.lit(t), F.col("m.spans"))).first()[0]
    assert back(row.text) == raw
    assert back(row.text.replace("⟦1⟧", "")) is None and back(row.text + "⟦0⟧") is None


def test_translation_reuses_and_fails_safely(spark):
    blocks = spark.createDataFrame([(1, 0, "paragraph", "hello `x`"), (1, 1, "code", "```a```"), (1, 2, "paragraph", "bad `y`"), (2, 0, "paragraph", "hello `x`")], "doc_id int, pos int, type string, text string")
    cache = spark.createDataFrame([], "key string, value string")
    got = translate.translated(blocks, cache, lambda ts: ["lost" if t.startswith("bad") else t.upper() for t in ts]).orderBy("doc_id", "pos").collect()
    assert [(r.translation, r.failed) for r in got] == [("HELLO `x`", False), ("```a```", False), ("bad `y`", True), ("HELLO `x`", False)]


def test_code_language_needs_agreement(spark):
    got = apply(spark, code.language, "let x = 1", "const a = 1;\nconsole.log(a)", "package main\nfunc main() {\n fmt.Println(1)\n}", "#include <a.h>\nint main() { return 0; }", "FROM a\nRUN b", "title: x", "")
    assert got == [None, "javascript", "go", "c", "docker", None, None]
    assert apply(spark, code.fence_language, "```py\nx\n```", "```\nx\n```") == ["py", None]
    assert apply(spark, lambda c: code.with_fence_language(c, F.lit("py")), "```\nx\n```", "```js\nx\n```") == ["```py\nx\n```", "```js\nx\n```"]


def test_paths(spark):
    assert apply(spark, lambda c: paths.cover_path(c)["kind"], "articles/a-1/assets/x.png", "sites/b/assets/y.webp", "x") == ["article", "site", None]
    assert apply(spark, paths.archived, "https://web.archive.org/web/2026id_/https://a.org/x", "https://a.org/x") == ["https://a.org/x"] * 2


def test_writable_keeps_the_least_number(spark):
    df = spark.createDataFrame([(["n1", "n2", "n3", "n4"], ["Known"]), (["known", "n1", "n2", "n3", "n4"], []), (["n1"], [])], "offered array<string>, current array<string>")
    known = F.create_map(F.lit("known"), F.lit("Known"))
    got = [r[0] for r in df.select(tags.writable(F.col("offered"), known, F.col("current"), 1)).collect()]
    assert got == [["n1", "n2", "n3"], ["Known", "n1", "n2"], ["n1"]]


def test_pdf_markdown(spark):
    runs = []
    for page in range(3):
        texts = [("My Journal", 8.0, 800), (f"Part {'abc'[page]}", 16.0, 760), ("first", 10.0, 740), ("line", 10.0, 740.5), ("second line", 10.0, 728), (f"- item {'xyz'[page]}", 10.0, 716), (f"{page + 1}", 8.0, 30)]
        runs += [("d", page, i, t, s, float(y)) for i, (t, s, y) in enumerate(texts)]
    df = spark.createDataFrame(runs, "doc string, page int, seq int, text string, size double, y double")
    (row,) = pdf.to_markdown(df).collect()
    assert row.markdown.startswith("## Part a\n\nfirst line second line\n\n- item x\n\n## Part b") and "Journal" not in row.markdown


def test_recanonicalized_conflicts(spark):
    url = "https://a.org/x"
    articles = spark.createDataFrame([("old-1", url), ("old-2", url + "?utm_source=1"), ("old-3", "https://b.org/")], "slug string, url string")
    assert {(r.slug, r.conflict) for r in maintenance.recanonicalized(articles).collect()} == {("old-1", True), ("old-2", True), ("old-3", False)}


def test_queue_steps():
    none = (None, None, None, None)
    assert queue.step(none, "add", 1, False) == (None, None, "add", 1)
    assert queue.step((None, None, "add", 1), "remove", 2, False) == none
    assert queue.step(none, "add", 1, True) == none
    sent = queue.step((None, None, "add", 1), "sent", 5, False)
    assert sent == ("add", 5, None, None)
    assert queue.step(sent, "remove", 6, False) == ("add", 5, "remove", 6)
    assert queue.step(("add", 5, "remove", 6), "add", 7, False) == sent
    assert queue.step(("add", 5, "remove", 6), "refused", 7, False) == sent
    assert queue.step(sent, "add", 6 + queue.OVERLAY_MS, False) == (None, None, "add", 6 + queue.OVERLAY_MS)


def test_queue_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    schema = "collection long, slug long, kind string, at timestamp, published boolean"

    def drain(sql):
        spark.sql(sql).write.mode("append").parquet(source)
        stream = queue.entries(spark.readStream.schema(schema).parquet(source), overlay_ms=10**13).writeStream.outputMode("update")
        stream.foreachBatch(lambda b, _: seen.extend((r.slug, r.state, r.action) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    drain("SELECT 1L collection, 2L slug, 'add' kind, timestamp'2026-01-01' at, false published UNION ALL SELECT 1L, 3L, 'add', timestamp'2026-01-01', true")
    drain("SELECT 1L collection, 2L slug, 'sent' kind, timestamp'2026-01-02' at, false published")
    assert seen == [(2, "pending", "add"), (2, "sent", "add")]
