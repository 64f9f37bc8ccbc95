from pyspark.sql import functions as F

from folioscope.operators import batch, collections, library, pdf, terms, validate


def test_sections_after_unlisted_members_are_left_out(spark):
    items = spark.createDataFrame([("c", 1, "a", "S"), ("c", 2, "gone", "T"), ("c", 3, "b", "S"), ("c", 4, "d", None), ("c", 5, "e", None)], "collection string, pos int, slug string, section string")
    docs = spark.createDataFrame([(x,) for x in "abde"], "slug string")
    rows = collections.sections(collections.members(items, docs)).orderBy("run").collect()
    assert [(r.title, r.n) for r in rows] == [("S", 2), (None, 2)]


def test_favorites_are_made_up_where_missing(spark):
    c = spark.createDataFrame([("b", "t")], "id string, title string")
    assert {r.id for r in collections.with_favorites(c).collect()} == {"b", "favorites"}
    assert collections.with_favorites(collections.with_favorites(c)).count() == 2


def test_term_label_ties_go_to_the_first_seen(spark):
    docs = spark.createDataFrame([("1", ["Ai", "x"]), ("2", ["AI"]), ("3", ["ai/x", "X"])], "slug string, tags array<string>")
    assert {(r.term, r.label, r["items"]) for r in terms.index(docs).collect()} == {("ai", "Ai", 2), ("x", "x", 2), ("ai-x", "ai/x", 1)}


def test_numbered_pages_have_missing_times_last(spark):
    docs = spark.createDataFrame([("a", None), ("b", "2026-01-02"), ("c", "2026-01-03"), ("d", "2026-01-02")], "slug string, at string").withColumn("at", F.to_timestamp("at"))
    rows = library.numbered(docs, "at", "slug", 2).orderBy("position").collect()
    assert [(r.slug, r.page) for r in rows] == [("c", 1), ("b", 1), ("d", 2), ("a", 2)]


def test_packed_starts_anew_where_the_next_does_not_fit(spark):
    blocks = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 1, 20, 1])], "doc long, pos long, size long")
    assert [r.batch for r in batch.packed(blocks, "doc", 10).orderBy("pos").collect()] == [0, 0, 1, 2, 3]


def test_cache_by_key_before_text(spark):
    cache = spark.createDataFrame([("k", "t1", "by key"), ("other", "t2", "by text")], "key string, text_hash string, value string")
    asked = spark.createDataFrame([(1, "k", "t2"), (2, "no", "t2"), (3, "no", "no")], "id int, key string, text_hash string")
    assert [r.value for r in batch.cached(asked, cache).orderBy("id").collect()] == ["by key", "by text", None]


def test_furniture(spark):
    lines = [("d", p, n, t) for p in range(5) for n, t in enumerate(["Journal 12", f"own {chr(97 + p)}", "body", "body", f"{p}"])]
    got = pdf.furniture(spark.createDataFrame(lines, "doc string, page int, nth int, text string")).collect()
    assert {r.key for r in got} == {"Journal #", "#", "body"}


def test_violations_of_nothing(spark):
    articles = spark.createDataFrame([("a", "https://x.org/a", "T", ["ok"])], "slug string, url string, title string, tags array<string>")
    items = spark.createDataFrame([("c", "a")], "collection string, slug string")
    assert validate.violations(articles, items, spark.createDataFrame([("a",)], "slug string")).count() == 0


def test_clip_history_keeps_500_for_each_user(spark, tmp_path):
    """One of 501 events loses the oldest; shorter histories stay whole."""
    from folioscope.plans.catalog import QUERIES

    rows = spark.range(521).select(F.when(F.col("id") < 501, 1).otherwise(2).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["clip_history_topk"](spark, str(tmp_path)).collect()
    assert sorted(r.event_id for r in got) == list(range(1, 521))


def test_every_collection_is_numbered(spark):
    """More than 50, with ties, missing times and favorites."""
    c = spark.range(1000).select(F.concat(F.lit("c"), F.col("id")).alias("id"), F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.col("id") % 7)).alias("updated_at"))
    rows = c.collect()
    want = ["favorites", *(r.id for r in sorted(rows, key=lambda r: (r.updated_at is None, -r.updated_at.timestamp() if r.updated_at else 0, r.id)))]
    got = sorted(collections.numbered(collections.with_favorites(c)).collect(), key=lambda r: r.nth)
    assert [r.id for r in got] == want and [r.nth for r in got] == list(range(1, 1002))
    assert collections.numbered(c.limit(0)).count() == 0
