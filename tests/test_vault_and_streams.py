from folioscope.sources import vault
from folioscope.streaming import edits, inbox

HEAD = "---\nurl: https://x.org/{0}\ntitle: T {0}\ndomain: x.org\nclipped_at: 2026-01-01T00:00:00Z\ntags: [a, b]\nwork:\n  processed_at: 2026-01-02\n---\n\nBody {0}\n"


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_vault_reads_good_bad_and_translated(spark, tmp_path):
    put(tmp_path, "articles/one/index.md", HEAD.format("one"))
    put(tmp_path, "articles/one/zh.md", "译")
    put(tmp_path, "articles/two/index.md", "no front matter")
    put(tmp_path, "articles/three/index.md", "---\ntitle: only\n---\nx")
    put(tmp_path, "articles/four/index.md", "---\n: [bad\n---\nx")
    put(tmp_path, "articles/five/zh.md", "orphan")
    docs = vault.read(spark, str(tmp_path))
    (one,) = vault.good(docs).collect()
    assert (one.slug, one.title, one.tags, one.processed_at, one.body, one.zh_body) == ("one", "T one", ["a", "b"], "2026-01-02", "Body one\n", "译")
    assert {r.slug for r in vault.rejects(docs).collect()} == {"two", "three", "four"}
    assert [r.slug for r in vault.orphan_translations(spark, str(tmp_path)).collect()] == ["five"]


def test_vault_round_trip(spark, tmp_path):
    put(tmp_path, "articles/one/index.md", HEAD.format("one"))
    text = vault.rendered(vault.read(spark, str(tmp_path)), "url", "title", "domain", "clipped_at", "author", "tags").collect()[0].text
    again = vault.parsed(text)
    assert (again["url"], again["title"], again["tags"], again["body"], again["problem"]) == ("https://x.org/one", "T one", ["a", "b"], "Body one\n", None)
    assert text.endswith("Body one\n") and "author" not in text


def test_inbox_takes_each_page_once(spark, tmp_path):
    put(tmp_path, "in/a.txt", "read https://x.org/a?utm_source=n")
    put(tmp_path, "in/b.txt", "https://x.org/a")
    put(tmp_path, "in/c.txt", "nothing")
    out = str(tmp_path / "articles")
    spark.createDataFrame([], "slug string, url string").write.parquet(out)
    for _ in range(2):
        inbox.start(spark, str(tmp_path / "in"), out, str(tmp_path / "check")).awaitTermination(60)
        put(tmp_path, "in/d.txt", "https://X.org/a/ again")
    assert [r.url for r in spark.read.parquet(out).collect()] == ["https://x.org/a"]


def test_effective_membership_as_a_stream(spark, tmp_path):
    schema = "collection long, slug long, action string, at timestamp, seq long"
    source = str(tmp_path / "ops")
    spark.sql("SELECT 1L collection, 2L slug, 'add' action, timestamp'2026-01-02' at, 1L seq UNION ALL SELECT 1L, 3L, 'add', timestamp'2026-01-02', 2L").write.parquet(source)
    seen = []

    def keep(batch, _):
        seen.extend(map(tuple, batch.collect()))

    def drain():
        stream = edits.effective_stream(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    drain()
    spark.sql("SELECT 1L collection, 2L slug, 'remove' action, timestamp'2026-01-01' at, 3L seq UNION ALL SELECT 1L, 3L, 'remove', timestamp'2026-01-03', 4L").write.mode("append").parquet(source)
    drain()
    assert sorted((s[1], s[2]) for s in seen) == [(2, "add"), (3, "add"), (3, "remove")]


def test_debounced_stream_gives_what_the_batch_gives(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    rows = "SELECT * FROM VALUES (1, timestamp'2026-01-01 00:00:00'), (1, timestamp'2026-01-01 00:10:00'), (1, timestamp'2026-01-01 01:00:00'), (2, timestamp'2026-01-01 00:05:00') AS t(user_id, ts)"
    spark.sql(rows).write.parquet(source)
    stream = edits.debounced(spark.readStream.schema("user_id int, ts timestamp").parquet(source), "user_id", "ts", "30 minutes", "1 hour")
    run = lambda: stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    spark.sql("SELECT 9 user_id, timestamp'2026-01-02 00:00:00' ts").write.mode("append").parquet(source)
    run()
    spark.sql("SELECT 9 user_id, timestamp'2026-01-03 00:00:00' ts").write.mode("append").parquet(source)
    run()
    got = {tuple(r) for r in spark.read.parquet(out).where("user_id < 9").collect()}
    want = {tuple(r) for r in edits.debounced(spark.sql(rows), "user_id", "ts", "30 minutes").collect()}
    assert got == want


def test_sites_and_collections(spark, tmp_path):
    put(tmp_path, "sites/map/index.md", HEAD.format("map").replace("tags:", "description: About\npreview: ./assets/a.webp\nnote: Mine\ntags:"))
    put(tmp_path, "collections/shelf.md", "---\ntitle: Shelf\ncover: articles/one/assets/a.png\nitems:\n  - slug: one\n    added_at: '2026-01-01'\n  - slug: sites/map\n    section: B\n  - bare\n  - section: none\n---\nText\n")
    put(tmp_path, "collections/empty.md", "---\ntitle: Empty\n---\n")
    put(tmp_path, "collections/Bad Name.md", "---\ntitle: x\n---\n")
    put(tmp_path, "collections/broken.md", "---\n: [\n---\n")
    (site,) = vault.sites(spark, str(tmp_path)).collect()
    assert (site.slug, site.title, site.description, site.preview, site.note, site.tags, site.problem) == ("map", "T map", "About", "./assets/a.webp", "Mine", ["a", "b"], None)
    shelves = vault.collections(spark, str(tmp_path))
    assert {r.id: r.problem for r in shelves.collect()} == {"shelf": None, "empty": None, "Bad%20Name": "id", "broken": "unreadable"} or {r.problem for r in shelves.collect()} == {None, "id", "unreadable"}
    assert sorted(map(tuple, vault.items(shelves).collect())) == [("shelf", 0, "one", "2026-01-01", None), ("shelf", 1, "sites/map", None, "B"), ("shelf", 2, "bare", None, None)]


def test_loose_reads_and_changes(spark, tmp_path):
    texts = ["---\na: 1\nb: [x]\n---\n", "plain", "---\n: [\n---\n", "---\n---\n", "---\n- x\n---\n", None]
    got = {r.path: (r.kind, r.fields) for r in vault.loose(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")).collect()}
    assert got["0"] == ("ok", {"a": "1"}) and [got[str(i)][0] for i in range(1, 6)] == ["none", "unreadable", "none", "unreadable", "none"]
    put(tmp_path, "v/a.md", "one")
    put(tmp_path, "v/d/b.md", "two")
    before = vault.signatures(spark, str(tmp_path / "v")).collect()
    put(tmp_path, "v/a.md", "one and more")
    put(tmp_path, "v/c.md", "new")
    (tmp_path / "v/d/b.md").unlink()
    old = spark.createDataFrame(before, "path string, at timestamp, size long")
    found = {r.path.rsplit("/", 1)[1]: r.change for r in vault.changed(old, vault.signatures(spark, str(tmp_path / "v"))).collect()}
    assert found == {"a.md": "changed", "b.md": "removed", "c.md": "added"}
