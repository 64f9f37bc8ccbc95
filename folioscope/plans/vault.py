"""Queries over names, tags to write, repairs, code, model work and maintenance."""

from pyspark.sql import functions as F

from folioscope.functions import code, markdown, paths, repair, tags, text, urls
from folioscope.operators import maintenance, pdf, translate
from folioscope.plans.registry import query
from folioscope.plans.tables import TAGGED, table, tagged
from folioscope.plans.texts import BLOCKS


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'sites/s' || CAST(page_id AS VARCHAR) ELSE 'a' || CAST(page_id AS VARCHAR) END AS ref, CASE WHEN page_id % 3 = 0 THEN 'site' ELSE 'article' END AS kind,
  CASE WHEN page_id % 3 = 0 THEN '/sites/s' || CAST(page_id AS VARCHAR) || '/' ELSE '/articles/a' || CAST(page_id AS VARCHAR) || '/' END AS view FROM pages""")
def member_views(spark, sf_dir):
    ref = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("sites/s"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("a"), F.col("page_id").cast("string")))
    rows = table(spark, sf_dir, "pages").select("page_id", ref.alias("ref")).withColumn("kind", paths.member_kind(F.col("ref")))
    return rows.withColumn("view", paths.view_url(F.col("kind"), F.col("ref")))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'site' END AS kind, CASE WHEN page_id % 4 < 2 THEN 'x' || CAST(page_id AS VARCHAR) END AS slug, CASE WHEN page_id % 4 < 2 THEN 'f.png' END AS file FROM pages""")
def cover_paths(spark, sf_dir):
    n = F.col("page_id").cast("string")
    at = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("articles/x"), n, F.lit("/assets/f.png"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("sites/x"), n, F.lit("/assets/f.png"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("other/x"), n, F.lit("/assets/f.png"))).otherwise(F.concat(F.lit("articles/x"), n, F.lit("/assets/d/f.png")))
    return table(spark, sf_dir, "pages").select("page_id", paths.cover_path(at).alias("c")).select("page_id", "c.kind", "c.slug", "c.file")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * 300 <= 20971520 AND CASE WHEN l_quantity > 25 THEN l_extendedprice * 300 >= 5120
  ELSE least(l_quantity * 10, l_linenumber * 100) >= 150 AND greatest(l_quantity * 10, l_linenumber * 100) <= 3 * least(l_quantity * 10, l_linenumber * 100) END AS worth FROM lineitem""")
def cover_worthiness(spark, sf_dir):
    q, w = F.col("l_quantity"), F.when(F.col("l_quantity") <= 25, F.col("l_quantity") * 10)
    h = F.when(q <= 25, F.col("l_linenumber") * 100.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", paths.worth_a_cover(w, h, F.col("l_extendedprice") * 300).alias("worth"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '…' ELSE text END AS description FROM documents")
def description_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.description(F.col("text")).alias("description"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || '.url' AS name FROM events")
def inbox_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", paths.inbox_name(F.col("ts"), F.col("event_id") % 10000).alias("name"))


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/search/' WHEN 1 THEN '/' WHEN 2 THEN '/collections/favorites/' END AS target FROM pages""")
def static_redirects(spark, sf_dir):
    """Old addresses of the site, and every fourth page's own path, which none leads from."""
    own = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    path = F.get(F.array(F.lit("/tags/"), F.lit("/categories/"), F.lit("/favorites/"), own), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", paths.redirect(path).alias("target"))


@query("SELECT page_id, substr(sha256(html), 1, 12) AS snapshot FROM pages")
def snapshot_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.snapshot_id(F.col("html").cast("binary")).alias("snapshot"))


@query("SELECT page_id, url AS original FROM pages")
def saved_page_match(spark, sf_dir):
    copy = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://web.archive.org/web/20260101000000/"), F.col("url"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", paths.archived(copy).alias("original"))


@query(f"""WITH {TAGGED} SELECT slug, 'Source ' || tags[1] || '|' || tags[2] || '|' || tags[3] || '|' || CASE tags[4] WHEN 'open-source' THEN 'open source' ELSE 'Open Source' END || '|Reading' AS tags FROM tagged""")
def tags_respelled(spark, sf_dir):
    docs = tagged(spark, sf_dir)
    known = F.create_map(F.lower(F.get("tags", F.lit(0))), F.concat(F.lit("Source "), F.get("tags", F.lit(0))))
    return docs.select("slug", F.array_join(tags.respelled(F.col("tags"), known), "|").alias("tags"))


@query(f"WITH {TAGGED} SELECT slug, tags[1] || '|n1|n2|n3' AS tags FROM tagged")
def tags_writable(spark, sf_dir):
    docs = tagged(spark, sf_dir)
    known = F.create_map(F.lower(F.get("tags", F.lit(0))), F.get("tags", F.lit(0)))
    offered = F.array(F.get("tags", F.lit(0)), F.lit("n1"), F.lit("n2"), F.lit("かな"), F.lit("n3"), F.lit("n4"), F.lit("N1"))
    return docs.select("slug", F.array_join(tags.writable(offered, known, F.array().cast("array<string>")), "|").alias("tags"))


@query(f"WITH {TAGGED} SELECT slug, CASE WHEN row_number() OVER (ORDER BY slug) <= 25 THEN 'tried' ELSE 'remaining' END AS bucket FROM tagged")
def retag_limit(spark, sf_dir):
    return maintenance.retag_buckets(tagged(spark, sf_dir), 25)


_REPAIRED = "\\n\\n# T\\n\\n[![p](https://x.org/a.png) a caption](https://x.org/{})\\n\\n\\[1\\] note\\n\\n[one\\nlink](u)\\n\\n1. a\\n~~~\\n[\\n\\nkept\\n\\n](u)\\n~~~"


@query("SELECT doc_id, text || " + " || doc_id || ".join("'" + part.replace("\\n", "' || chr(10) || '") + "'" for part in _REPAIRED.split("{}")) + " AS repaired FROM documents")
def repair_plain_prose(spark, sf_dir):
    """Repairs leave prose, plain line breaks and code as they are; a heading's anchor and a marker twice go, a picture's link and a note are put together."""
    body = F.concat("text", F.lit("\n\n# T [#](#t)\n\n[\n\n![p](https://x.org/a.png)\na caption\n \n](https://x.org/"), F.col("doc_id").cast("string"), F.lit(")\n\n\\[\n\n1\\] note\n\n[one\nlink](u)\n\n1. (1) a\n~~~\n[\n\nkept\n\n](u)\n~~~"))
    return table(spark, sf_dir, "documents").select("doc_id", repair.body(body).alias("repaired"))


@query(r"""WITH d AS (SELECT doc_id, text || ' `c` $m_' || doc_id || '$ [l](https://x.org/' || doc_id || ')' AS body FROM documents)
SELECT doc_id, body AS restored, len(regexp_extract_all(body, '(?s)```.*?```|`[^`\n]+`|\$\$.+?\$\$|\$[^$\n]+\$|\]\([^)\s]+')) AS tokens FROM d""")
def mask_round_trip(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    body = F.concat("text", F.lit(" `c` $m_"), n, F.lit("$ [l](https://x.org/"), n, F.lit(")"))
    m = table(spark, sf_dir, "documents").select("doc_id", repair.masked(body).alias("m"))
    return m.select("doc_id", repair.unmasked(F.col("m.text"), F.col("m.spans")).alias("restored"), F.regexp_count("m.text", F.lit("⟦[0-9]+⟧")).cast("long").alias("tokens"))


@query("""WITH t AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 5 = 0 THEN 'code' ELSE 'paragraph' END AS type, CASE WHEN turn % 5 = 1 THEN 'LOSE ' ELSE '' END || text || ' `a$b` $x_1$ [' || role || '](https://x.org/' || conv_id || ')' AS text FROM conversations)
SELECT conv_id, pos, type, text, CASE WHEN pos % 5 < 2 THEN text ELSE '[' || text || ']' END AS translation, pos % 5 = 1 AS failed FROM t""")
def translate_blocks(spark, sf_dir):
    """By a stand-in for a model, that answers in brackets or loses the masks; code keeps its text, and so does what failed."""
    c = F.col
    text_ = F.concat(F.when(c("turn") % 5 == 1, "LOSE ").otherwise(""), "text", F.lit(" `a$b` $x_1$ ["), "role", F.lit("](https://x.org/"), c("conv_id").cast("string"), F.lit(")"))
    blocks = table(spark, sf_dir, "conversations").select(c("conv_id").alias("doc_id"), c("turn").alias("pos"), F.when(c("turn") % 5 == 0, "code").otherwise("paragraph").alias("type"), text_.alias("text"))
    cache = spark.createDataFrame([], "key string, value string")
    return translate.translated(blocks, cache, lambda texts: ["gone" if t.startswith("LOSE ") else f"[{t}]" for t in texts]).withColumnRenamed("doc_id", "conv_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS lang FROM documents")
def keep_better(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    new = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("lang"))
    return translate.better(d.select("doc_id", "lang"), new, "doc_id", ["lang"])


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS n FROM a FULL JOIN b USING (user_id) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)""")
def counts_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    count = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    return maintenance.counts_diff(count("view"), count("click"), "user_id", ["n"])


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, value > 50 DESC, event_id DESC) = 1")
def candidate_choice(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("is_source"), (F.col("value") > 50).alias("from_fetch"), F.col("event_id").alias("arrival"))
    return maintenance.chosen(e, "user_id").select("user_id", "event_id")


@query("SELECT doc_id, ['bash', 'json', 'python', 'sql', 'yaml', NULL, 'shellsession', 'diff', 'rust'][doc_id % 9 + 1] AS language FROM documents")
def code_language(spark, sf_dir):
    """A piece of code for every document, with its number where the language has a name or a value."""
    n = F.col("doc_id").cast("string")
    forms = ("#!/usr/bin/env bash\necho hi #", '{"a": [1, #]}', "import os\n\ndef f#(x):\n    return os.path.join(x)\n", "SELECT a, b FROM t#\nWHERE a = 1;", "a: 1\nb:\n  - c: #\nd: x", "Just a sentence or two, # times.", "$ ls -l a#\ntotal 0", "@@ -1,2 +1,2 @@\n-a#\n+b", "use std::io;\nfn main() {\n    let mut x# = 1;\n}")
    parts = [F.concat(*[x for i, p in enumerate(form.rsplit("#", 1)) for x in ([n] if i else []) + [F.lit(p)]]) for form in forms]
    return table(spark, sf_dir, "documents").select("doc_id", code.language(F.get(F.array(*parts), (F.col("doc_id") % 9).cast("int"))).alias("language"))


@query(f"WITH {BLOCKS} SELECT doc_id, count(blocks.pos) + doc_id % 3 AS blocks FROM documents LEFT JOIN blocks USING (doc_id) GROUP BY doc_id")
def one_block_documents(spark, sf_dir):
    """Blocks of every text, with none, one or two put behind it, a fence with blank lines among them."""
    k = F.col("doc_id") % 3
    body = F.concat(F.coalesce("text", F.lit("")), F.when(k > 0, "\n\n~~~\na\n\nb\n~~~\n").otherwise("\n \n"), F.when(k == 2, "after").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(markdown.blocks(body)).cast("long").alias("blocks"))


@query()
def pdf_markdown(spark, sf_dir):
    """Eight texts are the pages of a document."""
    c = F.col
    runs = table(spark, sf_dir, "documents").select(F.floor(c("doc_id") / 8).alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return pdf.to_markdown(runs.withColumn("size", F.when(c("seq") == 0, 16.0).otherwise(10.0)).withColumn("y", 800.0 - 12.0 * c("seq")))


@query("""WITH r AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, length(text) * 4 // 5) ELSE text || text END AS reply FROM documents)
SELECT doc_id, text <> '' AND length(reply) BETWEEN floor(length(text) * 0.85) AND ceil(length(text) * 1.3) AS kept FROM r""")
def reply_keeps_length(spark, sf_dir):
    """Replies of the same length, of four fifths and of twice as much."""
    k = F.col("doc_id") % 3
    reply = F.when(k == 0, F.col("text")).when(k == 1, F.expr("substr(text, 1, length(text) * 4 div 5)")).otherwise(F.concat("text", "text"))
    return table(spark, sf_dir, "documents").select("doc_id", ((F.col("text") != "") & translate.keeps_length(F.col("text"), reply)).alias("kept"))


@query(r"SELECT page_id, CASE WHEN url LIKE '%?%' THEN regexp_replace(url, '[?#].*$', '') ELSE regexp_replace(url, '#.*$', '') END AS bare FROM pages")
def bare_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("bare"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'my file ' || CAST(doc_id AS VARCHAR) ELSE source END AS label FROM documents")
def source_labels(spark, sf_dir):
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("local:my%20file%20"), F.col("doc_id").cast("string"))).otherwise("https://x.org/")
    return table(spark, sf_dir, "documents").select("doc_id", urls.source_label(url, F.col("source")).alias("label"))


@query("SELECT doc_id, doc_id % 4 > 1 AND trim(regexp_replace(text, '\\s', '', 'g')) <> '' AS readable FROM documents")
def readable_documents(spark, sf_dir):
    """Half of the texts are taken away: null, or white space alone."""
    k = F.col("doc_id") % 4
    body = F.when(k == 0, F.lit(" \u00a0\n\u3000")).when(k > 1, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_readable(body).alias("readable"))
