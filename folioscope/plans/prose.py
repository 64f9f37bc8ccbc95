"""Queries over emphasis, code that two versions of a document share, and offsets inside pages and texts."""

import uuid

from pyspark.sql import functions as F

from folioscope.functions import html, markdown, tags, urls
from folioscope.operators import emphasis, layout, leads, maintenance, offsets, pairs, ranks, search, terms, threads
from folioscope.plans.registry import query
from folioscope.plans.tables import EXPLODED, ITEMS, items, table, tagged

_WORD = "coalesce(nullif(regexp_extract(text, '[A-Za-z]{3,}'), ''), 'word')"


def _word():
    return F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]{3,}", 0), F.lit("")), F.lit("word"))


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '细节*' || {_WORD} || '*很重要' WHEN 1 THEN '中文_file_' || {_WORD} WHEN 2 THEN '不会**少于' || {_WORD} || '**8个'
  WHEN 3 THEN '`细节_' || {_WORD} || '_很`' ELSE '一个*' || {_WORD} || '*（时刻）' END || chr(10) || chr(10) || text AS text FROM documents""")
def cjk_emphasis(spark, sf_dir):
    """Every text behind underscores beside Han: three that are emphasis, a file's name and code."""
    k, word = F.col("doc_id") % 5, _word()
    around = [("细节_", "_很重要"), ("中文_file_", ""), ("不会__少于", "__8个"), ("`细节_", "_很`"), ("一个_", "_（时刻）")]
    put = F.coalesce(*[F.when(k == i, F.concat(F.lit(a), word, F.lit(b))) for i, (a, b) in enumerate(around)])
    return emphasis.with_cjk_emphasis(table(spark, sf_dir, "documents").select("doc_id", F.concat(put, F.lit("\n\n"), "text").alias("text")))


@query(f"""WITH d AS (SELECT doc_id, length({_WORD}) AS n FROM documents)
SELECT doc_id, CAST(2 AS BIGINT) AS start, 3 + n AS stop, CAST(1 AS BIGINT) AS level FROM d
UNION ALL SELECT doc_id, 9 + 3 * n, 15 + 4 * n, 2 FROM d UNION ALL SELECT doc_id, 12 + 4 * n, 14 + 4 * n, 1 FROM d""")
def emphasis_starts(spark, sf_dir):
    """Every text, its own marks taken out, behind one emphasis, a name with an underscore and one emphasis within another."""
    w = _word()
    put = F.concat(F.lit("a *"), w, F.lit("* b "), w, F.lit("_"), w, F.lit(" **"), w, F.lit(" _x_**\n\n"), F.translate("text", "*_", ""))
    return emphasis.emphasised(table(spark, sf_dir, "documents").select("doc_id", put.alias("text")))


@query(r"""WITH found AS (SELECT page_id, html, regexp_extract_all(html, '(?i)\b(href|src)="[^"]*"') AS tags, regexp_split_to_array(html, '(?i)\b(href|src)="[^"]*"') AS gaps FROM pages),
placed AS (SELECT page_id, i - 1 AS pos, lower(split_part(tags[i], '=', 1)) AS kind, regexp_extract(tags[i], '"([^"]*)"', 1) AS value,
  list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(tags[1:i - 1], lambda t: length(t))), 0) + strpos(tags[i], '"') AS start
  FROM found, unnest(range(1, len(tags) + 1)) AS u(i))
SELECT page_id, CAST(pos AS BIGINT) AS pos, kind, CAST(start AS BIGINT) AS start, CAST(start + length(value) AS BIGINT) AS stop, value FROM placed
UNION ALL SELECT page_id, CAST(len(tags) + i - 1 AS BIGINT), 'srcset', CAST(length(html) + [13, 20 + length(CAST(page_id AS VARCHAR))][i] AS BIGINT), CAST(length(html) + [13 + 2 + length(CAST(page_id AS VARCHAR)), 20 + length(CAST(page_id AS VARCHAR)) + 7][i] AS BIGINT),
  ['a,' || page_id, 'b.png?c'][i] FROM found, unnest([1, 2]) AS u(i)""")
def page_addresses(spark, sf_dir):
    """Every address in the tags of every page, by its offsets, with a srcset, a comment and a bare < behind it."""
    put = F.concat("html", F.lit("<img srcset='a,"), F.col("page_id").cast("string"), F.lit(" 1x, b.png?c,' /><!-- <a href=\"no\"> --> 5 < 6"))
    return offsets.page_addresses(table(spark, sf_dir, "pages").select("page_id", put.alias("html")))


@query(r"""SELECT doc_id, i - 1 AS pos, ['code', 'target', 'code', 'math', 'html', 'html', 'code'][i] AS kind, CAST(strpos(body, value) - 1 AS BIGINT) AS start, CAST(strpos(body, value) - 1 + length(value) AS BIGINT) AS stop, value
FROM (SELECT doc_id, '# ' || doc_id || ' `a' || doc_id || '` [b](u' || doc_id || ')' || chr(10) || chr(10) || '- x' || chr(10) || '  ~~~' || chr(10) || '  c' || doc_id || chr(10) || '  ~~~' || chr(10) || chr(10) || '> $e' || doc_id || '$ <i>f</i> `g' || doc_id || '`' AS body,
  ['`a' || doc_id || '`', '(u' || doc_id || ')', '~~~' || chr(10) || '  c' || doc_id || chr(10) || '  ~~~', '$e' || doc_id || '$', '<i>', '</i>', '`g' || doc_id || '`'] AS vs FROM documents), unnest(range(1, 8)) AS u(i), LATERAL (SELECT vs[i] AS value)""")
def text_ranges(spark, sf_dir):
    """Code, targets, math and tags in a heading, a list's fence and a quote, for every document; its text follows as letters and spaces, from its first letter on, so no indent makes it code."""
    n = F.col("doc_id").cast("string")
    body = F.concat(F.lit("# "), n, F.lit(" `a"), n, F.lit("` [b](u"), n, F.lit(")\n\n- x\n  ~~~\n  c"), n, F.lit("\n  ~~~\n\n> $e"), n, F.lit("$ <i>f</i> `g"), n, F.lit("`\n\n"), F.ltrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L} ]+", " ")))
    return offsets.text_ranges(table(spark, sf_dir, "documents").select("doc_id", body.alias("text")))


@query("""SELECT page_id, ['merged', 'unchanged', 'refused', 'merged'][page_id % 4 + 1] AS kind, CASE page_id % 4 WHEN 0 THEN 'How page ' || page_id || ' came to say so' END AS sentence,
  CASE page_id % 4 WHEN 3 THEN 'https://o.org/i/' || page_id || '.png' END AS picture, CASE page_id % 4 WHEN 2 THEN 'sentence' END AS reason FROM pages""")
def article_leads(spark, sf_dir):
    """Every page's article, long enough and without its headline, under a header with a claimed sentence, none, one that the body has, or a picture."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    dek = F.concat(F.lit("How page "), n, F.lit(" came to say so"))
    title = F.concat(F.lit("Page "), n)
    body = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), r"(?s)<h1>.*?</h1>|<img[^>]*>", "")
    filler = F.repeat(F.lit("words that fill a body until it is long enough to be one "), 12)
    put = F.when(k == 0, F.concat(F.lit("<p>"), dek, F.lit("</p>"))).when(k == 1, "<p>What nobody claims of this page at all</p>").when(k == 2, F.concat(F.lit("<p>"), dek, F.lit("</p>"))).otherwise(F.concat(F.lit("<figure><img src=/i/"), n, F.lit(".png></figure>")))
    page = F.concat(
        F.lit("<head><title>"), title, F.lit(" | Site</title><meta name=description content='"), dek, F.lit("'></head><body><div><header><h1>"), title, F.lit("</h1>"), put, F.lit("</header><article><p>"), filler, F.lit("</p>"),
        F.when(k == 2, F.concat(F.lit("<p>"), dek, F.lit("</p>"))).otherwise(""), body, F.lit("</article></div></body>"),
    )
    return leads.leads(table(spark, sf_dir, "pages").select("page_id", F.lit("https://o.org/p").alias("url"), page.alias("html")))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/b/' || page_id || '/c%20d/%C3%A9?q=a+b+' || page_id || '&e=' AS url FROM pages")
def url_parts(spark, sf_dir):
    """Every page's host with dot segments, encoded and open, characters to encode, and form data left after tracking."""
    n, host = F.col("page_id").cast("string"), F.upper(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0))
    url = F.concat(host, F.lit("/a/../b\\x/%2E%2e/./"), n, F.lit("/c d/é/%2e?utm_source=x&q=a%20b+"), n, F.lit("&e#f"))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(url).alias("url"))


@query("SELECT page_id, CASE page_id % 4 WHEN 3 THEN 'one.png' ELSE 'm' || page_id || '/pic.jpg' END AS key FROM pages")
def picture_keys(spark, sf_dir):
    """One picture for every page behind a proxy's parameter, in a proxy's path, with sizes, and one at the top."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    own = F.concat(F.lit("https://o.org/a/m"), n, F.lit("/Pic-300x200.jpg"))
    at = F.when(k == 0, F.concat(F.lit("https://o.org/_next/image?w=640&url="), F.url_encode(own))).when(k == 1, F.concat(F.lit("https://c.org/w_300/"), F.url_encode(own))).when(k == 2, F.concat(F.lit("https://c.org/cdn-cgi/image/w=5/"), own)).otherwise("https://o.org/one-scaled.png")
    return table(spark, sf_dir, "pages").select("page_id", html.picture_key(at).alias("key"))


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events WHERE event_type = 'purchase')
SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.nth, r.nth) AS nth, l.event_id AS "left", r.event_id AS "right" FROM l FULL JOIN r ON l.user_id = r.user_id AND l.nth = r.nth""")
def first_unused_mates(spark, sf_dir):
    """A user's views beside their purchases, first come first served; what one side has more of stays alone."""
    e = table(spark, sf_dir, "events")
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "event_id")
    return ranks.mates(side("view"), side("purchase"), "user_id", "event_id")


@query("""WITH t AS (SELECT conv_id AS thread, turn AS pos, CASE WHEN turn = 0 THEN 0 ELSE (turn * 7 + conv_id) % 5 END AS depth, role, text FROM conversations),
up AS (SELECT a.*, (SELECT max(b.pos) FROM t AS b WHERE b.thread = a.thread AND b.pos < a.pos AND b.depth < a.depth) AS parent FROM t AS a)
SELECT thread, pos, depth, parent FROM up""")
def nested_threads(spark, sf_dir):
    """Every conversation as a thread whose rows say only how deep they stand."""
    depth = F.when(F.col("turn") == 0, 0).otherwise((F.col("turn") * 7 + F.col("conv_id")) % 5)
    return threads.parents(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("pos"), depth.alias("depth"))).drop("level")


@query("""WITH d AS (SELECT doc_id, replace(replace(regexp_replace(text, '[^A-Za-z\\n ]', '', 'g'), chr(10), ' '), '  ', ' ') AS t, doc_id % 4 AS k FROM documents)
SELECT 'd' || doc_id AS slug, ['unchanged', 'repaired', 'refused', 'repaired'][k + 1] AS fate,
  CASE k WHEN 0 THEN 'x ' || t WHEN 2 THEN '## T [#](#t)' || chr(10) || chr(10) || 'x ' || t ELSE '## T' || chr(10) || chr(10) || 'x ' || t END AS body FROM d""")
def repaired_pairs(spark, sf_dir):
    """Every text, letters alone, as the body of a pair: nothing to mend, a heading's anchor, one whose translation has a block less, one without."""
    k = F.col("doc_id") % 4
    said = F.concat(F.lit("x "), F.replace(F.replace(F.regexp_replace("text", "[^A-Za-z\\n ]", ""), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")))
    body = F.when(k == 0, said).otherwise(F.concat(F.lit("## T [#](#t)\n\n"), said))
    translation = F.when(k == 0, "eben").when(k == 1, "## T [#](#t)\n\neben").when(k == 2, "## T [#](#t)")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"), body.alias("body"), translation.alias("translation"))
    return pairs.repaired(rows).select("slug", "fate", F.col("new_body").alias("body"))


_MOVES = "moves AS (SELECT p_partkey AS slug, CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 1 WHEN p_partkey % 5 = 2 THEN p_partkey + 100000000 END AS new_slug FROM part WHERE p_partkey % 5 IN (0, 2))"


@query(f"""WITH {ITEMS}, {_MOVES}, named AS (SELECT i.collection, i.pos, coalesce(m.new_slug, i.slug) AS slug, m.new_slug IS NOT NULL AS moved FROM items AS i LEFT JOIN moves AS m ON m.slug = i.slug)
SELECT collection, pos, slug FROM named QUALIFY slug NOT IN (SELECT new_slug FROM moves) OR row_number() OVER (PARTITION BY collection, slug ORDER BY moved, pos) = 1""")
def moved_members(spark, sf_dir):
    """Parts get new names, some of which other members have: those stay where they are."""
    k = F.col("p_partkey") % 5
    new = F.when(k == 0, F.col("p_partkey") + 1).when(k == 2, F.col("p_partkey") + 100000000)
    moves = table(spark, sf_dir, "part").where(k.isin(0, 2)).select(F.col("p_partkey").alias("slug"), new.alias("new_slug"))
    return maintenance.followed(items(spark, sf_dir).select("collection", "pos", "slug"), moves)


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'articles/new-' || page_id || '/assets/a.png' WHEN 1 THEN NULL WHEN 2 THEN 'sites/s' || page_id || '/p.webp' END AS cover FROM pages""")
def covers_followed(spark, sf_dir):
    """Covers of documents that moved, that are gone, that stay, and none."""
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    slug = F.concat(F.lit("s"), n)
    cover = F.when(k < 2, F.concat(F.lit("articles/"), slug, F.lit("/assets/a.png"))).when(k == 2, F.concat(F.lit("sites/"), slug, F.lit("/p.webp")))
    rows = table(spark, sf_dir, "pages")
    moves = rows.where(k < 2).select(slug.alias("slug"), F.when(k == 0, F.concat(F.lit("new-"), n)).alias("new_slug"))
    return maintenance.covers_followed(rows.select("page_id", cover.alias("cover")), moves)


@query(f"WITH {EXPLODED}, counted AS (SELECT key AS label, count(*) AS n FROM exploded GROUP BY key) SELECT label, n, row_number() OVER (ORDER BY n DESC, label) - 1 AS position, row_number() OVER (ORDER BY n DESC, label) <= 30 AS first FROM counted")
def tag_chips(spark, sf_dir):
    """All tags in lower case by use, ties by Chinese collation; the first thirty are shown at once."""
    own = tagged(spark, sf_dir).select(F.explode(tags.listed(F.col("tags"), None, None)).alias("tag"))
    return terms.chips(own.groupBy(F.lower("tag").alias("label")).agg(F.count("*").alias("n")))


_ASKED = "the of and"


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
sizes AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
hits AS (SELECT doc_id, len(w) AS length, t AS term, len(list_filter(w, lambda x: x = t)) AS tf FROM w, unnest(['the', 'of', 'and']) AS u(t)),
df AS (SELECT term, count(*) AS df FROM hits WHERE tf > 0 GROUP BY term),
scores AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM hits JOIN df USING (term), sizes WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS position FROM scores ORDER BY position LIMIT 20""")
def search_top(spark, sf_dir):
    """The twenty best documents for three frequent words, from an index that is written first."""
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{uuid.uuid4().hex}"
    search.write_index(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return search.top(spark, path, _ASKED, 20).select("doc_id", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '标题 ' || doc_id END AS title_zh, doc_id % 4 < 2 AS lifted FROM documents""")
def titles_lifted(spark, sf_dir):
    """Every text under a heading that is the title with other quotes, with a translation's heading, with none, with a translation without one, and under another."""
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    head = F.when(k == 3, F.lit("# Other")).otherwise(F.concat(F.lit("# Say \u201c**No**\u201d \u2014  "), n))
    body = F.concat(head, F.lit("\n\n"), "text")
    translation = F.when(k == 0, F.concat(F.lit("# 标题 "), n, F.lit("\n\n文"))).when(k == 2, "文")
    rows = table(spark, sf_dir, "documents").select("doc_id", markdown.lifted(body, translation, F.concat(F.lit('say "no" - '), n)).alias("t"))
    return rows.select("doc_id", "t.title_zh", "t.lifted")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://arxiv.org/html/' || lpad(CAST(1000 + page_id % 9000 AS VARCHAR), 4, '0') || '.12345v2' WHEN 1 THEN 'https://raw.githubusercontent.com/O/r' || page_id || '/main/A.md' END AS source,
  CASE page_id % 3 WHEN 0 THEN NULL ELSE url END AS href FROM pages""")
def source_urls(spark, sf_dir):
    """Bodies that a rule files elsewhere and one that stays; addresses that may be linked, and scripts that may not."""
    k, n = F.col("page_id") % 3, F.col("page_id")
    at = F.when(k == 0, F.concat(F.lit("https://arxiv.org/html/"), F.lpad((1000 + n % 9000).cast("string"), 4, "0"), F.lit(".12345v2?context=cs#S3"))).when(k == 1, F.concat(F.lit("https://raw.githubusercontent.com/O/r"), n.cast("string"), F.lit("/main/A.md"))).otherwise(F.col("url"))
    said = F.when(k == 0, "javascript:alert(1)").when(k == 1, F.lit(None).cast("string")).otherwise(F.col("url"))
    other = F.when(k == 0, "local:a.pdf").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.source_of(at).alias("source"), urls.site_href(said, other).alias("href"))


_CHUNKS = """chunks AS (SELECT doc_id, i, n, (n + 1) // 2 AS half, substr(t, 40 * i + 1, 40) AS chunk FROM (SELECT doc_id, t, (length(t) + 39) // 40 AS n FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM documents)), unnest(range(n)) AS u(i))"""


@query(f"""WITH {_CHUNKS}, whole AS (SELECT *, n >= 6 AS two FROM chunks),
placed AS (SELECT doc_id, i + CASE WHEN two THEN 1 ELSE 0 END AS pos, 'line' AS kind, chunk AS text FROM whole
  UNION ALL SELECT doc_id, 0, 'line', 'Title ' || doc_id FROM whole WHERE two AND i = 0
  UNION ALL SELECT doc_id, n + 1, 'line', 'Table ' || doc_id FROM whole WHERE two AND i = 0
  UNION ALL SELECT doc_id, n + 2, 'table', '| k | ' || doc_id || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a | 1 |' || chr(10) || '| b | 2 |' FROM whole WHERE two AND i = 0)
SELECT doc_id AS doc, CAST(1 AS BIGINT) AS page, CAST(pos AS BIGINT) AS pos, kind, text FROM placed""")
def pdf_reading_order(spark, sf_dir):
    """Every text's letters in two columns under a title and over a table, where it fills them; else in one."""
    letters = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.regexp_replace("text", "[^A-Za-z]", "").alias("t"))
    n = F.ceil(F.length("t") / 40).cast("int")
    rows = letters.withColumn("n", n).withColumn("two", F.col("n") >= 6).withColumn("half", F.expr("(n + 1) div 2")).where("n > 0")
    chunks = rows.select("doc", "n", "two", "half", F.posexplode(F.regexp_extract_all("t", F.lit(".{1,40}"), F.lit(0))).alias("i", "text"))
    right = F.col("two") & (F.col("i") >= F.col("half"))
    placed = chunks.select("doc", F.when(right, 320.0).otherwise(60.0).alias("x"), (-12.0 * F.when(right, F.col("i") - F.col("half")).otherwise(F.col("i"))).alias("y"), F.lit(200.0).alias("width"), F.lit(10.0).alias("size"), "text")
    k, low = F.col("doc").cast("string"), -12.0 * (F.col("half") + 2)
    run = lambda x, y, width, said: F.struct(F.lit(x).cast("double").alias("x"), y.cast("double").alias("y"), F.lit(width).cast("double").alias("width"), F.lit(10.0).alias("size"), said.alias("text"))
    put = [run(60, F.lit(30), 460, F.concat(F.lit("Title "), k))] + [run(x, low - 14 * j, 30, F.lit(t) if t else k) for j, row in enumerate((("k", ""), ("a", "1"), ("b", "2"))) for x, t in zip((60, 200), row)]
    # A caption across both columns parts the table from them.
    put.append(run(60, low + 12, 460, F.concat(F.lit("Table "), k)))
    extra = rows.where("two").select("doc", F.explode(F.array(*put)).alias("r")).select("doc", "r.*")
    return layout.in_reading_order(placed.union(extra).withColumn("page", F.lit(1).cast("long")))
