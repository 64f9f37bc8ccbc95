"""Queries over incremental work, layout and maintenance."""

from pyspark.sql import functions as F

from folioscope.operators import batch, pdf
from folioscope.plans.registry import query
from folioscope.plans.tables import table


@query("SELECT doc_id, n_chars FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id) ORDER BY n_chars, doc_id")
def pending_cheapest_first(spark, sf_dir):
    docs, done = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return batch.pending(docs, done, "doc_id").orderBy("n_chars", "doc_id")


@query("""SELECT source, doc_id, CAST(so_far AS BIGINT) AS so_far, so_far <= 20000 AS fits FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM documents)""")
def budget_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return batch.within_budget(docs, "n_chars", [F.col("n_chars"), F.col("doc_id")], "source", 20000, F.floor(F.col("n_chars") / 64)).select("source", "doc_id", "so_far", "fits")


@query("""WITH RECURSIVE turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn AS pos, length(text) AS size FROM conversations),
fold AS (SELECT conv_id, i, pos, size, 0 AS batch, size AS held FROM turns WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, t.pos, t.size, CASE WHEN f.held > 0 AND f.held + t.size > 600 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.held > 0 AND f.held + t.size > 600 THEN t.size ELSE f.held + t.size END
  FROM fold AS f JOIN turns AS t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, pos, CAST(size AS BIGINT) AS size, CAST(batch AS BIGINT) AS batch FROM fold""")
def batch_pack(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.length("text").cast("long").alias("size"))
    return batch.packed(turns, "conv_id", 600)


@query("""WITH m AS (SELECT user_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
r AS (SELECT user_id, run, count(*) AS length FROM m WHERE failed GROUP BY ALL)
SELECT user_id, max(length) AS longest, CAST(sum(CASE WHEN length >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS trips FROM r GROUP BY user_id""")
def breaker_runs(spark, sf_dir):
    return batch.failure_runs(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")


@query("""WITH cache AS (SELECT md5(lower(text)) AS key, md5(text) AS text_hash, 'v' || CAST(conv_id AS VARCHAR) AS value FROM conversations WHERE turn = 0),
by_key AS (SELECT key, min(value) AS v FROM cache GROUP BY key), by_text AS (SELECT text_hash, min(value) AS v FROM cache GROUP BY text_hash)
SELECT conv_id, turn, coalesce(k.v, t.v) AS value FROM conversations AS c LEFT JOIN by_key AS k ON k.key = md5(lower(c.text)) LEFT JOIN by_text AS t ON t.text_hash = md5(c.text)""")
def checkpoint_lookup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.md5(F.lower("text"))).withColumn("text_hash", F.md5("text"))
    cache = turns.where("turn = 0").select("key", "text_hash", F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("value"))
    return batch.cached(turns.select("conv_id", "turn", "key", "text_hash"), cache).select("conv_id", "turn", "value")


@query("""WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS x FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, list(role ORDER BY turn) AS y FROM conversations WHERE turn < 5 GROUP BY conv_id)
SELECT conv_id, coalesce(x = y, false) AS aligned FROM a LEFT JOIN b USING (conv_id)""")
def alignment_check(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("type"))
    return batch.aligned(blocks, blocks.where("pos < 5"), "conv_id")


_LINES = """pages_ AS (SELECT source AS doc, doc_id AS page, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc, page, i - 1 AS nth, len(ls) - 1 AS last, ls[i] AS text FROM pages_, unnest(range(1, len(ls) + 1)) AS t(i))"""


@query(rf"""WITH {_LINES}, near AS (SELECT doc, page, trim(regexp_replace(text, '\d+', '#', 'g')) AS key FROM lines WHERE nth < 2 OR last - nth < 2),
found AS (SELECT doc, key, count(DISTINCT page) AS on_pages FROM near GROUP BY ALL), total AS (SELECT source AS doc, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
SELECT doc, key, on_pages, pages FROM found JOIN total USING (doc) WHERE on_pages >= 0.1 * pages AND pages > 1""")
def furniture_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("nth", "text"))
    return pdf.furniture(d, share=0.1)


_RUNS = "runs AS (SELECT l_orderkey // 50 AS doc, l_returnflag AS font, round(l_quantity / 3, 1) AS size, repeat('x', l_linenumber) AS text, l_extendedprice / 1000 AS x, l_tax * 10 AS width, l_linenumber % 3 AS page, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"


def _runs(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 50).alias("doc"), c("l_returnflag").alias("font"), F.round(c("l_quantity") / 3, 1).alias("size"), F.expr("repeat('x', l_linenumber)").alias("text"), (c("l_extendedprice") / 1000).alias("x"), (c("l_tax") * 10).alias("width"), (c("l_linenumber") % 3).alias("page"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"))


@query(f"WITH {_RUNS}, s AS (SELECT doc, round(size, 1) AS size, sum(length(text)) AS n FROM runs GROUP BY 1, 2) SELECT doc, arg_max(size, (n, size)) AS body_size FROM s GROUP BY doc")
def pdf_body_size(spark, sf_dir):
    return pdf.body_size(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, v AS (SELECT doc, font, stddev_pop(width / length(text)) / avg(width / length(text)) AS variation, count(*) AS n, count(DISTINCT text) AS kinds FROM runs GROUP BY doc, font)
SELECT doc, font, variation <= 0.02 AND n >= 8 AND kinds >= 4 AS mono FROM v""")
def pdf_monospaced(spark, sf_dir):
    return pdf.monospaced(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, g AS (SELECT doc, page, x - max(x + width) OVER (PARTITION BY doc, page ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM runs)
SELECT doc, page, round(max(gap), 6) AS gutter FROM g GROUP BY doc, page""")
def pdf_gutters(spark, sf_dir):
    return pdf.gutters(_runs(spark, sf_dir)).withColumn("gutter", F.round("gutter", 6))


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM n GROUP BY user_id, session""")
def debounce_last(spark, sf_dir):
    from folioscope.streaming.edits import debounced

    return debounced(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source ORDER BY n DESC, lang, source")
def counting_rewrites(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source")


@query("""SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '/s/') AND page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def sitemap(spark, sf_dir):
    unlisted = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", "url").where(~F.col("url").contains("/s/")).join(unlisted, "page_id", "left_anti")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), revenue.alias("revenue"), F.count("*").alias("n"))
