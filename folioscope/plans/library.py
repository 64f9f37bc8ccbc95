"""Queries over listings, short links and URL identity."""

from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.operators import library, maintenance
from folioscope.plans.registry import query
from folioscope.plans.tables import table

_ORDERED = "ordered AS (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id) - 1 AS position FROM events)"


@query(f"WITH {_ORDERED} SELECT event_id, position, position // 12 + 1 AS page FROM ordered")
def library_newest(spark, sf_dir):
    return library.numbered(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "position", "page")


@query(f"WITH {_ORDERED} SELECT event_id, ts FROM ordered WHERE position // 12 + 1 = 3")
def library_page(spark, sf_dir):
    return library.page(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 3)


@query("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 12)) AS BIGINT) AS pages FROM events")
def library_page_count(spark, sf_dir):
    return library.page_count(table(spark, sf_dir, "events"))


@query("""WITH asked AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS current, CAST(r_regionkey * 6 + 1 AS INTEGER) AS last FROM nation, region WHERE n_nationkey < r_regionkey * 6 + 1),
shown AS (SELECT DISTINCT current, last, n FROM asked, unnest([1, last, current - 1, current, current + 1]) AS u(n) WHERE n BETWEEN 1 AND last),
gaps AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY current, last ORDER BY n), 0) AS gap FROM shown)
SELECT current, last, string_agg(CASE WHEN gap = 2 THEN (n - 1) || ' ' || n WHEN gap > 2 THEN '… ' || n ELSE CAST(n AS VARCHAR) END, ' ' ORDER BY n) AS pager FROM gaps GROUP BY current, last""")
def pager_window(spark, sf_dir):
    last = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 6 + 1).cast("int").alias("last"))
    asked = last.select("last", F.explode(F.sequence(F.lit(1), F.least("last", F.lit(25)))).alias("current"))
    return asked.select("current", "last", library.pager(F.col("current"), F.col("last")).alias("pager"))


@query("""SELECT event_id, lag(event_id) OVER w AS newer, lead(event_id) OVER w AS older FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id)""")
def neighbours(spark, sf_dir):
    return library.neighbours(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "ts", "event_id", "user_id").select("event_id", "newer", "older")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 100")
def feed_newest(spark, sf_dir):
    return library.feed(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "ts", "event_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'pending' WHEN lang = 'de' THEN 'zh-original' WHEN doc_id % 2 = 0 AND NOT doc_id % 7 = 0 THEN 'translated' ELSE 'untranslated' END AS status FROM documents""")
def document_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    done = F.when(F.col("doc_id") % 5 != 0, F.lit("2026-01-01"))
    lang = F.when(F.col("lang") == "de", "zh").otherwise("en")
    return d.select("doc_id", library.status(done, lang, F.col("doc_id") % 7 == 0, F.col("doc_id") % 2 == 0).alias("status"))


@query("SELECT event_id, CASE WHEN year(ts) = 2024 THEN strftime(ts, '%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS label FROM events")
def date_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", library.date_label(F.col("ts"), 2024).alias("label"))


_TRACKING = "utm_.*|" + "|".join(urls.TRACKING)
_NORMAL = rf"""parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS origin,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
filtered AS (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_full_match(regexp_extract(p, '^([^=]*)', 1), '{_TRACKING}')) AS kept FROM parts),
normal AS (SELECT page_id, origin || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS url, origin, path FROM filtered)"""


@query(f"WITH {_NORMAL} SELECT page_id, url FROM normal")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_host_path(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, "^[A-Za-z]+://([^/?#]*)", 1)).alias("host"), F.regexp_extract(u, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


_SLUGGED = _NORMAL + r""", slugged AS (SELECT page_id, url,
  regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '') || CASE WHEN path = '' THEN '/' ELSE path END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') || '-' || substr(sha256(url), 1, 8) AS slug FROM normal)"""


@query(f"WITH {_SLUGGED} SELECT page_id, slug FROM slugged")
def url_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.slug(F.col("url")).alias("slug"))


@query(f"WITH {_SLUGGED} SELECT right(slug, 8) AS id, count(*) AS claims, min(slug) AS slug, count(*) = 1 AS given FROM (SELECT DISTINCT slug FROM slugged) GROUP BY 1")
def short_links(spark, sf_dir):
    return library.short_links(table(spark, sf_dir, "pages").select(urls.slug(F.col("url")).alias("slug")).distinct())


@query(f"""WITH {_SLUGGED}, had AS (SELECT page_id, slug AS new_slug, CASE page_id % 3 WHEN 0 THEN slug ELSE 'old-' || page_id END AS slug FROM slugged),
moved AS (SELECT slug, new_slug, count(*) OVER (PARTITION BY new_slug) > 1 OR new_slug IN (SELECT slug FROM had) AS conflict FROM had WHERE slug <> new_slug)
SELECT slug, new_slug, conflict FROM moved""")
def recanonicalize(spark, sf_dir):
    """A third of the pages have the name that their address gives, others an old one; some of the new names are taken."""
    rows = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 3 == 0, urls.slug(F.col("url"))).otherwise(F.concat(F.lit("old-"), F.col("page_id").cast("string"))).alias("slug"), "url")
    return maintenance.recanonicalized(rows).select("slug", "new_slug", "conflict")


@query("""WITH s AS (SELECT page_id, 'p-000000' || substr(sha256(url), 1, 2) || '-x' AS broken, 'p' || page_id || '-000000' || substr(sha256(url), 1, 2) AS slug FROM pages)
SELECT right(slug, 8) AS id, count(*) AS claims, min(slug) AS slug, false AS given FROM s GROUP BY 1 HAVING count(*) > 1""")
def short_link_collisions(spark, sf_dir):
    slugs = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("-000000"), F.substring(F.sha2("url", 256), 1, 2)).alias("slug"))
    return library.short_links(slugs).where(~F.col("given"))


_PAPER = "lpad(CAST(1000 + page_id % 9000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0')"
_OLD_PAPER = "'cs/' || lpad(CAST(page_id % 10000000 AS VARCHAR), 7, '0')"


@query(f"""SELECT page_id, CASE WHEN page_id % 5 < 2 THEN {_PAPER} WHEN page_id % 5 = 2 THEN {_OLD_PAPER} END AS id, CASE page_id % 5 WHEN 0 THEN 3 WHEN 2 THEN 12 END AS version,
  CASE WHEN page_id % 5 < 2 THEN 'https://arxiv.org/abs/' || {_PAPER} WHEN page_id % 5 = 2 THEN 'https://arxiv.org/abs/' || {_OLD_PAPER} WHEN page_id % 5 = 3 THEN 'https://arxiv.org/list/cs.CL/' || page_id ELSE url END AS canonical FROM pages""")
def arxiv_refs(spark, sf_dir):
    """A paper's file, its reading view, an old number with a subject class, a list, and every page's own address."""
    k, n = F.col("page_id") % 5, F.col("page_id")
    new = F.concat(F.lpad((1000 + n % 9000).cast("string"), 4, "0"), F.lit("."), F.lpad((n % 100000).cast("string"), 5, "0"))
    old = F.lpad((n % 10000000).cast("string"), 7, "0")
    url = (
        F.when(k == 0, F.concat(F.lit("https://arxiv.org/pdf/"), new, F.lit("v3.pdf")))
        .when(k == 1, F.concat(F.lit("http://ar5iv.labs.arxiv.org/html/"), new, F.lit("?x#y")))
        .when(k == 2, F.concat(F.lit("https://export.arxiv.org/abs/cs.LG/"), old, F.lit("v12")))
        .when(k == 3, F.concat(F.lit("https://arxiv.org/list/cs.CL/"), n.cast("string")))
        .otherwise(F.col("url"))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return rows.select("page_id", urls.arxiv(F.col("url"))["id"].alias("id"), urls.arxiv(F.col("url"))["version"].alias("version"), urls.canonical(F.col("url")).alias("canonical"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://github.com/owner/r' || page_id || '/blob/main/docs/A.md' WHEN 1 THEN 'https://github.com/owner/r' || page_id || '/blob/main/README.md'
  WHEN 2 THEN 'https://github.com/o/r/blob/v1.0/x' || page_id || '.markdown' WHEN 3 THEN 'https://github.com/o/r/tree/main/x' || page_id || '.md' ELSE url END AS canonical FROM pages""")
def github_refs(spark, sf_dir):
    """A Markdown file's page, its raw text by a branch's full name, by a tag with a line, a folder, and every page's own address."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    url = (
        F.when(k == 0, F.concat(F.lit("https://github.com/Owner/R"), n, F.lit("/blob/main/docs/A.md")))
        .when(k == 1, F.concat(F.lit("https://raw.githubusercontent.com/Owner/R"), n, F.lit("/refs/heads/main/README.md")))
        .when(k == 2, F.concat(F.lit("https://www.github.com/o/r/raw/v1.0/x"), n, F.lit(".markdown?plain=1#L3")))
        .when(k == 3, F.concat(F.lit("https://github.com/o/r/tree/main/x"), n, F.lit(".md")))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(url).alias("canonical"))


@query(r"""WITH h AS (SELECT page_id, (page_id * 37 % 256) || '.' || (page_id * 91 % 256) || '.' || (page_id % 256) || '.7' AS host FROM pages)
SELECT host, regexp_matches(host, '^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^198\.(?:1[89]|51\.100)\.|^203\.0\.113\.|^(?:22[4-9]|2[34][0-9]|25[0-5])\.') AS private FROM h""")
def private_addresses(spark, sf_dir):
    p = F.col("page_id")
    host = F.concat_ws(".", (p * 37 % 256).cast("string"), (p * 91 % 256).cast("string"), (p % 256).cast("string"), F.lit("7"))
    return table(spark, sf_dir, "pages").select(host.alias("host")).select("host", urls.private_ipv4(F.col("host")).alias("private"))


@query("""SELECT user_id, event_id, ts, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 500""")
def clip_history_topk(spark, sf_dir):
    from folioscope.operators.similar import HISTORY_CAP, latest

    return latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", HISTORY_CAP).select("user_id", "event_id", "ts", F.col("nth").cast("long").alias("nth"))
