"""Queries over collections, edit logs and integrity."""

from pyspark.sql import functions as F

from folioscope.operators import collections, validate
from folioscope.plans.registry import query
from folioscope.plans.tables import ITEMS, OPS, SHELF, items, ops, shelf, table


@query(f"WITH {ITEMS}, {SHELF} SELECT collection, string_agg(CAST(slug AS VARCHAR), ',' ORDER BY pos) AS members FROM items SEMI JOIN shelf USING (slug) GROUP BY collection")
def collections_join(spark, sf_dir):
    rows = collections.in_order(collections.members(items(spark, sf_dir), shelf(spark, sf_dir)))
    return rows.select("collection", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"""WITH {ITEMS}, {SHELF}, listed AS (SELECT * FROM items SEMI JOIN shelf USING (slug)),
marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(section) OVER w IS DISTINCT FROM section THEN 1 ELSE 0 END AS new FROM listed WINDOW w AS (PARTITION BY collection ORDER BY pos)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY collection ORDER BY pos) AS run FROM marked)
SELECT collection, CAST(run AS BIGINT) AS run, min(section) AS title, count(*) AS n, min(pos) AS first_pos FROM runs GROUP BY collection, run""")
def collections_sections(spark, sf_dir):
    return collections.sections(collections.members(items(spark, sf_dir), shelf(spark, sf_dir)))


@query(f"WITH {ITEMS} SELECT slug, string_agg(CAST(collection AS VARCHAR), ',' ORDER BY collection) AS collections FROM (SELECT DISTINCT slug, collection FROM items) GROUP BY slug")
def membership_index(spark, sf_dir):
    return collections.membership(items(spark, sf_dir)).select("slug", F.array_join(F.col("collections").cast("array<string>"), ",").alias("collections"))


@query(f"""WITH {ITEMS}, firsts AS (SELECT collection, slug % 97 AS image, min(pos) AS pos FROM items GROUP BY ALL)
SELECT collection, image, nth FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY pos, image) AS nth FROM firsts) WHERE nth <= 3""")
def covers_top3(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("image", F.col("slug") % 97)
    return collections.covers(rows, "image").select("collection", "image", F.col("nth").cast("long").alias("nth"))


@query(f"WITH {ITEMS}, {SHELF} SELECT collection, pos, slug FROM items ANTI JOIN shelf USING (slug)")
def dangling_members(spark, sf_dir):
    return collections.dangling(items(spark, sf_dir), shelf(spark, sf_dir)).select("collection", "pos", "slug")


@query(f"WITH {ITEMS} SELECT collection, slug, count(*) AS n FROM items GROUP BY ALL HAVING count(*) > 1")
def dup_members(spark, sf_dir):
    return collections.repeated(items(spark, sf_dir))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def orphan_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH c AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS updated_at FROM customer UNION ALL SELECT 'favorites', NULL)
SELECT id, row_number() OVER (ORDER BY id <> 'favorites', updated_at DESC NULLS LAST, id) AS nth FROM c""")
def collection_order_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("updated_at"))
    return collections.numbered(collections.with_favorites(c)).select("id", "nth")


@query(f"""WITH {OPS} SELECT collection, slug, arg_max(action, ("at", seq)) AS action, max("at") AS "at" FROM ops GROUP BY collection, slug""")
def effective_membership(spark, sf_dir):
    return collections.effective(ops(spark, sf_dir))


@query(f"""WITH {OPS}, published AS (SELECT DISTINCT user_id AS collection, event_id % 50 AS slug, CAST(event_id % 50 AS INTEGER) AS pos FROM events WHERE event_type = 'signup'),
last AS (SELECT collection, slug, arg_max(action, ("at", seq)) AS action, max("at") AS "at" FROM ops GROUP BY collection, slug),
both_sides AS (SELECT p.collection, p.slug, 0 AS front, CAST(NULL AS TIMESTAMP) AS "at", p.pos FROM published AS p ANTI JOIN (SELECT * FROM last WHERE action = 'remove') AS r USING (collection, slug)
  UNION ALL SELECT l.collection, l.slug, 1, l."at", NULL FROM (SELECT * FROM last WHERE action = 'add') AS l ANTI JOIN published AS q USING (collection, slug))
SELECT collection, slug, row_number() OVER (PARTITION BY collection ORDER BY front DESC, "at" DESC NULLS LAST, pos NULLS FIRST, slug) AS pos FROM both_sides""")
def edit_log_fold(spark, sf_dir):
    published = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("collection"), (F.col("event_id") % 50).alias("slug"), (F.col("event_id") % 50).cast("int").alias("pos")).distinct()
    return collections.edited(published, ops(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {ITEMS}, flagged AS (SELECT *, max(CASE WHEN slug = 8 THEN 1 ELSE 0 END) OVER (PARTITION BY collection) AS has FROM items)
SELECT collection, pos, CASE WHEN slug = 7 THEN 8 ELSE slug END AS slug FROM flagged WHERE slug <> 7 OR has = 0""")
def rename_member(spark, sf_dir):
    return collections.renamed(items(spark, sf_dir), 7, 8).select("collection", "pos", F.col("slug").cast("long").alias("slug"))


_ARTICLES = """articles AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS slug, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS title,
  CASE WHEN p_partkey % 13 = 0 THEN 'ftp:x' ELSE 'https://h.example/' || CAST(p_partkey // 2 * (p_partkey % 17) AS VARCHAR) END AS url, CASE WHEN p_partkey % 19 = 0 THEN ['A_b', 'c'] ELSE ['x', 'y'] END AS tags FROM part)"""


@query(f"""WITH {_ARTICLES}, m AS (SELECT l_orderkey AS collection, 'p' || CAST(l_partkey * 2 AS VARCHAR) AS slug FROM lineitem), tr AS (SELECT 'p' || CAST(p_partkey * 3 AS VARCHAR) AS slug FROM part)
SELECT 'title-empty' AS rule, slug AS subject FROM articles WHERE trim(title) = ''
UNION ALL SELECT 'url-invalid', slug FROM articles WHERE NOT regexp_matches(url, '^(?:https?://[^/\\s]+|local:.)')
UNION ALL SELECT 'url-twice', min(slug) FROM articles GROUP BY url HAVING count(*) > 1
UNION ALL SELECT 'tags-form', slug FROM articles WHERE tags[1] = 'A_b'
UNION ALL SELECT 'member-dangling', slug FROM m ANTI JOIN articles USING (slug)
UNION ALL SELECT 'member-twice', slug FROM (SELECT slug FROM m GROUP BY collection, slug HAVING count(*) > 1)
UNION ALL SELECT 'translation-orphan', slug FROM tr ANTI JOIN articles USING (slug)""".replace("\\\\", "\\"))
def vault_violations(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    articles = part.select(
        F.concat(F.lit("p"), k.cast("string")).alias("slug"), F.when(k % 11 == 0, " ").otherwise(F.col("p_name")).alias("title"),
        F.when(k % 13 == 0, "ftp:x").otherwise(F.concat(F.lit("https://h.example/"), (F.floor(k / 2) * (k % 17)).cast("string"))).alias("url"),
        F.when(k % 19 == 0, F.array(F.lit("A_b"), F.lit("c"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("tags"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("collection"), F.concat(F.lit("p"), (F.col("l_partkey") * 2).cast("string")).alias("slug"))
    return validate.violations(articles, members, part.select(F.concat(F.lit("p"), (k * 3).cast("string")).alias("slug")))
