"""Queries over terms."""

from pyspark.sql import functions as F

from folioscope.functions import tags
from folioscope.operators import terms
from folioscope.plans.registry import query
from folioscope.plans.tables import EXPLODED, TAGGED, tagged

_SLUG = r"regexp_replace(regexp_replace(regexp_replace(lower(t), '[/\\?#%\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '^[.-]+|[.-]+$', '', 'g')"
_SPELLED = "spelled AS (SELECT key, tag, count(*) AS n FROM exploded GROUP BY key, tag)"


@query(f"""WITH {TAGGED}, raw AS (SELECT slug, i AS pos, tags[i] AS t FROM tagged, unnest(range(1, len(tags) + 1)) AS u(i)),
named AS (SELECT slug, pos, t AS label, {_SLUG} AS term FROM raw),
spelled AS (SELECT term, label, count(*) AS n, min(slug || lpad(CAST(pos AS VARCHAR), 4, '0')) AS first FROM named GROUP BY term, label)
SELECT term, (SELECT label FROM spelled AS s WHERE s.term = i.term ORDER BY n DESC, first LIMIT 1) AS label, items
FROM (SELECT term, count(DISTINCT slug) AS items FROM named GROUP BY term) AS i""")
def term_index(spark, sf_dir):
    return terms.index(tagged(spark, sf_dir))


@query(f"""WITH {EXPLODED}, {_SPELLED},
settled AS (SELECT * FROM spelled WHERE NOT (regexp_matches(tag, '[A-Za-z]') AND tag = lower(tag)))
SELECT key, CAST(sum(n) AS BIGINT) AS articles, arg_min(tag, (-n, tag)) AS tag FROM settled GROUP BY key HAVING sum(n) >= 2 ORDER BY articles DESC, key LIMIT 150""")
def tag_vocabulary(spark, sf_dir):
    return terms.vocabulary(tagged(spark, sf_dir)).select("key", "articles", "tag")


@query(f"WITH {EXPLODED} SELECT tag, count(*) AS articles FROM exploded WHERE regexp_matches(tag, '[A-Za-z]') AND tag = lower(tag) GROUP BY tag")
def undecided_terms(spark, sf_dir):
    return terms.undecided(tagged(spark, sf_dir))


@query(f"""WITH {EXPLODED}, {_SPELLED} SELECT key, string_agg(tag, '|' ORDER BY n DESC, tag) AS variants FROM spelled GROUP BY key HAVING count(*) > 1""")
def tag_variants(spark, sf_dir):
    return terms.variants(tagged(spark, sf_dir))


@query(f"WITH {EXPLODED}, keys AS (SELECT DISTINCT key FROM exploded UNION SELECT 'src1s') SELECT a.key, b.key AS plural FROM keys AS a JOIN keys AS b ON b.key = a.key || 's'")
def tag_plurals(spark, sf_dir):
    docs = tagged(spark, sf_dir)
    extra = spark.range(1).select(F.lit("none").alias("slug"), F.array(F.lit("src1s")).alias("tags"))
    return terms.plurals(docs.unionByName(extra))


@query(f"""WITH {EXPLODED}, {_SPELLED}, per_key AS (SELECT key, count(*) AS n FROM exploded GROUP BY key), per_doc AS (SELECT slug, count(*) AS n FROM exploded GROUP BY slug),
known AS (SELECT key FROM spelled WHERE NOT (regexp_matches(tag, '[A-Za-z]') AND tag = lower(tag)) GROUP BY key HAVING sum(n) >= 2)
SELECT (SELECT count(*) FROM documents) AS articles, CAST((SELECT count(*) FROM per_doc WHERE n < 3) AS BIGINT) AS few, CAST((SELECT count(*) FROM per_doc WHERE n > 6) AS BIGINT) AS many,
  (SELECT count(*) FROM per_key) AS distinct_terms, CAST((SELECT count(*) FROM per_key WHERE n = 1) AS BIGINT) AS singletons, (SELECT least(count(*), 150) FROM known) AS vocabulary""")
def tag_report(spark, sf_dir):
    return terms.report(tagged(spark, sf_dir))


@query(f"WITH {EXPLODED} SELECT key, count(*) AS articles FROM exploded GROUP BY key ORDER BY articles DESC, key LIMIT 20")
def top_terms(spark, sf_dir):
    return terms.exploded(tagged(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "key").limit(terms.TOP)


@query(f"""WITH {EXPLODED}, mapped AS (SELECT e.slug, n.pos, CASE e.key WHEN 'open source' THEN 'OSS' WHEN 'reading' THEN NULL ELSE e.tag END AS tag
  FROM exploded AS e JOIN (SELECT slug, lower(tag) AS key, min(pos) AS pos FROM normal GROUP BY ALL) AS n USING (slug, key))
SELECT slug, string_agg(tag, '|' ORDER BY pos) AS tags FROM mapped WHERE tag IS NOT NULL GROUP BY slug""")
def tags_with_aliases(spark, sf_dir):
    aliases = F.create_map(F.lit("open source"), F.lit("OSS"), F.lit("reading"), F.lit(None).cast("string"))
    return tagged(spark, sf_dir).select("slug", F.array_join(tags.listed(F.col("tags"), aliases), "|").alias("tags"))


@query(f"""WITH {EXPLODED}, alias(a, b) AS (VALUES ('open source', 'OSS'), ('src1', 'Source One'), ('en', 'en'))
SELECT coalesce(b, tag) AS tag, count(*) AS n FROM exploded LEFT JOIN alias ON key = a GROUP BY 1""")
def alias_lookup(spark, sf_dir):
    alias = spark.createDataFrame([("open source", "OSS"), ("src1", "Source One"), ("en", "en")], "key string, spelled string")
    joined = terms.exploded(tagged(spark, sf_dir)).join(F.broadcast(alias), "key", "left")
    return joined.select(F.coalesce("spelled", "tag").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"""WITH {TAGGED} SELECT slug, 'form' AS problem FROM tagged UNION ALL SELECT slug, 'twice' FROM tagged WHERE lower(tags[2]) = lower(tags[1])""")
def tag_form_problems(spark, sf_dir):
    return tagged(spark, sf_dir).select("slug", F.explode(tags.form_problems(F.col("tags"))).alias("problem"))
