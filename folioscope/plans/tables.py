"""The driver's tables read as a library: documents with tags, collections with items, pages with URLs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (slug, tags): source, language in two cases, a topic, and one tag spelled two ways."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("slug"),
        F.array("source", F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")), F.concat(F.lit("Topic-"), (F.col("doc_id") % 7).cast("string")), F.when(F.col("doc_id") % 2 == 0, F.lit("open-source")).otherwise(F.lit("Open_Source")), F.lit("#Reading ")).alias("tags"),
    )


TAGGED = """tagged AS (SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS slug,
  [source, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END, 'Topic-' || CAST(doc_id % 7 AS VARCHAR),
   CASE WHEN doc_id % 2 = 0 THEN 'open-source' ELSE 'Open_Source' END, '#Reading '] AS tags FROM documents)"""

NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\s_]+', ' ', 'g'), '([^0-9-])-+([^0-9-])', '\1 \2', 'g'), '^[\s#]+', ''), '[\s.,;:!?]+$', '')"

EXPLODED = TAGGED + f""", raw AS (SELECT slug, i AS pos, tags[i] AS t FROM tagged, unnest(range(1, len(tags) + 1)) AS u(i)),
normal AS (SELECT slug, pos, {NORMAL} AS tag FROM raw),
exploded AS (SELECT slug, tag, lower(tag) AS key FROM normal WHERE tag <> '' QUALIFY row_number() OVER (PARTITION BY slug, lower(tag) ORDER BY pos) = 1)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as members of collections: an order's customer is the collection, the part the document.

    A line number that an order has twice is one item.
    """
    o, line = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
    joined = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = joined.select(F.col("o_custkey").alias("collection"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("slug"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("section"))
    return rows.groupBy("collection", "pos").agg(F.min("slug").alias("slug"), F.min("section").alias("section"))


ITEMS = """items AS (SELECT o_custkey AS collection, l_orderkey * 10 + l_linenumber AS pos, min(l_partkey) AS slug,
  min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS section FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under a price as the documents that are listed."""
    return table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("slug"))


SHELF = "shelf AS (SELECT p_partkey AS slug FROM part WHERE p_size <= 40)"


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits: a user's collection, a document, add or remove."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("collection"), (F.col("event_id") % 50).alias("slug"), F.when(F.col("event_type").isin("error", "click"), "remove").otherwise("add").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


OPS = """ops AS (SELECT user_id AS collection, event_id % 50 AS slug,
  CASE WHEN event_type IN ('error', 'click') THEN 'remove' ELSE 'add' END AS action, ts AS "at", event_id AS seq FROM events)"""
