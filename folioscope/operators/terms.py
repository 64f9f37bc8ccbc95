"""Terms of documents: groups by route, vocabularies and reports. A document is (slug, tags)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import tags
from folioscope.operators import ranks

#: A vocabulary's least documents and its size; a report's longest list.
LEAST_DOCUMENTS, VOCABULARY_SIZE, TOP = 2, 150, 20


def exploded(docs: DataFrame, aliases=None) -> DataFrame:
    """slug, tag and key, one row for each tag of a document in written form."""
    return docs.select("slug", F.explode(tags.listed(F.col("tags"), aliases, None)).alias("tag")).withColumn("key", F.lower("tag"))


def index(docs: DataFrame) -> DataFrame:
    """Terms by route: the most common spelling (of equals the first seen, by slug and place) and the documents.

    Spellings are counted before they meet, so a term that a third of all documents have is few rows by then.
    """
    raw = docs.select("slug", F.posexplode("tags").alias("pos", "label")).withColumn("term", tags.slug(F.col("label")))
    spelled = raw.groupBy("term", "label").agg(F.count("*").alias("n"), F.min(F.struct("slug", "pos")).alias("first"))
    best = spelled.groupBy("term").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "first")).alias("label"))
    items = raw.groupBy("term").agg(F.count_distinct("slug").alias("items"))
    return best.join(items, "term").select("term", "label", "items")


def spellings(docs: DataFrame, aliases=None) -> DataFrame:
    return exploded(docs, aliases).groupBy("key", "tag").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame, aliases=None, size: int = VOCABULARY_SIZE) -> DataFrame:
    """Settled tags of two documents at least, the most used first, each in its most used spelling."""
    settled = spellings(docs, aliases).where(~tags.undecided(F.col("tag")))
    best = settled.groupBy("key").agg(F.sum("n").alias("articles"), F.min_by("tag", F.struct((-F.col("n")).alias("n"), "tag")).alias("tag"))
    return best.where(F.col("articles") >= LEAST_DOCUMENTS).orderBy(F.desc("articles"), "key").limit(size)


def undecided(docs: DataFrame) -> DataFrame:
    return exploded(docs).where(tags.undecided(F.col("tag"))).groupBy("tag").agg(F.count("*").alias("articles"))


def variants(docs: DataFrame) -> DataFrame:
    """Keys written in more than one way, the most used way first."""
    found = spellings(docs).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))).alias("all")).where(F.size("all") > 1)
    return found.select("key", F.array_join("all.tag", "|").alias("variants"))


def plurals(docs: DataFrame) -> DataFrame:
    """Keys that stand beside their plural."""
    keys = exploded(docs).select("key").distinct()
    return keys.join(keys.select(F.col("key").alias("plural")), F.concat("key", F.lit("s")) == F.col("plural")).select("key", "plural")


def report(docs: DataFrame) -> DataFrame:
    """One row: documents, distinct terms, terms of one document, vocabulary, documents with few or many tags."""
    per_key = exploded(docs).groupBy("key").agg(F.count("*").alias("n"))
    terms = per_key.agg(F.count("*").alias("distinct_terms"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("singletons"))
    n = F.size(tags.listed(F.col("tags"), None, None))
    docs_row = docs.agg(F.count("*").alias("articles"), F.sum((n < tags.FEWEST).cast("long")).alias("few"), F.sum((n > tags.TAG_LIMIT).cast("long")).alias("many"))
    known = vocabulary(docs).agg(F.count("*").alias("vocabulary"))
    one = F.lit(1)
    return docs_row.withColumn("k", one).join(terms.withColumn("k", one), "k").join(known.withColumn("k", one), "k").drop("k")


def counted(docs: DataFrame) -> DataFrame:
    """Terms by route with their number of articles and of sites; docs have slug, kind and tags."""
    raw = docs.select("slug", "kind", F.explode(F.array_distinct(F.transform("tags", tags.slug))).alias("term"))
    count = lambda kind: F.coalesce(F.sum((F.col("kind") == kind).cast("long")), F.lit(0)).alias(f"{kind}s")
    return raw.groupBy("term").agg(count("article"), count("site"))


def members(docs: DataFrame, at: str, size: int = 12) -> DataFrame:
    """Each term's documents (slug, kind, tags, a time) by page, newest first.

    Positions are counted within ranges of a term, so one that a third of all documents have is many tasks.
    """
    raw = docs.select("slug", "kind", at, F.explode(F.array_distinct(F.transform("tags", tags.slug))).alias("term"))
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    placed = ranks.numbered(raw, "term", F.struct(micros.isNull().alias("none"), (-micros).alias("at"), F.col("slug").alias("slug")))
    return placed.select("term", "slug", "kind", "position", (F.floor(F.col("position") / size) + 1).cast("long").alias("page"))


def tally(rows: DataFrame, column: str) -> DataFrame:
    """One row: the column's values with how often each stands, the most frequent first, as `value×n`."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("value IS NOT NULL")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value")))
    return counts.agg(F.array_join(F.transform(ranked, lambda r: F.concat(r["value"], F.lit("×"), (-r["n"]).cast("string"))), ", ").alias("tally"))


#: Fixed value: terms that a page shows before the rest is asked for.
CHIPS = 30


def chips(counted: DataFrame, collation: str = "zh", shown: int = CHIPS) -> DataFrame:
    """Terms (label, n) with their place, most used first, ties as readers of the collation's language sort them."""
    place = F.struct((-F.col("n")).alias("n"), F.collate("label", collation).alias("label"), F.col("label").alias("code"))
    return ranks.numbered(counted, None, place).withColumn("first", F.col("position") < shown)
