"""The pages of a site as wide rows: an article with all that its page shows, terms, collections, the search index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import library


def article_pages(articles: DataFrame, items: DataFrame, listed_terms: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each article (slug, url, tags), unlisted ones too: collections, short or long link, terms with a page.

    ids are the short ids (slug, id) to link by; without them those that are given, to one claimant each.
    """
    ids = library.short_links(articles.select("slug")).where("given") if ids is None else ids
    members = items.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set(F.col("collection").cast("string"))), ",").alias("collections"))
    links = ids.select("slug", F.concat(F.lit("/s/"), "id", F.lit("/")).alias("short"))
    tags = articles.select("slug", F.posexplode("tags").alias("pos", "tag")).join(listed_terms.select(F.col("term").alias("tag")).distinct(), "tag", "left_semi")
    shown = tags.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda t: t["tag"]), "|").alias("terms"))
    out = articles.select("slug", "url").join(members, "slug", "left").join(links, "slug", "left").join(shown, "slug", "left")
    return out.select("slug", "url", F.coalesce("collections", F.lit("")).alias("collections"), F.coalesce("short", F.concat(F.lit("/articles/"), "slug", F.lit("/"))).alias("link"), F.coalesce("terms", F.lit("")).alias("terms"))


def search_index(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Postings by field: term, field, doc_id, tf; fields are stacked before they are split, so each text is read once."""
    stacked = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f"))
    words = F.filter(F.split(F.lower(F.coalesce("f.text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return stacked.select("doc_id", "f.field", F.explode(words).alias("term")).groupBy("term", "field", "doc_id").agg(F.count("*").alias("tf"))


def matching_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that have every term in some field."""
    hit = index.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"), F.sum("tf").alias("tf"))
    return hit.where(F.col("n") == len(set(terms))).select("doc_id", "tf")


def dispatched(fetched: DataFrame) -> DataFrame:
    """What to do with a fetched page (media_type, url, landed, visible): by its address, type and length."""
    from folioscope.functions import html, urls

    kind = (
        F.when(html.sent_to_sign_in(F.col("url"), F.col("landed")), "sign-in")
        .when(urls.arxiv(F.col("url")).isNotNull(), "paper")
        .when(urls.github_document(F.col("url")).isNotNull(), "markdown")
        .when(F.col("media_type").startswith("application/pdf"), "pdf")
        .when(~F.col("media_type").rlike("^(?:text/html|application/xhtml)"), "unsupported")
        .when(F.col("visible") < 500, "thin")
        .otherwise("page")
    )
    return fetched.withColumn("route", kind)
