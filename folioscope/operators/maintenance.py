"""Jobs that go over a whole library: new identities, counts that changed, documents that leave."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import urls


def recanonicalized(articles: DataFrame) -> DataFrame:
    """Articles (slug, url) whose slug is not the one their URL gives now: slug, new_slug, and whether it is taken."""
    moved = articles.select("slug", urls.slug(F.col("url")).alias("new_slug")).where(F.col("slug") != F.col("new_slug"))
    there = articles.select(F.col("slug").alias("new_slug"), F.lit(True).alias("taken"))
    claims = F.count("*").over(Window.partitionBy("new_slug"))
    return moved.withColumn("claims", claims).join(there, "new_slug", "left").select("slug", "new_slug", (F.coalesce("taken", F.lit(False)) | (F.col("claims") > 1)).alias("conflict"))


def followed(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Items (collection, pos, slug, …) after moves (slug, new_slug, unique) of their documents.

    A moved member keeps its place; where the collection has the new one already, as a member that stays or one moved
    to it from an earlier place, it goes.
    """
    at = items.join(moves.select("slug", F.col("new_slug").alias("_new")), "slug", "left")
    first = F.struct(F.col("_new").isNotNull().alias("moved"), "pos")
    named = at.withColumn("_own", F.coalesce("_new", "slug"))
    claimed = named.join(moves.select(F.col("new_slug").alias("_own")).distinct(), "_own", "left_semi").groupBy("collection", "_own").agg(F.min(first).alias("_first"))
    kept = named.join(claimed, ["collection", "_own"], "left").where(F.col("_first").isNull() | (F.col("_first") == first))
    return kept.withColumn("slug", F.col("_own")).select(items.columns)


def covers_followed(collections: DataFrame, moves: DataFrame) -> DataFrame:
    """Collections (…, cover) whose cover, a picture of a document, follows the document; one that is gone (new_slug null) has none."""
    owner = F.regexp_extract("cover", r"^(?:articles|sites)/([^/]+)/", 1)
    joined = collections.withColumn("_owner", owner).join(moves.select(F.col("slug").alias("_owner"), "new_slug", F.lit(True).alias("_moved")), "_owner", "left")
    cover = F.concat(F.regexp_extract("cover", "^([^/]+/)", 1), "new_slug", F.regexp_extract("cover", "^[^/]+/[^/]+(/.*)$", 1))
    return joined.withColumn("cover", F.when(F.col("_moved"), cover).otherwise(F.col("cover"))).select(collections.columns)


def counts_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Differences of counts by key; a key that one side lacks counts as zeros."""
    a = before.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = after.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    diff = a.join(b, key, "full").select(key, *[(F.coalesce(f"b_{c}", F.lit(0)) - F.coalesce(f"a_{c}", F.lit(0))).alias(c) for c in columns])
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(c) != 0)
    return diff.where(changed)


def removed(articles: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles and collection items without the slugs of gone."""
    return articles.join(gone.select("slug"), "slug", "left_anti"), items.join(gone.select("slug"), "slug", "left_anti")


def chosen(candidates: DataFrame, page: str) -> DataFrame:
    """One candidate for each page: a source body first, then a fetched one, then the latest."""
    nth = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("is_source"), F.desc("from_fetch"), F.desc("arrival")))
    return candidates.withColumn("nth", nth).where("nth = 1").drop("nth")


def retag_buckets(articles: DataFrame, attempts: int) -> DataFrame:
    """Each article's bucket of a retag run: settled ones are skipped, the first `attempts` others tried, the rest remain."""
    from folioscope.functions import tags

    todo = articles.withColumn("settled", tags.settled(F.col("tags")))
    ranked = todo.where(~F.col("settled")).orderBy("slug").limit(attempts).select("slug", F.lit("tried").alias("bucket"))
    return todo.join(F.broadcast(ranked), "slug", "left").select("slug", F.coalesce("bucket", F.when(F.col("settled"), "settled").otherwise("remaining")).alias("bucket"))


def title_buckets(articles: DataFrame) -> DataFrame:
    """Each article's bucket of a backfill of titles (slug, lang, processed_at, title_zh)."""
    bucket = (
        F.when(F.col("processed_at").isNull(), "pending")
        .when(F.col("lang") == "zh", "chinese")
        .when(F.coalesce(F.trim("title_zh"), F.lit("")) != "", "there")
        .otherwise("todo")
    )
    return articles.select("slug", bucket.alias("bucket"))


def flushed(ops: DataFrame, docs: DataFrame, clipped: DataFrame, now, grace: str = "1 hour") -> DataFrame:
    """What becomes of queued edits (slug, action, …): sent if the document is there or it is removed, deferred if it was
    clipped within grace before now (clipped: slug, at), else refused."""
    recent = clipped.where((F.col("at") > now - F.expr(f"INTERVAL {grace}")) & (F.col("at") <= now)).select("slug", F.lit(True).alias("_recent")).distinct()
    joined = ops.join(docs.select("slug", F.lit(True).alias("_there")).distinct(), "slug", "left").join(recent, "slug", "left")
    fate = F.when(F.col("_there") | (F.col("action") == "remove"), "sent").when(F.col("_recent"), "deferred").otherwise("refused")
    return joined.withColumn("fate", fate).drop("_there", "_recent")
