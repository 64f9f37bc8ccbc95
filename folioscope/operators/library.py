"""Listings: order, pages, neighbours, states, feeds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import ranks

PAGE_SIZE, FEED_SIZE = 12, 100


def instant(text: Column) -> Column:
    """An ISO time with offset as an instant; others are missing."""
    return F.try_to_timestamp(text)


def newest(docs: DataFrame, at: str = "clipped_at", key: str = "slug") -> list[Column]:
    """The library's order: newest first, missing times last, ties by key."""
    return [F.col(at).desc_nulls_last(), F.col(key).asc()]


def _place(at: str, key: str) -> Column:
    """A document's place in the library's order, as a value that grows with it."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return F.struct(micros.isNull().alias("none"), (-micros).alias("at"), F.col(key).alias("key"))


def numbered(docs: DataFrame, at: str, key: str, size: int = PAGE_SIZE) -> DataFrame:
    """Each document's position in the library (from 0) and page (from 1); ranges are counted, so a day of any size is fine."""
    placed = ranks.numbered(docs, None, _place(at, key))
    return placed.withColumn("page", F.floor(F.col("position") / size).cast("long") + 1)


def page_count(docs: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return docs.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def page(docs: DataFrame, at: str, key: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page by its number, however far back: positions are counted by ranges, and only the page's rows are sorted."""
    return numbered(docs, at, key, size).where(F.col("page") == number).orderBy("position").drop("position", "page")


def pager(current: Column, last: Column) -> Column:
    """Numbers to show: ends, the page and its neighbours; a gap of one shows its number, a longer one '…'."""
    shown = F.array_sort(F.array_distinct(F.filter(F.array(F.lit(1), last, current - 1, current, current + 1), lambda n: n.between(1, last))))

    def with_gap(n: Column, i: Column) -> Column:
        gap = n - F.when(i == 0, F.lit(0)).otherwise(F.get(shown, i - 1))
        own = n.cast("string")
        return F.when(gap == 2, F.array((n - 1).cast("string"), own)).when(gap > 2, F.array(F.lit("…"), own)).otherwise(F.array(own))

    return F.array_join(F.flatten(F.transform(shown, with_gap)), " ")


def status(processed_at: Column, lang: Column, failed: Column, has_translation: Column) -> Column:
    """pending before processing, then by language and translation."""
    return F.when(processed_at.isNull(), "pending").when(lang == "zh", "zh-original").when(has_translation & ~F.coalesce(failed, F.lit(False)), "translated").otherwise("untranslated")


def neighbours(docs: DataFrame, at: str, key: str, within: str) -> DataFrame:
    """The newer and older document of each one in its group.

    They are looked up within ranges; a range's ends get theirs from the ranges beside it, a row for each group and range.
    """
    placed = ranks.ranged(docs, within, _place(at, key))
    ends = placed.groupBy(F.col(within).alias("_within"), F.col("_range").alias("_of")).agg(F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"))
    ranges = Window.partitionBy("_within").orderBy("_of")
    beside = ends.select("_within", "_of", F.lag("_last").over(ranges).alias("_newer"), F.lead("_first").over(ranges).alias("_older"))
    order = Window.partitionBy(within, "_range").orderBy("_at")
    inside = placed.withColumn("newer", F.lag(key).over(order)).withColumn("older", F.lead(key).over(order))
    joined = inside.join(beside, F.col(within).eqNullSafe(F.col("_within")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn("newer", F.coalesce("newer", "_newer")).withColumn("older", F.coalesce("older", "_older")).drop("_at", "_range", "_within", "_of", "_newer", "_older")


def feed(docs: DataFrame, at: str, key: str, size: int = FEED_SIZE) -> DataFrame:
    return docs.orderBy(*newest(docs, at, key)).limit(size)


def claims(slugs: DataFrame) -> DataFrame:
    """slug and the id that its name claims, whether it is given or not; a name without one is left out."""
    from folioscope.functions.urls import short_id

    return slugs.select("slug", short_id(F.col("slug")).alias("id")).where("id IS NOT NULL")


def short_links(slugs: DataFrame) -> DataFrame:
    """id, the slugs that claim it, and whether it is given: only an id with one claimant is."""
    return claims(slugs).groupBy("id").agg(F.count("*").alias("claims"), F.min("slug").alias("slug")).withColumn("given", F.col("claims") == 1)


def date_label(at: Column, year: int) -> Column:
    """Day and month, with the year unless it is this one."""
    return F.when(F.year(at) == year, F.date_format(at, "MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def of_both_kinds(articles: DataFrame, sites: DataFrame) -> DataFrame:
    """Articles and saved sites as one table with their kind; fields that one kind lacks are null."""
    return articles.withColumn("kind", F.lit("article")).unionByName(sites.withColumn("kind", F.lit("site")), allowMissingColumns=True)


def site_rows(sites: DataFrame) -> DataFrame:
    """What a saved site's page shows (slug, url, title, title_zh, description, summary, note, preview): the translated texts first."""
    return sites.select(
        "slug",
        "url",
        F.coalesce(F.nullif(F.trim("title_zh"), F.lit("")), "title").alias("title"),
        F.coalesce(F.nullif(F.trim("summary"), F.lit("")), "description").alias("description"),
        "note",
        F.when(F.col("preview").isNotNull(), F.concat(F.lit("/sites/"), "slug", F.lit("/"), F.regexp_replace("preview", r"^\./", ""))).alias("preview"),
    )
