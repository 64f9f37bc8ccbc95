"""Paths and names in a vault and on its site, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where old routes lead.
REDIRECTS = (("/tags/", "/search/"), ("/categories/", "/"), ("/favorites/", "/collections/favorites/"))
#: A picture's least short side, greatest ratio, least bytes where its size is unknown, and most bytes.
COVER_SIDE, COVER_RATIO, COVER_BYTES, MOST_BYTES = 150, 3, 5 * 1024, 20 << 20


def member_kind(ref: Column) -> Column:
    return F.when(ref.startswith("sites/"), "site").otherwise("article")


def view_url(kind: Column, name: Column) -> Column:
    """The page of an article, site, tag, category or collection."""
    return F.when(kind == "site", F.concat(F.lit("/"), name, F.lit("/"))).when(kind == "article", F.concat(F.lit("/articles/"), name, F.lit("/"))).otherwise(F.concat(F.lit("/"), F.when(kind == "category", "categories").when(kind == "tag", "tags").otherwise("collections"), F.lit("/"), name, F.lit("/")))


def page_url(page: Column) -> Column:
    return F.when(page <= 1, "/").otherwise(F.concat(F.lit("/page/"), page.cast("string"), F.lit("/")))


def cover_path(path: Column) -> Column:
    """struct<kind, slug, file> of an asset's path, else null."""
    pattern = r"^(articles|sites)/([a-z0-9][a-z0-9-]*)/assets/([^/]+)$"
    kind = F.regexp_extract(path, pattern, 1)
    return F.when(kind != "", F.struct(F.regexp_replace(kind, "s$", "").alias("kind"), F.regexp_extract(path, pattern, 2).alias("slug"), F.regexp_extract(path, pattern, 3).alias("file")))


def is_snapshot(name: Column) -> Column:
    return name.rlike(r"^(?:\./)?(?:assets/)?[0-9a-f]{12}\.webp$")


def snapshot_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def worth_a_cover(width: Column, height: Column, size: Column) -> Column:
    """Large and square enough; where the size is unknown, heavy enough; never too heavy to serve."""
    fits = (F.least(width, height) >= COVER_SIDE) & (F.greatest(width, height) <= F.least(width, height) * COVER_RATIO)
    return (size <= MOST_BYTES) & F.coalesce(fits, size >= COVER_BYTES)


def description(text: Column) -> Column:
    return F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("…"))).otherwise(text)


def inbox_name(at: Column, number: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(number.cast("string"), 4, "0"), F.lit(".url"))


def redirect(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for source, target in REDIRECTS:
        out = F.when(path == source, target).otherwise(out)
    return out


def archived(url: Column) -> Column:
    """The address that a web archive's URL is a copy of, else the URL."""
    inner = F.regexp_extract(url, r"^https?://web\.archive\.org/web/\d+[a-z_]*/(.+)$", 1)
    return F.when(inner != "", inner).otherwise(url)
