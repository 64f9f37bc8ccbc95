"""Ordered collections of documents: members, sections, membership, edits. Items are (collection, pos, slug, section)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import ranks

FAVORITES = "favorites"
#: Fixed value: pictures that a collection's cover shows.
COVERS = 3


def members(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Items whose document is listed, in the owner's order; others are left out."""
    return items.join(docs.select("slug"), "slug", "left_semi")


def in_order(rows: DataFrame, value: str = "slug") -> DataFrame:
    """A collection's members as one array in order."""
    return rows.groupBy("collection").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda m: m[value]).alias("members"))


def sections(rows: DataFrame) -> DataFrame:
    """Runs of members with an equal section (null equals null), in order."""
    order = Window.partitionBy("collection").orderBy("pos")
    new = F.when(F.row_number().over(order) == 1, 1).when(F.lag("section").over(order).eqNullSafe(F.col("section")), 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("collection", "run").agg(F.first("section").alias("title"), F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def membership(items: DataFrame) -> DataFrame:
    """The collections of each document, by membership and not by listing."""
    return items.groupBy("slug").agg(F.array_sort(F.collect_set("collection")).alias("collections"))


def covers(items: DataFrame, image: str, k: int = COVERS) -> DataFrame:
    """The first k different pictures of a collection's members."""
    firsts = items.groupBy("collection", image).agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("collection").orderBy("pos", image))
    return firsts.withColumn("nth", nth).where(F.col("nth") <= k)


def order(updated: str = "updated_at", id: str = "id") -> list[Column]:
    """Favorites first, then by last change, then by id."""
    return [F.col(id) != FAVORITES, F.col(updated).desc_nulls_last(), F.col(id)]


def numbered(collections: DataFrame, updated: str = "updated_at", id: str = "id") -> DataFrame:
    """Every collection's place in the order, from 1, as nth; counted by ranges, so no task sorts all collections."""
    late = F.col(updated)
    if dict(collections.dtypes)[updated].startswith("timestamp"):
        late = F.unix_micros(late)
    place = F.struct((F.col(id) != FAVORITES).alias("other"), late.isNull().alias("none"), (-late).alias("late"), F.col(id).alias("id"))
    return ranks.numbered(collections, None, place, "nth").withColumn("nth", F.col("nth") + 1)


def with_favorites(collections: DataFrame) -> DataFrame:
    """The collections, and an empty one of favorites where none has its id."""
    spark = collections.sparkSession
    row = spark.range(1).select(*[(F.lit(FAVORITES) if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in collections.schema])
    there = collections.where(F.col("id") == FAVORITES).select("id").limit(1)
    return collections.unionByName(row.join(there, "id", "left_anti"))


def effective(ops: DataFrame) -> DataFrame:
    """The last action for each (collection, slug): what membership a log of edits leaves."""
    return ops.groupBy("collection", "slug").agg(F.max_by("action", F.struct("at", "seq")).alias("action"), F.max("at").alias("at"))


def edited(published: DataFrame, ops: DataFrame) -> DataFrame:
    """Published members with the edits on top: removed ones gone, added ones in front, the newest first."""
    last = effective(ops)
    kept = published.join(last.where("action = 'remove'"), ["collection", "slug"], "left_anti").select("collection", "slug", F.lit(0).alias("front"), F.lit(None).cast("timestamp").alias("at"), "pos")
    new = last.where("action = 'add'").join(published, ["collection", "slug"], "left_anti").select("collection", "slug", F.lit(1).alias("front"), "at", F.lit(None).cast("int").alias("pos"))
    both = kept.unionByName(new)
    nth = F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("front"), F.desc("at"), "pos", "slug"))
    return both.select("collection", "slug", nth.alias("pos"))


def renamed(items: DataFrame, source: str, target: str) -> DataFrame:
    """A member under its new name, in its place, unless the new name is a member already."""
    has = F.max((F.col("slug") == target).cast("int")).over(Window.partitionBy("collection"))
    return items.withColumn("_has", has).where((F.col("slug") != source) | (F.col("_has") == 0)).withColumn("slug", F.when(F.col("slug") == source, target).otherwise(F.col("slug"))).drop("_has")


def dangling(items: DataFrame, docs: DataFrame) -> DataFrame:
    return items.join(docs.select("slug"), "slug", "left_anti")


def repeated(items: DataFrame) -> DataFrame:
    return items.groupBy("collection", "slug").agg(F.count("*").alias("n")).where("n > 1")


def refreshed(collections: DataFrame, ops: DataFrame) -> DataFrame:
    """Collections (id, updated_at) with the later of their time and that of their latest edit: a late edit never sets it back."""
    latest = ops.groupBy(F.col("collection").alias("id")).agg(F.max("at").alias("_latest"))
    return collections.join(latest, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_latest")).drop("_latest")


def payload(slug: Column, member: Column, names: Column, version: int = 1) -> Column:
    """What a page tells a script of its collections, as JSON that an HTML script element may hold."""
    return F.replace(F.to_json(F.struct(F.lit(version).alias("v"), slug.alias("slug"), member.alias("member"), names.alias("collections"))), F.lit("<"), F.lit(r"\u003c"))


def read_payload(text: Column) -> Column:
    return F.from_json(text, "v int, slug string, member boolean, collections array<string>")
