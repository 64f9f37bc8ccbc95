"""Repair of documents and their translations as pairs: both change or neither, and what was paid for by block moves along."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import markdown, repair
from folioscope.operators import emphasis
from folioscope.sources import versions


def _repaired(rows: DataFrame, column: str) -> DataFrame:
    """key and the column's repaired text: prose first, emphasis beside CJK letters then."""
    prose = rows.select(F.col("slug"), repair.body(F.col(column)).alias("text"))
    keyed = prose.select(F.xxhash64("slug").alias("doc_id"), "slug", "text")
    again = emphasis.with_cjk_emphasis(keyed).withColumnRenamed("text", column)
    return keyed.select("doc_id", "slug").join(again, "doc_id").select("slug", F.col(column).alias(f"new_{column}"))


def repaired(pairs: DataFrame) -> DataFrame:
    """slug, body, translation, new_body, new_translation, fate and errors.

    pairs: slug (unique), body, translation (null: none). fate: unchanged; repaired; refused, where the two were aligned
    and wouldn't be any more, or weren't and stay apart: then both keep their text, and errors says why.
    """
    rows = pairs.select("slug", F.coalesce("body", F.lit("")).alias("body"), "translation")
    new = rows.join(_repaired(rows, "body"), "slug").join(_repaired(rows.where("translation IS NOT NULL"), "translation"), "slug", "left")
    errors = markdown.alignment_errors(markdown.blocks(F.col("new_body")), markdown.blocks(F.col("new_translation")))
    found = F.when(F.col("translation").isNotNull(), errors).otherwise(F.array().cast("array<string>"))
    changed = ~(F.col("body").eqNullSafe(F.col("new_body")) & F.col("translation").eqNullSafe(F.col("new_translation")))
    judged = new.withColumn("errors", F.when(changed, found).otherwise(F.array().cast("array<string>")))
    fate = F.when(~changed, "unchanged").when(F.size("errors") > 0, "refused").otherwise("repaired")
    kept = lambda c: F.when(F.col("fate") == "repaired", F.col(f"new_{c}")).otherwise(F.col(c)).alias(f"new_{c}")
    return judged.withColumn("fate", fate).select("slug", "body", "translation", kept("body"), kept("translation"), "fate", "errors")


def block_key(text: Column) -> Column:
    """What a block's translation is kept under."""
    return F.sha2(text.cast("binary"), 256)


def moved_keys(judged: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache (key, value) with entries of repaired blocks under the keys of what they are now.

    Blocks of a repaired pair correspond by place. A key that some document still has as it was stays beside the new
    one; of two entries for a key, the one that was there counts.
    """
    was, now = (F.transform(markdown.blocks(F.col(c)), lambda b: block_key(b["text"])) for c in ("body", "new_body"))
    spots = judged.where("fate = 'repaired'").select(was.alias("was"), now.alias("now")).where("size(was) = size(now)")
    moves = spots.select(F.explode(F.arrays_zip("was", "now")).alias("k")).select(F.col("k.was").alias("key"), F.col("k.now").alias("new_key")).where("key <> new_key").distinct()
    still = judged.select(F.explode(F.transform(markdown.blocks(F.col("new_body")), lambda b: block_key(b["text"]))).alias("key")).distinct()
    gone = moves.select("key").distinct().join(still, "key", "left_anti")
    added = cache.join(moves, "key").select(F.col("new_key").alias("key"), "value").join(cache.select("key"), "key", "left_anti")
    return cache.join(gone, "key", "left_anti").unionByName(added.groupBy("key").agg(F.min("value").alias("value")))


def repair_all(spark: SparkSession, root: str) -> DataFrame:
    """Repair the current version under root (tables documents, translations and cache): slug, fate and errors of each pair.

    All three tables are the next version, or, if nothing changes or a write fails, none is.
    """
    tables = versions.current(spark, root)
    docs, cache = tables["documents"], tables["cache"]
    judged = repaired(docs.select("slug", "body").join(tables["translations"].select("slug", F.col("body").alias("translation")), "slug", "left")).checkpoint()
    if judged.where("fate = 'repaired'").limit(1).count():
        new = judged.select("slug", "new_body", "new_translation")
        bodies = docs.drop("body").join(new.select("slug", F.col("new_body").alias("body")), "slug")
        texts = tables["translations"].drop("body").join(new.select("slug", F.col("new_translation").alias("body")), "slug")
        versions.commit(spark, root, {"documents": bodies, "translations": texts, "cache": moved_keys(judged, cache)})
    return judged.select("slug", "fate", "errors")
