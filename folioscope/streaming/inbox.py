"""The inbox: small files with a link each become pending documents, once."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import urls

#: Fixed value: larger notes aren't read.
LARGEST_NOTE = 64 << 10


def first_link(text: Column) -> Column:
    """The first http(s) URL in a text, without the punctuation of the prose around it; brackets of its own stay."""
    found = F.regexp_extract(text, r"https?://[^\s<>\"']+", 0)
    count = lambda t, mark: F.length(t) - F.length(F.replace(t, F.lit(mark)))
    bare = lambda t: F.regexp_replace(t, r"[.,;:!?。，]+$", "")

    def trimmed(t: Column, _: Column) -> Column:
        return F.when(t.endswith(")") & (count(t, ")") > count(t, "(")), bare(F.left(t, F.length(t) - 1))).otherwise(t)

    return F.nullif(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), count(found, ")"))), bare(found), trimmed), F.lit(""))


def drained(notes: DataFrame, articles: DataFrame) -> DataFrame:
    """Notes (path, text) as new documents (slug, url), one for each page that no article is of."""
    sized = notes.where(F.octet_length("text") <= LARGEST_NOTE)
    linked = sized.select(first_link(F.col("text")).alias("url")).where("url IS NOT NULL").select(urls.slug(F.col("url")).alias("slug"), urls.normalize(F.col("url")).alias("url"))
    return linked.where("slug IS NOT NULL").dropDuplicates(["slug"]).join(articles.select("slug"), "slug", "left_anti")


def start(spark: SparkSession, inbox: str, articles: str, checkpoint: str, most_files: int = 1000, remove: bool = False):
    """A stream that appends each batch's new documents to the articles' table, most_files notes at a time.

    remove deletes notes after the batch that read them is done. A batch that runs again finds its documents there.
    """
    def append(batch: DataFrame, _: int) -> None:
        known = spark.read.schema("slug string, url string").parquet(articles)
        drained(batch, known).write.mode("append").parquet(articles)

    notes = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most_files).option("cleanSource", "delete" if remove else "off").load(inbox).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return notes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
