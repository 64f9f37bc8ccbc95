"""What a library is published as: redirect lines, feed items, a run's report, and a cache that keeps what is alive."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def redirect_lines(links: DataFrame) -> DataFrame:
    """A line for each given short id (id, slug), sorted when written."""
    return links.select("id", F.concat(F.lit("/s/"), "id", F.lit("/  /articles/"), "slug", F.lit("/  301")).alias("line"))


def escaped(text: Column) -> Column:
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def feed_items(docs: DataFrame) -> DataFrame:
    """Documents (slug, title, url, summary, excerpt) as XML items."""
    said = F.coalesce("summary", "excerpt", F.lit(""))
    item = F.concat(F.lit("<item><title>"), escaped(F.col("title")), F.lit("</title><link>"), escaped(F.col("url")), F.lit("</link><description>"), escaped(said), F.lit("</description></item>"))
    return docs.select("slug", item.alias("item"))


def run_report(outcomes: DataFrame, shown: int = 20) -> DataFrame:
    """Outcomes (slug, outcome) as lines of a report: how many of each, and the first slugs in order."""
    counted = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    first = outcomes.withColumn("nth", F.row_number().over(Window.partitionBy("outcome").orderBy("slug"))).where(F.col("nth") <= shown)
    named = first.groupBy("outcome").agg(F.array_join(F.array_sort(F.collect_list("slug")), ", ").alias("slugs"))
    return counted.join(named, "outcome").select("outcome", "n", F.concat(F.lit("- "), "outcome", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), "slugs", F.lit(")")).alias("line"))


def retained(cache: DataFrame, live: DataFrame, target: str, model: str) -> DataFrame:
    """Entries of a cache (key, value, target, model) made for the same target and model whose key is still asked for."""
    return cache.where((F.col("target") == target) & (F.col("model") == model)).join(live.select("key"), "key", "left_semi")
