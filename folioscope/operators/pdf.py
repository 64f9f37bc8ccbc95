"""Layout of printed pages from positioned runs of text: furniture, body size, monospaced fonts, gutters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of pages a running line stands on, lines looked at from each edge, a monospaced font's limits.
SHARE, EDGE_LINES = 0.6, 2
MONO_VARIATION, MONO_RUNS, MONO_DISTINCT = 0.02, 8, 4


def furniture(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """Lines (doc, page, nth, text) near an edge whose text, digits aside, stands on most pages of the document."""
    edge = Window.partitionBy("doc", "page")
    near = lines.withColumn("last", F.max("nth").over(edge)).where((F.col("nth") < EDGE_LINES) | (F.col("last") - F.col("nth") < EDGE_LINES))
    keyed = near.withColumn("key", F.trim(F.regexp_replace("text", r"\d+", "#")))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    found = keyed.groupBy("doc", "key").agg(F.count_distinct("page").alias("on_pages")).join(pages, "doc")
    return found.where((F.col("on_pages") >= share * F.col("pages")) & (F.col("pages") > 1))


def body_size(runs: DataFrame) -> DataFrame:
    """The font size of most characters of a document, by tenths of a point."""
    sums = runs.groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("characters"))
    return sums.groupBy("doc").agg(F.max_by("size", F.struct("characters", "size")).alias("body_size"))


def monospaced(runs: DataFrame) -> DataFrame:
    """Fonts whose advances hardly vary, over enough different runs."""
    advance = F.col("width") / F.length("text")
    return runs.where(F.length("text") > 0).groupBy("doc", "font").agg((F.stddev_pop(advance) / F.avg(advance)).alias("variation"), F.count("*").alias("n"), F.count_distinct("text").alias("kinds")).select(
        "doc", "font", ((F.col("variation") <= MONO_VARIATION) & (F.col("n") >= MONO_RUNS) & (F.col("kinds") >= MONO_DISTINCT)).alias("mono")
    )


def gutters(runs: DataFrame) -> DataFrame:
    """The widest gap between runs of a page along x."""
    w = Window.partitionBy("doc", "page").orderBy("x", "seq")
    reach = F.max(F.col("x") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("gap", F.col("x") - reach).groupBy("doc", "page").agg(F.max("gap").alias("gutter"))

#: Runs within so many points share a line; a line so much larger than the body is a heading.
SAME_LINE, HEADING = 2.0, 1.15


def text_lines(runs: DataFrame) -> DataFrame:
    """Lines of a page from its runs (doc, page, seq, text, size, y): runs at nearly one height, in order."""
    w = Window.partitionBy("doc", "page").orderBy("seq")
    new = F.when(F.abs(F.col("y") - F.lag("y").over(w)) <= SAME_LINE, 0).otherwise(1)
    numbered = runs.withColumn("_new", new).withColumn("line", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), " ")
    return numbered.groupBy("doc", "page", "line").agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"), F.max("size").alias("size"), F.max("y").alias("y"))


def to_markdown(runs: DataFrame) -> DataFrame:
    """A document's runs as Markdown: running lines left out, larger lines as headings, lists, paragraphs of near lines.

    Paragraphs part where the gap between lines is more than one and a half of the page's usual one.
    """
    lines = text_lines(runs).where("text <> ''")
    nth = F.row_number().over(Window.partitionBy("doc", "page").orderBy("line")) - 1
    key = F.trim(F.regexp_replace("text", r"\d+", "#"))
    running = furniture(lines.withColumn("nth", nth)).select("doc", "key")
    placed = lines.withColumn("nth", nth).withColumn("key", key).withColumn("last", F.max("nth").over(Window.partitionBy("doc", "page")))
    edge = (F.col("nth") < EDGE_LINES) | (F.col("last") - F.col("nth") < EDGE_LINES)
    kept = placed.join(running.withColumn("running", F.lit(True)), ["doc", "key"], "left").where(~(F.coalesce("running", F.lit(False)) & edge))
    sized = kept.join(body_size(runs), "doc")
    page = Window.partitionBy("doc", "page").orderBy("line")
    gap = F.abs(F.col("y") - F.lag("y").over(page))
    usual = F.percentile("gap", F.lit(0.5)).over(Window.partitionBy("doc", "page"))
    kind = F.when(F.col("size") >= F.col("body_size") * HEADING, "heading").when(F.col("text").rlike(r"^(?:[-•*]|\d{1,3}[.)])\s"), "item").otherwise("text")
    parted = sized.withColumn("gap", gap).withColumn("kind", kind).withColumn("usual", usual)
    whole = Window.partitionBy("doc").orderBy("page", "line")
    same = (F.col("kind") == F.lag("kind").over(whole)) & (F.col("kind") == "text") & (F.col("gap") <= F.col("usual") * 1.5)
    blocks = parted.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("block", F.sum("new").over(whole))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda r: r["text"]), " ")
    joined = blocks.groupBy("doc", "block").agg(F.first("kind").alias("kind"), text.alias("text"))
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), F.col("text"))).when(F.col("kind") == "item", F.concat(F.lit("- "), F.regexp_replace("text", r"^(?:[-•*]|\d{1,3}[.)])\s+", ""))).otherwise(F.col("text"))
    return joined.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", shown.alias("t")))), lambda b: b["t"]), "\n\n").alias("markdown"))


def distinct_sizes(sizes: Column, tolerance: float = 0.5) -> Column:
    """Sizes from the largest down, without those within tolerance of the one kept before."""
    start = F.expr("CAST(array() AS array<double>)")
    ordered = F.sort_array(F.transform(sizes, lambda s: s.cast("double")), asc=False)
    far = lambda kept, s: (F.size(kept) == 0) | (F.get(kept, F.size(kept) - 1) - s > tolerance)
    return F.aggregate(ordered, start, lambda kept, s: F.when(far(kept, s), F.concat(kept, F.array(s))).otherwise(kept))
