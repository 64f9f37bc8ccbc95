"""Threads of comments that state how deep they stand: who answers whom, and the thread as nested quotes."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARENTS = "thread long, pos long, depth long, parent long, level long"


def parents(comments: DataFrame) -> DataFrame:
    """thread, pos, depth, parent and level: the last comment above that is less deep, null at the top, and how many are above it.

    comments: thread, pos (its order, unique in a thread), depth. Depths may skip; null counts as 0. A thread's rows
    pass one task in order, which holds no more than the way from the top to the row, however long the thread is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, way = object(), []
        for batch in batches:
            rows = []
            for own, pos, depth in zip(*(batch[c].to_pylist() for c in ("thread", "pos", "depth"))):
                if own != thread:
                    thread, way = own, []
                while way and way[-1][1] >= depth:
                    way.pop()
                rows.append((own, pos, depth, way[-1][0] if way else None, len(way)))
                way.append((pos, depth))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["thread", "pos", "depth", "parent", "level"])

    rows = comments.select(F.col("thread").cast("long").alias("thread"), F.col("pos").cast("long").alias("pos"), F.coalesce(F.col("depth").cast("long"), F.lit(0)).alias("depth"))
    return rows.repartition("thread").sortWithinPartitions("thread", "pos").mapInArrow(run, PARENTS)


def quoted(text: Column, level: Column) -> Column:
    """The text with so many marks before each line; an empty line keeps bare ones, so that the quote goes on."""
    mark = F.repeat(F.lit("> "), level)
    lines = F.transform(F.split(text, "\n"), lambda line: F.when(line == "", F.rtrim(mark)).otherwise(F.concat(mark, line)))
    return F.array_join(lines, "\n")


def as_quotes(comments: DataFrame) -> DataFrame:
    """thread, pos, parent and block of comments (thread, pos, depth, author, text): each as a quote at its level; null texts are empty."""
    found = parents(comments).drop("depth")
    texts = comments.select(F.col("thread").cast("long").alias("thread"), F.col("pos").cast("long").alias("pos"), F.concat(F.lit("**"), F.coalesce("author", F.lit("?")), F.lit("**\n\n"), F.coalesce("text", F.lit(""))).alias("said"))
    return texts.join(found, ["thread", "pos"]).select("thread", "pos", "parent", quoted(F.col("said"), (F.col("level") + 1).cast("int")).alias("block"))
