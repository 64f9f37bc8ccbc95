"""Incremental batches: what is pending, what fits a budget, packs of blocks, runs of failures, caches."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(docs: DataFrame, done: DataFrame, key: str = "slug") -> DataFrame:
    return docs.join(done.select(key), key, "left_anti")


def within_budget(docs: DataFrame, cost: str, order: list, group: str, budget: float, bucket: Column | None = None) -> DataFrame:
    """Documents of each group in order until their cost would exceed the budget.

    bucket never falls along the order: costs are summed up by bucket first, so a group that a third of all documents
    have is a task for each bucket. Without one, a group is one task.
    """
    step = docs.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    sums = step.groupBy(group, "_bucket").agg(F.sum(cost).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col(group).alias("_group"), F.col("_bucket").alias("_of"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.sum(cost).over(Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = step.withColumn("_inside", inside).join(starts, F.col(group).eqNullSafe(F.col("_group")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    so_far = F.col("_before") + F.col("_inside")
    return placed.withColumn("so_far", so_far).withColumn("fits", so_far <= budget).drop("_bucket", "_group", "_of", "_before", "_inside")


def packed(blocks: DataFrame, key: str, limit: int) -> DataFrame:
    """Blocks (key, pos, size) with the number of their batch: a new one where the next block would not fit.

    Blocks come to a task sorted by document and place, and are folded as they pass; no document is held.
    """
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, held = object(), 0, 0
        for batch in batches:
            numbers = []
            for at, size in zip(batch[key].to_pylist(), batch["size"].to_pylist()):
                if at != own:
                    own, number, held = at, 0, 0
                elif held + size > limit and held:
                    number, held = number + 1, 0
                held += size
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "batch"])

    rows = blocks.select(F.col(key).cast("long"), F.col("pos").cast("long"), F.col("size").cast("long"))
    return rows.repartition(key).sortWithinPartitions(key, "pos").mapInArrow(fold, f"{key} long, pos long, size long, batch long")


def failure_runs(events: DataFrame, group: str, order: list, failed: Column, trip: int = 3) -> DataFrame:
    """Runs of failures in a row by group; a run of `trip` opens the breaker."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = events.withColumn("failed", failed).withColumn("run", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("failed").groupBy(group, "run").agg(F.count("*").alias("length"))
    return runs.groupBy(group).agg(F.max("length").alias("longest"), F.sum((F.col("length") >= trip).cast("long")).alias("trips"))


def cached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """What was asked, by its destination-free key first and its exact text second; null where neither is known."""
    by_key = cache.groupBy("key").agg(F.min("value").alias("by_key"))
    by_text = cache.groupBy("text_hash").agg(F.min("value").alias("by_text"))
    return asked.join(by_key, "key", "left").join(by_text, "text_hash", "left").withColumn("value", F.coalesce("by_key", "by_text")).drop("by_key", "by_text")


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whether two versions of a document have as many blocks, of equal types in order."""
    left = a.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]).alias("left"))
    right = b.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]).alias("right"))
    return left.join(right, key, "left").select(key, F.coalesce(F.col("left") == F.col("right"), F.lit(False)).alias("aligned"))


def checkpoint_rows(files: DataFrame, version: int, target: str, model: str, stamp: str | None = None) -> DataFrame:
    """key and value of the blocks in checkpoint files (slug, text: JSON) whose header is as wanted; others count as absent.

    A file with a value that is no text is left out whole.
    """
    said = F.from_json("text", "version int, target string, model string, stamp string, blocks map<string,string>")
    kinds = F.from_json("text", "blocks map<string,variant>")["blocks"]
    rows = files.select("slug", said.alias("c"), kinds.alias("kinds"))
    as_wanted = (F.col("c.version") == version) & (F.col("c.target") == target) & (F.col("c.model") == model) & F.col("c.stamp").eqNullSafe(F.lit(stamp))
    texts = F.forall(F.map_values("kinds"), lambda v: F.schema_of_variant(v) == "STRING")
    return rows.where(as_wanted & texts).select("slug", F.explode("c.blocks").alias("key", "value"))
