"""Work by a model that is passed in as a function: translation of blocks, with masks, a cache and checks.

chat takes a list of masked texts and returns as many replies; it runs inside tasks, a batch at a time.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import repair

#: A reply's length as a share of what was asked.
LEAST_REPLY, MOST_REPLY = 0.85, 1.3
VERBATIM = ("code", "math", "html", "thematicBreak")


def translated(blocks: DataFrame, cache: DataFrame, chat: Callable[[list[str]], list[str]]) -> DataFrame:
    """Blocks (doc_id, pos, type, text) with `translation`; verbatim blocks and failed replies keep their text.

    Equal texts are asked once. cache has (key, value) by the SHA-256 of the masked text.
    """
    masks = blocks.withColumn("m", repair.masked(F.col("text"))).select("doc_id", "pos", "type", "text", F.col("m.text").alias("masked"), F.col("m.spans").alias("spans"), F.sha2("m.text", 256).alias("key"))
    wanted = masks.where(~F.col("type").isin(*VERBATIM)).select("key", "masked").dropDuplicates(["key"])
    misses = wanted.join(cache.select("key"), "key", "left_anti")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "value": chat(list(part["masked"]))})

    known = cache.select("key", "value").dropDuplicates(["key"]).unionByName(misses.mapInPandas(ask, "key string, value string"))
    joined = masks.join(known, "key", "left")
    restored = repair.unmasked(F.col("value"), F.col("spans"))
    return joined.select("doc_id", "pos", "type", "text", F.when(F.col("type").isin(*VERBATIM), F.col("text")).otherwise(F.coalesce(restored, F.col("text"))).alias("translation"), (~F.col("type").isin(*VERBATIM) & restored.isNull()).alias("failed"))


def keeps_length(asked, reply):
    """Whether a restored text has about as many characters as what was sent."""
    return F.length(reply).between(F.floor(F.length(asked) * LEAST_REPLY), F.ceil(F.length(asked) * MOST_REPLY))


def better(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where there are some, else the old ones: a run that fails loses nothing."""
    renamed = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return old.join(renamed, key, "left").select(key, *[F.coalesce(F.nullif(F.trim(f"new_{c}"), F.lit("")), F.col(c)).alias(c) for c in columns])
