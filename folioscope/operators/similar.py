"""Near agreement of short texts, and threads as text."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: share of the larger set of words that two texts must have in common.
AGREEMENT = 0.8


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def agreement(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def flattened(turns: DataFrame) -> DataFrame:
    """A conversation's turns as one Markdown text in order."""
    line = F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.regexp_replace("text", "\n", " "))
    rows = turns.select("conv_id", F.struct("turn", line.alias("line")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "\n\n").alias("thread"), F.count("*").alias("turns"))


#: Fixed value: clips that a user's history keeps.
HISTORY_CAP = 500


def latest(rows: DataFrame, key: str, at: str, tie: str, k: int) -> DataFrame:
    """The k newest rows of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k)
