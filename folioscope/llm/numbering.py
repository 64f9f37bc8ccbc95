"""Row numbers within groups of any size: ranges are counted first, so no task sorts a whole group."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import saved

#: Rows of a range, about; there are never fewer ranges than shuffle partitions.
RANGE_ROWS = 1 << 20


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows, with idx, each one's place in its group by order, from 0, and size, its group's rows; nulls come first.

    Rows that are equal in group and order are told apart by where they were read, so that a group of equal rows is cut
    into ranges like any other. A group's null is a group. Names that begin with _ are taken.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    by = [group, *order, "_read"]
    sorted_rows = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    placed = saved(sorted_rows.drop("_read").withColumns({"_range": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}))
    runs = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("_n").over(Window.partitionBy(group))
    shifts = runs.select(F.col(group).alias("_group"), F.col("_range").alias("_run"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), size.alias("size"))
    own = placed[group].eqNullSafe(shifts["_group"]) & (placed["_range"] == shifts["_run"])
    return placed.join(shifts, own).withColumn("idx", F.col("_pos") + F.col("_shift")).drop("_group", "_range", "_run", "_pos", "_shift")


def divided(column: str, by: int) -> Column:
    """Whole quotients, without going through floating point."""
    return F.expr(f"`{column}` div {by}L")
