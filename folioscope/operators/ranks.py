"""Places in an order, within groups of any size: ranges are cut first, so neither a group nor the whole is one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which all rows are cut, about.
CUTS = 200
#: Halvings that find a place among the cuts. Fewer than 2 ** 16 are drawn: their number varies about CUTS with the hash.
_STEPS = 16


def _below(cuts: str, at: Column) -> Column:
    """How many of the sorted cuts are below a value: steps of falling powers of two, each taken if the cut there is below."""
    steps = F.expr(f"filter(array({', '.join(str(1 << k) for k in reversed(range(_STEPS)))}), s -> s <= size({cuts}))")
    taken = lambda n, s: n + F.when(F.get(cuts, n + s - 1) < at, s).otherwise(0)
    return F.aggregate(steps, F.lit(0), taken)


def ranged(rows: DataFrame, group: str | None, at: Column) -> DataFrame:
    """The rows with _at, their place in the order, and _range, a number that grows with group and place.

    Cut points are about CUTS places, drawn by their hash: a row of one array of bounded size, which is the only thing
    that every task gets (the cross join is with that row). A row finds its range by halving, in _STEPS comparisons.
    """
    whole = F.struct(F.col(group).alias("g"), at.alias("at")) if group else F.struct(at.alias("at"))
    keyed = rows.withColumn("_at", whole)
    every = max(1, rows.count() // CUTS)
    drawn = keyed.where(F.pmod(F.xxhash64("_at"), F.lit(every)) == 0).select("_at")
    cuts = F.broadcast(drawn.distinct().agg(F.array_sort(F.collect_list("_at")).alias("_cuts")))
    return keyed.crossJoin(cuts).withColumn("_range", _below("_cuts", F.col("_at"))).drop("_cuts")


def numbered(rows: DataFrame, group: str | None, at: Column, name: str = "position") -> DataFrame:
    """The rows with their place in their group, from 0, by at (a value or a struct of values; nulls first, ties by whatever it ends in)."""
    placed = ranged(rows, group, at)
    groups = [group] if group else []
    sizes = placed.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(g).alias("_group") for g in groups], F.col("_range").alias("_run"), before.alias("_before"))
    own = placed["_range"] == F.col("_run")
    for g in groups:
        own = own & placed[g].eqNullSafe(F.col("_group"))
    nth = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy("_at")) - 1
    joined = placed.withColumn("_nth", nth).join(starts, own)
    return joined.withColumn(name, F.col("_before") + F.col("_nth")).drop("_at", "_range", "_nth", "_before", "_run", "_group")


def mates(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """on, nth, left, right: the n-th row of a key on one side beside the n-th on the other, first come first served.

    Each side has on and order, which no two rows of a key share. A row is used once; what one side has more of a key
    stays with null on the other side. A null key has no mate, but its rows stay.
    """
    a, b = (numbered(side.select(on, order), on, F.col(order), "nth").select(on, "nth", F.col(order).alias(name)) for side, name in ((left, "left"), (right, "right")))
    return a.join(b, [on, "nth"], "full").select(on, "nth", "left", "right")

