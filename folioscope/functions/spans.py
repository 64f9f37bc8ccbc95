"""Where a pattern matches, in code points, and rewrites by such spans."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches, none empty."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(found, lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), v.alias("value")))
    start = F.expr("named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,end:int,value:string>>))")

    def add(done: Column, x: Column) -> Column:
        begin = done["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(lengths, start, add, lambda done: done["out"])


def inside(position: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= position) & (position < s["end"]))
