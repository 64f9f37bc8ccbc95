"""Shards of near-equal bytes by a k-d tree over document metadata, with built-in functions only.

Each node of the tree is cut along its widest dimension (size, language, source or place in the table, each scaled
to its range in the whole table; names lie in alphabetical order, by the letters after those that all share) at the
weighted median, until a leaf is a shard. A median is found by histograms:
all nodes of a level count bytes in BINS bins of their key range at once, keep the bin that holds the median, and
look into it again until it holds next to nothing. The driver sees one row a node and pass. Equal texts are one unit
of weight and stay in one shard, but for those that outweigh WHOLE_GROUP of a shard; their rows are units each.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import saved

SHARDS = 16
BINS = 4096
#: Share of a shard's bytes up to which equal texts stay together; at most SHARDS / WHOLE_GROUP texts exceed it.
WHOLE_GROUP = 0.05
#: A median's bin may hold this share of a shard.
CLOSE = 0.0005
#: Bytes of a name that place it.
NAME_BYTES = 6
#: Rows of a shard that are numbered in one go.
SLOT_ROWS = 50_000
DIMENSIONS = ("by_size", "by_lang", "by_source", "by_place")
_TOP = 1 << 30


def _scaled(value: Column, low: float, high: float) -> Column:
    return F.least(F.floor((value - F.lit(low)) / F.lit(max(high - low, 1e-9)) * F.lit(_TOP)), F.lit(_TOP)).cast("long")


def _metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return saved(docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    ))


def _log2(x: float) -> float:
    return math.log2(max(x, 1.0))


def _units(rows: DataFrame) -> DataFrame:
    """A row for each unit: weight, a tie-breaker, and a 62-bit key in each dimension."""
    ends = rows.agg(*[F.coalesce(f(c), F.lit(0)).cast("double") for c in ("size", "doc_id") for f in (F.min, F.max)]).first()
    kept = rows.groupBy("unit").agg(F.sum("size").alias("weight"), F.min("size").alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("doc_id"))
    names = rows.agg(*[f(c) for c in ("lang", "source") for f in (F.min, F.max)]).first()

    def name(c: str, low: str | None, high: str | None) -> Column:
        """By the NAME_BYTES that follow what all names begin with, scaled between the first name and the last."""
        ends_ = [(x or "").encode() for x in (low, high)]
        common = next((i for i, (a, b) in enumerate(zip(*ends_)) if a != b), min(map(len, ends_)))
        number = lambda x: float(int.from_bytes(x[common : common + NAME_BYTES].ljust(NAME_BYTES, b"\0"), "big"))
        own = F.rpad(F.hex(F.substring(F.col(c).cast("binary"), common + 1, NAME_BYTES)), 2 * NAME_BYTES, "0")
        return _scaled(F.conv(own, 16, 10).cast("double"), *map(number, ends_))

    places = {
        "by_size": _scaled(F.log2(F.col("size").cast("double")), *map(_log2, ends[:2])),
        "by_lang": name("lang", *names[:2]),
        "by_source": name("source", *names[2:]),
        "by_place": _scaled(F.coalesce(F.col("doc_id").cast("double"), F.lit(ends[2])), ends[2], ends[3]),
    }
    tie = F.col("unit").bitwiseAND(F.lit((1 << 31) - 1))
    return kept.select("unit", "weight", *[(F.shiftleft(place, 31) + tie).alias(c) for c, place in places.items()])


class _Tree:
    """Cuts so far. A node is a range of shards (first, stop); its rows are those that the cuts above send to it."""

    def __init__(self, shards: int):
        self.open = [(0, shards)] if shards > 1 else []
        self.cuts: dict[tuple[int, int], tuple[str, int, int]] = {}
        self.shards = shards

    def node(self, first: int = 0, stop: int | None = None) -> Column:
        """The first shard of the node that a row is in."""
        stop = self.shards if stop is None else stop
        if (first, stop) not in self.cuts:
            return F.lit(first)
        dimension, key, middle = self.cuts[first, stop]
        return F.when(F.col(dimension) <= F.lit(key), self.node(first, middle)).otherwise(self.node(middle, stop))

    def chosen(self, values: dict[int, object], otherwise: object) -> Column:
        """A value for each open node, as a column."""
        out = F.lit(otherwise)
        for first, value in values.items():
            out = F.when(F.col("node") == F.lit(first), value).otherwise(out)
        return out


def _medians(units: DataFrame, tree: _Tree, target: float) -> None:
    """Cut every open node."""
    at = units.withColumn("node", tree.node())
    ends = at.groupBy("node").agg(F.sum("weight").alias("weight"), *[f(c).alias(f"{k}_{c}") for c in DIMENSIONS for k, f in (("min", F.min), ("max", F.max))]).collect()
    seen, dims, low, width, below, aims = {r.node: r for r in ends}, {}, {}, {}, {}, {}
    for first, stop in tree.open:
        if first in seen:
            r = seen[first]
            dims[first] = max(DIMENSIONS, key=lambda c: (r[f"max_{c}"] >> 31) - (r[f"min_{c}"] >> 31))
            low[first], below[first] = r[f"min_{dims[first]}"], 0
            width[first] = max(1, -(-(r[f"max_{dims[first]}"] - low[first] + 1) // BINS))
            aims[first] = r.weight * ((stop - first) // 2) / (stop - first)
    todo, cut = set(dims), {}
    while todo:
        key = tree.chosen({n: F.col(dims[n]) for n in todo}, None)
        place = F.floor((F.col("key") - tree.chosen({n: low[n] for n in todo}, None)) / tree.chosen({n: width[n] for n in todo}, None)).cast("long")
        binned = at.withColumn("key", key).withColumn("bin", place).where(F.col("bin").between(0, BINS - 1)).groupBy("node", "bin").agg(F.sum("weight").alias("weight"))
        so_far = F.sum("weight").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + tree.chosen({n: below[n] for n in todo}, None)
        over = binned.withColumn("so_far", so_far).where(F.col("so_far") >= tree.chosen({n: aims[n] for n in todo}, None))
        for r in over.groupBy("node").agg(F.min_by(F.struct("bin", "weight", "so_far"), "bin").alias("b")).collect():
            n, b = r.node, r.b
            before = b.so_far - b.weight
            low[n] += b.bin * width[n]
            if width[n] == 1 or b.weight <= CLOSE * target:
                near = b.so_far - aims[n] <= aims[n] - before
                cut[n] = low[n] + width[n] - 1 if near else low[n] - 1
                todo.discard(n)
            else:
                below[n], width[n] = before, max(1, -(-width[n] // BINS))
    grown = []
    for first, stop in tree.open:
        middle = first + (stop - first) // 2
        tree.cuts[first, stop] = (dims.get(first, DIMENSIONS[0]), cut.get(first, 0), middle)
        grown += [x for x in ((first, middle), (middle, stop)) if x[1] - x[0] > 1]
    tree.open = grown


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """A row per document with its shard, by the law `bytes`, and its slot, gapless from 0 in each shard.

    A null text weighs one byte like an empty one; null lang and source count as ''; a null doc_id lies where the
    least does. Repeated rows are equal texts. grown_shard is null: only the law `key` has it. An empty table gives no
    rows; of a very long text only its length and hashes travel. Columns besides doc_id, text, lang and source aren't read.
    """
    rows = _metadata(docs)
    target = (rows.agg(F.sum("size")).first()[0] or 0) / n
    same = ["text_hash", "text_crc32", "size"]
    heavy = rows.groupBy(*same).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > WHOLE_GROUP * target).select(*same, F.lit(True).alias("heavy"))
    unit = F.when(F.col("heavy"), F.xxhash64("text_hash", "row")).otherwise(F.xxhash64(*same))
    rows = rows.join(F.broadcast(heavy), same, "left").withColumn("unit", unit).drop("heavy")
    units = saved(_units(rows))
    tree = _Tree(n)
    while tree.open:
        _medians(units, tree, target)
    placed = saved(rows.join(units.select("unit", tree.node().alias("shard")), "unit").select("doc_id", "size", "text_crc32", "shard", "row"))

    buckets = max(64, -(-placed.count() // (n * SLOT_ROWS)))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
