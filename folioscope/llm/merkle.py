"""A Merkle manifest of a dataset: a tree for each language, a tree over their roots, and a proof for every document.

Leaves are numbered in order. A level divides the numbers by the fanout, collects each parent's children, sorted, and
hashes them. A round takes STRIDE levels at once: it groups fanout ** STRIDE neighbours, and folds the levels between
inside the group, so a tree of n leaves takes log(n) / STRIDE shuffles of geometrically shrinking tables instead of
log(n). On the way back, joins hand each block of nodes its parent's path to the root, which its children append to
their own siblings: all joins together move about 1 + 1/63 times the leaves. No join is on the language itself.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved
from folioscope.llm.numbering import divided, numbered

FANOUT, STRIDE = 2, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A level of a proof: the digests left and right of the node in its run, each joined.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex of the SHA-256 of the inputs, joined; digests go in as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """- for null, else the UTF-8 length in bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(field, fields))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf has with the siblings of a proof."""
    return F.aggregate(proof, start, lambda node, level: digest(level["left"], node, level["right"]))


def proof_digest(proof: Column) -> Column:
    """H of a proof's siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), ""))


def _levels(digests: Column, steps: Column, fanout: int, stride: int) -> Column:
    """The digests, and the level above, and so on, steps times."""

    def above(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), "")))

    climbs = F.filter(F.sequence(F.lit(1), F.lit(stride)), lambda t: t <= steps)
    return F.aggregate(climbs, F.array(digests), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _blocks(nodes: DataFrame, fanout: int, stride: int, row: Sequence[str]) -> DataFrame:
    """Nodes (tree, idx, digest, m: how many the tree has on this level, row) by blocks of fanout ** stride neighbours."""
    steps = F.size(F.filter(F.array(*[F.lit(fanout**t).cast("long") for t in range(stride)]), lambda p: p < F.col("m")))
    children = F.array_sort(F.collect_list(F.struct("idx", "digest", *row)), lambda a, b: F.when(a["idx"] < b["idx"], -1).otherwise(1))
    grouped = nodes.groupBy("tree", divided("idx", fanout**stride).alias("block")).agg(F.min("m").alias("m"), children.alias("children"))
    return grouped.withColumn("levels", _levels(F.transform("children", lambda c: c["digest"]), steps, fanout, stride))


def _climbed(nodes: DataFrame, fanout: int, stride: int, row: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and the top of each tree (tree, digest)."""
    width, rounds = fanout**stride, []
    most = nodes.agg(F.max("m")).first()[0] or 1
    while True:
        blocks = saved(_blocks(nodes, fanout, stride, row))
        rounds.append(blocks)
        top = F.element_at(F.element_at("levels", -1), 1)
        nodes = blocks.select("tree", F.col("block").alias("idx"), top.alias("digest"), F.expr(f"(m + {width - 1}) div {width}L").alias("m"))
        row, most = (), -(-most // width)
        if most <= 1:
            return rounds, nodes.select("tree", "digest")


def _own_path(child: Column, fanout: int, stride: int) -> Column:
    """A child's siblings on the levels of its block."""
    place = child["idx"] - F.col("block") * (fanout**stride)
    spans = F.array(*[F.lit(fanout**t).cast("long") for t in range(stride)])

    def siblings(t: Column) -> Column:
        nodes, own = F.element_at("levels", t + 1), F.floor(place / F.element_at(spans, t + 1)).cast("int")
        start = own - own % fanout
        return F.struct(
            F.array_join(F.slice(nodes, start + 1, own - start), "").alias("left"),
            F.array_join(F.slice(nodes, own + 2, start + (fanout - 1) - own), "").alias("right"),
        )

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(stride - 1)), lambda t: t < F.size("levels") - 1), siblings)


def _descended(rounds: list[DataFrame], tops: DataFrame, fanout: int, stride: int) -> DataFrame:
    """Every node of the lowest level (tree, idx, digest, row), with its path to the top and what tops have as up.

    tops: (tree, path, up), path being what follows a tree's own top.
    """
    above = tops.withColumn("idx", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        met = blocks.withColumn("idx", F.col("block")).join(above, ["tree", "idx"]).drop("idx")
        full = F.transform("children", lambda c: F.struct(c.alias("node"), F.concat(_own_path(c, fanout, stride), F.col("path")).alias("path")))
        above = met.select("tree", "up", F.explode(full).alias("c")).select("tree", "up", "c.path", "c.node.*")
    return above


def manifest(docs: DataFrame, by: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, keep: Mapping[str, Column] | None = None, fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """A row per document: key, leaf, subroot (of its tree), root, proof (its siblings up to the root), and columns to keep.

    Documents of a tree (equal in by; null is a tree of its own and comes first) ascend by key, null keys first, then
    by leaf; repeated rows are leaves of their own. A lone leaf is its subroot, a lone subroot the root. Nulls are
    fields like any other, and differ from empty texts. A text is hashed in place and never moved. An empty table gives
    no rows. Columns besides fields, by and key aren't read unless keep's expressions name them.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), F.struct(F.col(key).alias("key"), *[c.alias(n) for n, c in (keep or {}).items()]).alias("row"))
    ordered = numbered(saved(leaves), "tree", ["key", "digest"]).withColumnRenamed("size", "m")
    rounds, tops = _climbed(ordered, fanout, stride, ("row",))
    named = tops.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest", F.struct(F.col("tree").alias("name")).alias("row"))
    over, root = _climbed(numbered(named, "tree", ["name"]).withColumnRenamed("size", "m"), fanout, stride, ("row",))
    none = F.array().cast(PATH)
    subroots = _descended(over, root.select("tree", none.alias("path"), F.struct(F.col("digest").alias("root")).alias("up")), fanout, stride)
    starts = subroots.select(F.col("row.name").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("up.root").alias("root")).alias("up"))
    found = _descended(rounds, starts, fanout, stride)
    return found.select(F.col("row.key").alias(key), F.col("digest").alias("leaf"), "up.subroot", "up.root", F.col("path").alias("proof"), *[F.col(f"row.{n}") for n in keep or {}])

