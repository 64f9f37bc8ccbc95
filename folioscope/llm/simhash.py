"""Near duplicates by SimHash: pigeonhole blocks find close fingerprints, a star algorithm joins them to components.

Fingerprints that differ in at most RADIUS of 64 bits agree on at least B - RADIUS of B blocks. Each distinct
fingerprint is sent once for each choice of so many blocks; those that agree on a choice meet, and the Hamming
distance decides. B grows with the number of distinct fingerprints so that chance meetings stay rare; every B finds
the same links. Equal fingerprints are one class from the start, and where many meet, only a spanning tree of the
links leaves the task, so copies are never expanded into pairs. A class is named by its least doc_id, so the least
name of a component is the answer. Joins on a star's centre are inner joins, which adaptive execution splits.
"""

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import lower_ascii, saved, short_batches, split_words, text_chunks, texts_of

SHINGLE, SEED, RADIUS = 4, 42, 4
BITS = 64
#: Names a class without any doc_id; it comes after all others.
_LAST = (1 << 63) - 1


def shingle_hashes(texts: pa.Array, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of size words (of all words, if fewer), and where each text's begin."""
    bounds, words = split_words(lower_ascii(texts))
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    line = b" ".join(words.cast(pa.large_binary()).to_pylist())
    n = np.diff(bounds)
    counts = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    edges = np.concatenate(([0], np.cumsum(counts)))
    first = np.arange(edges[-1]) - np.repeat(edges[:-1], counts) + np.repeat(bounds[:-1], counts)
    last = np.minimum(first + size, np.repeat(bounds[1:], counts)) - 1
    digest = xxhash.xxh64_intdigest
    begin = (ends - lengths)[first].tolist() if len(first) else []
    stop = ends[last].tolist() if len(first) else []
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(begin, stop)), np.uint64, len(begin)), edges


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """A bit is 1 if over half of the text's shingles have it; without words, 0."""
    values, edges = shingle_hashes(texts)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, edges[full], axis=0, dtype=np.int32)
        major = 2 * counts > np.diff(edges)[full, None]
        out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long, with other columns of longs."""
    longs = ("doc_id", *also)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            fp = fingerprints_of(texts_of(table)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().cast(pa.int64()) for c in longs), pa.array(fp)], [*longs, "fp"])

    return short_batches(docs).select(*longs, "text").mapInArrow(run, ", ".join(f"{c} long" for c in (*longs, "fp")))


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the choices of blocks, as signed 64-bit numbers: enough bits for n fingerprints to meet rarely."""
    blocks = radius + 1
    while BITS * (blocks - radius) / blocks < np.log2(max(n, 2)) + 2 and blocks < 2 * radius + 4:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(whole, blocks - radius)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


#: So many fingerprints of one key are searched at once; more are split by blocks of the bits in which they differ.
_FEW = 1024


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, by place, that join the fingerprints within radius to the same components as all of them would."""
    differ = np.bitwise_or.reduce(fps ^ fps[0]).view(np.uint64) if len(fps) else np.uint64(0)
    bits = [k for k in range(BITS) if int(differ) >> k & 1]
    if len(fps) <= _FEW or len(bits) <= radius + 1:
        return _searched(fps, radius)
    out = []
    for k in range(radius + 1):
        mask = sum(1 << bit for bit in bits[k * len(bits) // (radius + 1) : (k + 1) * len(bits) // (radius + 1)])
        keys = fps.view(np.uint64) & np.uint64(mask)
        by = np.argsort(keys, kind="stable")
        starts = np.append(np.flatnonzero(np.concatenate(([True], keys[by[1:]] != keys[by[:-1]]))), len(by))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b > a + 1:
                own = by[a:b]
                found = spanning_links(fps[own], radius) if b - a < 0.75 * len(fps) else _searched(fps[own], radius)
                out += [(own[x], own[y]) for x, y in found]
    return out


def _searched(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first search over what is left; only what lies as far from the root as a neighbour can is looked at."""
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        far = np.bitwise_count((fps[left] ^ fps[root]).view(np.uint64)).astype(np.int64)
        by = np.argsort(far, kind="stable")
        left, far = left[by], far[by]
        frontier = [(root, 0)]
        while frontier and len(left):
            at, distance = frontier.pop()
            a, b = np.searchsorted(far, (distance - radius, distance + radius + 1))
            near = a + np.flatnonzero(np.bitwise_count((fps[left[a:b]] ^ fps[at]).view(np.uint64)) <= radius)
            if len(near):
                out.append((np.full(len(near), root), left[near]))
                frontier += zip(left[near].tolist(), far[near].tolist())
                left, far = np.delete(left, near), np.delete(far, near)
    return out


def _linked(radius: int):
    """Links among the classes of each key (rows of choice, key, fp and name); a key's rows come one after the other."""

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = np.ascontiguousarray(rows[:, 2])
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))) if len(rows) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(rows)))
        two = starts[sizes == 2]
        near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius
        found = [(two[near], two[near] + 1)]
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found += [(a + x, a + y) for x, y in spanning_links(fps[a : a + n], radius)]
        a, b = (np.concatenate([f[k] for f in found]) for k in range(2))
        if len(a):
            swap = (rows[a, 3] > rows[b, 3]) | ((rows[a, 3] == rows[b, 3]) & (rows[a, 2] > rows[b, 2]))
            ends = [rows[np.where(swap, x, y)] for x, y in ((b, a), (a, b))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, k])) for e in ends for k in (3, 2)], ["a_name", "a_fp", "b_name", "b_fp"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = np.zeros((0, 4), np.int64), []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= max(1 << 16, len(rows)):
                rows, held = _joined(rows, held), []
                whole = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
                cut = int(whole[-1]) + 1 if len(whole) else 0
                yield from links(rows[:cut])
                rows = rows[cut:]
        yield from links(_joined(rows, held))

    return run


def _joined(rows: np.ndarray, held: list[pa.RecordBatch]) -> np.ndarray:
    if not held:
        return rows
    table = pa.Table.from_batches(held)
    return np.concatenate([rows, np.stack([table[k].to_numpy().astype(np.int64) for k in ("choice", "key", "fp", "name")], 1)])


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a < b that join all classes (distinct fp, and name) within radius to the same components; a and b are (name, fp)."""
    masks = block_masks(classes.count(), radius)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    met = classes.select("fp", "name", keys.alias("k")).select("k.choice", "k.key", "fp", "name")
    met = met.repartition("choice", "key").sortWithinPartitions("choice", "key")
    found = met.mapInArrow(_linked(radius), "a_name long, a_fp long, b_name long, b_fp long")
    return found.select(*[F.struct(F.col(f"{k}_name").alias("name"), F.col(f"{k}_fp").alias("fp")).alias(k) for k in "ab"]).distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node and root (its component's least node), for nodes with a link, by large and small stars in turn."""

    def star(pairs: DataFrame) -> DataFrame:
        return pairs.where("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()

    def with_least(out: DataFrame) -> DataFrame:
        return out.join(out.groupBy("u").agg(F.min("v").alias("least")), "u").withColumn("m", F.least("u", "least"))

    edges, before = saved(edges.select("a", "b").distinct()), None
    for _ in range(most_rounds):
        both = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
        large = star(with_least(both).where("v > u"))
        least = with_least(large.selectExpr("b AS u", "a AS v"))
        edges = saved(star(least.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.selectExpr("b AS node", "a AS root")
        before = now
    raise RuntimeError(f"no end after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row per document: doc_id, fingerprint (hex) and component_id, the least doc_id reachable over links.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. A null doc_id keeps its
    row and never names a component unless all of its component's are null. Repeated rows each get their row.
    A very long text is worked on alone. An empty table gives no rows. Columns besides doc_id and text aren't read.
    """
    fps = saved(fingerprints(docs))
    of_class = _rooted(fps, radius).select("fp", F.nullif("root.name", F.lit(_LAST)).alias("component_id"))
    return fps.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(fps: DataFrame, radius: int) -> DataFrame:
    """Each distinct fp with root (name, fp), the class that names its component."""
    classes = saved(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_LAST)).alias("name")))
    rooted = components(links(classes, radius)).select(F.col("node.fp").alias("fp"), "root")
    return classes.join(rooted, "fp", "left").select("fp", F.coalesce("root", F.struct("name", "fp")).alias("root"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with its own columns: of the class that names it, a row with the least doc_id.

    Other texts under a repeated doc_id stand for their own components. Repeated rows leave one. Documents without a
    doc_id can't be named, so all of them stay. Null and empty texts are one class. An empty table stays empty. Columns
    may have any names.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("at"))
    fps = saved(fingerprints(keyed, "at"))
    kept = fps.join(_rooted(fps, radius), "fp").where("doc_id = root.name AND fp = root.fp").groupBy("doc_id", "fp").agg(F.min("at").alias("at"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("at"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    named = rows.join(kept, ["doc_id", "at"], "left_semi").dropDuplicates(["doc_id", "at"])
    return named.union(rows.where("doc_id IS NULL")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
