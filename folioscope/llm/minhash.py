"""Near duplicates by MinHash: fast similarity sketches, banding, and a check of the full sets.

A sketch has SIZE coordinates. In round i every element of a set is hashed anew and falls into one bin; a bin keeps the
least (round, hash) that it ever gets, so a bin that an earlier round filled doesn't change. After SIZE rounds, round
SIZE + k puts every element into bin k, so each coordinate fills however small the set is; a set is done as soon as all
its bins are full, which takes a large one a single round. The share of equal coordinates estimates the similarity as
independent samples would, with the same tail bounds. BANDS bands of BAND coordinates bring together a pair of
similarity 0.85 with all but (1 - 0.85 ** 4) ** 32 = 6e-11 of the chances.

Equal sets are one class. In a bucket (the classes that share a band's key), classes aren't paired with each other: each
is compared with a pivot, of all classes in buckets of the bucket's classes the one that shares most, and links are
joined to components. Two classes x and y in different components have at most min(|x & p|, |y & p|) shingles in common
within the pivot p. If these are too few for a link, they share shingles that p lacks, at least as many as are missing:
so they meet again in buckets of p and one such shingle, of which a prefix is enough, as in prefix filtering. If they
could be enough, the pair is compared. In a bucket of p and a shingle the same goes on with a second pivot q and what
lies outside of p and q together, and so on; each round compares only with what earlier pivots lack. Near copies take few
rounds, and comparisons in proportion to their number. What is open after ROUNDS rounds is compared pair by pair across
components. Sets are hashes of 64 bits, taken again from the texts of the classes that share a bucket; links are decided
on whole sets.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hashes, lower_ascii, mixed, owners, saved, short_batches, split_words, text_chunks, texts_of, window_hashes, word_codes
from folioscope.llm.simhash import components

SHINGLE, SIZE, BAND = 5, 128, 4
BANDS = SIZE // BAND
#: Links have 100 * common >= PERCENT * together.
PERCENT = 85
#: Rounds of pivots; what is open then is compared pair by pair.
ROUNDS = 2
_EMPTY, _GOLDEN = np.uint64((1 << 64) - 1), np.uint64(0x9E3779B97F4A7C15)
#: Names a class without any doc_id; it comes after all others.
_LAST = (1 << 63) - 1


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text, in order, and where each text's begin; fewer words are one shingle."""
    bounds, words = split_words(lower_ascii(texts))
    codes, distinct = word_codes(words)
    values = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(bounds)
    long = np.flatnonzero(np.arange(len(values)) + size <= np.repeat(bounds[1:], n))
    found, owner = [window_hashes(values, size)[long] if len(long) else values[:0]], [owners(bounds)[long]]
    for width in range(1, size):
        short = np.flatnonzero(n == width)
        if len(short):
            found.append(mixed(window_hashes(values, width)[bounds[short]] + np.uint64(width)))
            owner.append(short)
    value, of = np.concatenate(found), np.concatenate(owner)
    by = np.lexsort((value, of))
    value, of = value[by], of[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(n)))))


def sketches(values: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A row of size coordinates for each set; those of an empty set stay unfilled."""
    n = len(bounds) - 1
    out = np.full(n * size, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bits = np.uint64((1 << 56) - 1)
    for i in range(2 * size):
        if not len(values):
            break
        with np.errstate(over="ignore"):
            h = mixed(values + np.uint64((i + 1) * int(_GOLDEN) % (1 << 64)))
        bins = ((h >> np.uint64(56)) * np.uint64(size) >> np.uint64(8)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, owner * size + bins, (np.uint64(i) << np.uint64(56)) | (h & bits))
        open_sets = (out.reshape(n, size) == _EMPTY).any(axis=1)
        left = open_sets[owner]
        values, owner = values[left], owner[left]
    return out.reshape(n, size)


def band_keys(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """A hash of each band of each sketch, that of its number in it."""
    with np.errstate(over="ignore"):
        parts = sketch.reshape(len(sketch), -1, band)
        out = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
        for k in range(band):
            out = mixed(out * _GOLDEN + parts[:, :, k])
    return out.view(np.int64)


def _fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set, whatever its order."""
    out = []
    for salt in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values + np.uint64(salt * int(_GOLDEN) % (1 << 64))), dtype=np.uint64)))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


SKETCHED = "doc_id long, at1 long, at2 long, n long, c1 long, c2 long, keys array<long>"


def _text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("at1"), F.xxhash64(F.lit(7), F.col("text")).alias("at2")]


def sketched(docs: DataFrame) -> DataFrame:
    """SKETCHED: each document's hashes of the text, size and two hashes of the set, and the keys of its bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            values, bounds = shingle_sets(texts_of(table))
            keys = band_keys(sketches(values, bounds))
            sizes = np.diff(bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(sizes > 0, keys.shape[1], 0)))).astype(np.int32)), pa.array(keys[sizes > 0].reshape(-1)))
            own = [table[c].combine_chunks().cast(pa.int64()) for c in ("doc_id", "at1", "at2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes), *map(pa.array, _fingerprints(values, bounds)), lists], [f.split(" ")[0] for f in SKETCHED.split(", ")])

    return short_batches(docs.select("doc_id", "text", *_text_hashes())).mapInArrow(run, SKETCHED)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, c1 and whole set (sorted hashes, as bytes) of classes (name, at1, at2, c1), from the text that names each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            values, bounds = shingle_sets(texts_of(table))
            raw, edges = values.tobytes(), (8 * bounds).tolist()
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().cast(pa.int64()) for c in ("name", "c1")), pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["name", "c1", "body"])

    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("name"), "text", *_text_hashes())
    texts = named.join(wanted, ["name", "at1", "at2"]).select("name", "c1", "text")
    return short_batches(texts).mapInArrow(run, "name long, c1 long, body binary").dropDuplicates(["name", "c1"])


COMPARED = "p_name long, p long, x_name long, x long, p_size long, x_size long, common long, added array<long>, wanted boolean"


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """COMPARED: of each pair (p, x) of classes the sizes, the common shingles, and, where wanted, what x has and p lacks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p_name, p, x_name, x, wanted, p_body, x_body in zip(*(batch[c].to_pylist() for c in ("p_name", "p", "x_name", "x", "wanted", "p_body", "x_body"))):
                ours, theirs = np.frombuffer(p_body, np.uint64), np.frombuffer(x_body, np.uint64)
                at = np.minimum(np.searchsorted(ours, theirs), len(ours) - 1)
                there = ours[at] == theirs
                rows.append((p_name, p, x_name, x, len(ours), len(theirs), int(there.sum()), theirs[~there].view(np.int64).tolist() if wanted else [], wanted))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split(" ")[0] for f in COMPARED.split(", ")])

    with_x = pairs.join(sets.select(F.col("c1").alias("x"), F.col("name").alias("x_name"), F.col("body").alias("x_body")), "x")
    with_p = with_x.join(sets.select(F.col("c1").alias("p"), F.col("name").alias("p_name"), F.col("body").alias("p_body")), "p")
    return short_batches(with_p).mapInArrow(run, COMPARED)


def _enough(one: str, other: str, percent: int) -> Column:
    """The least number of common shingles with which sets of two sizes are linked."""
    return F.expr(f"({percent} * ({one} + {other}) + {99 + percent}) div {100 + percent}")


def _edges(compared: DataFrame, percent: int) -> DataFrame:
    """Links as nodes a < b of (name, c1)."""
    p, x = (F.struct(F.col(f"{k}_name").alias("name"), F.col(k).alias("c1")) for k in "px")
    return compared.where(F.col("common") >= _enough("p_size", "x_size", percent)).select(F.least(p, x).alias("a"), F.greatest(p, x).alias("b"))


def _merged(rooted: DataFrame, edges: DataFrame) -> DataFrame:
    """rooted (node and root) with more links: components of the roots that these join, whose nodes follow.

    A node without a row in rooted is a root, its own.
    """
    of = rooted.select(F.col("node").alias("of"), "root")
    ends = edges
    for end in "ab":
        ends = ends.join(of, F.col(end) == F.col("of"), "left").withColumn(end, F.coalesce("root", end)).drop("of", "root")
    between = saved(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not between.limit(1).count():
        return rooted
    moved = components(between)
    to = moved.select(F.col("node").alias("of"), F.col("root").alias("to"))
    followed = rooted.join(to, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return saved(followed.union(moved.select("node", "root")))


def _open(met: DataFrame, labels: DataFrame) -> DataFrame:
    """chain, key, c1 and label of the buckets of three classes or more that lie in several components."""
    labelled = met.join(labels, "c1", "left").select("chain", "key", "c1", F.coalesce("label", "c1").alias("label"))
    wide = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 AND low <> high")
    return labelled.join(wide.select("key"), "key", "left_semi")


def _pivots(met: DataFrame) -> DataFrame:
    """key, n and p: with a bucket's pivot, the class that shares most of those in the buckets that its classes are in.

    So all buckets around one much copied text have it as their pivot, those too that it isn't in. A bucket of two has
    one of the two, since they need no other comparison. Buckets of other chains don't count.
    """
    hubs = met.join(met.groupBy("key").agg(F.count("*").alias("times")), "key").groupBy("chain", "c1").agg(F.sum("times").alias("shares"))
    by_key = met.join(hubs, ["chain", "c1"]).groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("shares", "c1")).alias("hub"))
    best = met.join(by_key, "key").groupBy("chain", "c1").agg(F.max("hub").alias("best"))
    near = met.join(best, ["chain", "c1"]).groupBy("key").agg(F.max("best").alias("best"))
    return by_key.join(near, "key").select("key", "n", F.when(F.col("n") > 2, F.col("best.c1")).otherwise(F.col("hub.c1")).alias("p"))


def _rooted(met: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """node and root of the classes that have links; met: key and c1 of classes that share a bucket.

    A chain names the pivots so far of a group of buckets (0: none); known has, for its classes x, how many shingles
    lie in one of these pivots (common), and those that lie in none (added).
    """
    wanted = classes.join(met.select("c1").distinct(), "c1", "left_semi").select("name", "at1", "at2", "c1")
    sets = saved(_sets(docs, wanted))
    met, known, more, compared, rooted = met.withColumn("chain", F.lit(0).cast("long")), None, None, None, None
    for turn in range(ROUNDS + 1):
        with_pivot = saved(met.join(_pivots(met), "key").withColumn("next", F.xxhash64("chain", "p")))
        pairs = with_pivot.where("p <> c1").groupBy("p", F.col("c1").alias("x")).agg((F.max("n") > 2).alias("wanted"))
        if turn:
            pairs = pairs.select("p", "x").union(more).distinct().join(compared.select("p", "x"), ["p", "x"], "left_anti").withColumn("wanted", F.lit(False))
        now = saved(_compared(pairs, sets))
        compared = now if compared is None else compared.union(now)
        rooted = components(_edges(now, percent)) if rooted is None else _merged(rooted, _edges(now, percent))
        labels = rooted.select(F.col("node.c1").alias("c1"), F.col("root.c1").alias("label"))
        open_met = saved(_open(with_pivot.select("chain", "key", "c1"), labels))
        if not open_met.limit(1).count():
            return rooted
        if turn == ROUNDS:
            a, b = (open_met.select("key", F.col("c1").alias(c), F.col("label").alias(f"{c}_label")) for c in ("p", "x"))
            rest = a.join(b, "key").where("p < x AND p_label <> x_label").select("p", "x").distinct().withColumn("wanted", F.lit(False))
            return _merged(rooted, _edges(saved(_compared(rest, sets)), percent))
        members = open_met.join(with_pivot.select("key", "p", "next").distinct(), "key").where("p <> c1").select("chain", "next", "p", F.col("c1").alias("x"), "label").distinct()
        known = saved(_beyond(members, known if turn else None, compared))
        met, more = saved(_meet_again(known, percent)), saved(_may_link(known, percent))


def _beyond(members: DataFrame, known: DataFrame | None, compared: DataFrame) -> DataFrame:
    """chain, x, label, x_size, common and added of classes, once their chain has one more pivot."""
    if known is None:
        found = members.join(compared, ["p", "x"])
        return found.select(F.col("next").alias("chain"), "x", "label", "x_size", "common", "added")
    own = members.join(known.drop("label"), ["chain", "x"])
    pivots = known.select("chain", F.col("x").alias("p"), F.col("added").alias("pivot"))
    both = own.join(pivots, ["chain", "p"])
    common = F.col("common") + F.size(F.array_intersect("added", "pivot"))
    return both.select(F.col("next").alias("chain"), "x", "label", "x_size", common.alias("common"), F.array_except("added", "pivot").alias("added"))


def _meet_again(known: DataFrame, percent: int) -> DataFrame:
    """chain, key and c1 of classes that share one of the first shingles that they have and their chain's pivots lack."""
    least = known.groupBy("chain").agg(F.min("x_size").alias("least"))
    need = F.greatest(_enough("x_size", "least", percent) - F.col("common"), F.lit(1))
    prefix = F.slice("added", F.lit(1), F.greatest(F.size("added") - need + 1, F.lit(0)).cast("int"))
    again = known.join(least, "chain").select("chain", "x", "label", F.explode(prefix).alias("shingle")).select("chain", F.xxhash64("chain", "shingle").alias("key"), F.col("x").alias("c1"), "label")
    shared = again.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return again.select("chain", "key", "c1").join(shared.select("key"), "key", "left_semi").distinct()


def _may_link(known: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, x) of classes in different components that may be linked by what they share within their chain's pivots."""
    least = known.groupBy("chain").agg(F.min("x_size").alias("least"))
    free = known.join(least, "chain").where(F.col("common") >= _enough("x_size", "least", percent)).select("chain", "x", "label", "x_size", "common")
    sizes = free.groupBy("chain", "label").agg(F.count("*").alias("n")).groupBy("chain").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    a, b = (free.select("chain", *[F.col(c).alias(f"{k}_{c}") for c in ("x", "label", "x_size", "common")]) for k in "ab")
    near = (F.least("a_common", "b_common") >= _enough("a_x_size", "b_x_size", percent)) & (F.col("a_label") != F.col("b_label"))
    # One of the two isn't in the chain's largest component; where neither is, each pair is taken once.
    once = (F.col("b_label") == F.col("most")) | (F.col("a_x") < F.col("b_x"))
    few = a.join(sizes, "chain").where("a_label <> most")
    return few.join(b, "chain").where(near & once).select(F.least("a_x", "b_x").alias("p"), F.greatest("a_x", "b_x").alias("x")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the least doc_id reachable over links), kept.

    Texts without words, null ones too, have an empty set and are linked with nothing, equal ones neither. A null
    doc_id keeps its row and never names a component unless all of its component's are null; it is kept then. Repeated
    rows each get their row, and each is kept if one is. A very long text is worked on alone. An empty table gives no
    rows. Columns besides doc_id and text aren't read.
    """
    sketch = saved(sketched(docs))
    own = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("name"), "at1", "at2")
    classes = saved(sketch.where("n > 0").groupBy("n", "c1", "c2").agg(F.min(own).alias("own"), F.first("keys").alias("keys")).select("n", "c1", "c2", "own.*", "keys"))
    keyed = classes.select(F.explode("keys").alias("key"), "c1")
    shared = keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    met = saved(keyed.join(shared, "key"))
    rooted = _rooted(met, docs, classes, percent).select(F.col("node.name").alias("name"), F.col("node.c1").alias("c1"), F.col("root.name").alias("root"))
    named = classes.join(rooted, ["name", "c1"], "left").select("n", "c1", "c2", F.nullif(F.coalesce("root", "name"), F.lit(_LAST)).alias("component_id"), F.lit(True).alias("found"))
    whole = sketch.join(named, ["n", "c1", "c2"], "left").withColumn("component_id", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
