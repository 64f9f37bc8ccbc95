"""Benchmark decontamination with suffix arrays over the training documents.

The documents are taken in shards (a chunk of whole documents inside a task). Each shard gets a suffix array over
its words, compared up to a window; every suffix of every benchmark item is binary-searched in it (suffixes with one
window together), which gives the locations, and at each location the longest verbatim match is searched among the
block's suffixes that share the window. Words that no benchmark item has end a suffix, so the array only holds
suffixes that could match. Nothing is shuffled: a document's verdict comes from its own shard.

The benchmark is the stated query set, of any size. It is read in blocks of about BLOCK_BYTES of text (a longer item
is a block of its own); the driver holds one block at a time. Each block is one pass over the documents; between
passes they are written to the shared folder with what was found so far.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioscope.llm.common import covered, mapped_bytes, mixed, owners, saved, short_batches, split_words, text_chunks, texts_of

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
#: Windows that are searched at once.
_ROWS = 1 << 18
#: A-Z in lower case; other ASCII characters than letters and digits separate words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def folded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    return split_words(mapped_bytes(texts, _WORD_BYTES))


class SuffixArray:
    """Places of a chunk's words in order of the words that follow, compared up to depth words; a 0 ends each text."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, depth: int, reach: int):
        n = len(codes) + len(bounds) - 1
        place = np.arange(len(codes)) + owners(bounds)
        self.words = np.zeros(n + reach + 1, np.int64)
        self.words[place] = codes
        self.doc_start = bounds[:-1] + np.arange(len(bounds) - 1)
        gaps = np.where(self.words == 0, np.arange(len(self.words)), len(self.words))
        self.run = run = np.minimum.accumulate(gaps[::-1])[::-1] - np.arange(len(self.words))
        order = np.flatnonzero(self.words)
        order = order[np.argsort(self.words[order], kind="stable")]
        rank = np.zeros(len(self.words), np.int64)
        fresh = self._refine(order, np.arange(len(order)), rank, self.words[order])
        slots, h = self._tied(fresh, np.arange(len(order))), 1
        while len(slots) and h < depth:
            at = order[slots]
            further = np.where(run[at] > h, rank[np.minimum(at + h, len(rank) - 1)], 0)
            by = np.argsort(rank[at] * (len(order) + 2) + further, kind="stable")
            order[slots] = at = at[by]
            fresh = self._refine(at, slots, rank, rank[at] * (len(order) + 2) + further[by])
            slots, h = self._tied(fresh, slots), 2 * h
        self.order = order

    @staticmethod
    def _refine(at: np.ndarray, slots: np.ndarray, rank: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks, from 1, are the slot where a group of equal prefixes begins."""
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(fresh, slots + 1, 0)) if len(at) else 0
        return fresh

    @staticmethod
    def _tied(fresh: np.ndarray, slots: np.ndarray) -> np.ndarray:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        return slots[tied]

    def rows(self, places: np.ndarray, width: int) -> np.ndarray:
        """The next width words from each place, 0 after the end of its text."""
        found = self.words[places[:, None] + np.arange(width)]
        found[np.cumsum(found == 0, axis=1) > 0] = 0
        return found

    def bound(self, asked: np.ndarray, widths: np.ndarray, after: bool) -> np.ndarray:
        """By binary search, where suffixes that begin with each row's first words begin (after: end)."""
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.order))
        columns = np.arange(asked.shape[1])
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            found = np.where(columns < widths[live, None], self.rows(self.order[middle], asked.shape[1]), 0)
            differ = found != asked[live]
            first = differ.argmax(axis=1)
            any_differ = differ[np.arange(len(live)), first]
            less = found[np.arange(len(live)), first] < asked[live, first]
            right = np.where(any_differ, less, after)
            low[live] = np.where(right, middle + 1, low[live])
            high[live] = np.where(right, high[live], middle)
            live = live[low[live] < high[live]]
        return low

    def prefix_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums over which hashes of runs of words are compared, and the powers of their base."""
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(self.words), _BASE))), dtype=np.uint64)
            return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(self.words.astype(np.uint64)) * powers[:-1], dtype=np.uint64))), powers


_BASE = np.uint64(0x9E3779B97F4A7C15)


class TestSet:
    """A block's items: the suffix array of those suffixes that hold a window, and its groups of one window.

    windows are the groups' rows of word codes from 1, then 0; group g has the suffixes order[edges[g]:edges[g + 1]].
    """

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        bounds, words = folded_words(pa.array([t or "" for _, t in items], pa.large_string()))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        sizes = np.diff(bounds)
        self.array = SuffixArray(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, bounds, int(sizes.max(initial=1)), window)
        self.names = ["" if name is None else str(name) for name, _ in items]
        item = np.searchsorted(self.array.doc_start, self.array.order, side="right") - 1
        word = self.array.order - self.array.doc_start[item]
        full = word <= np.maximum(sizes[item] - window, 0)
        self.order, self.item, self.word = self.array.order[full], item[full], word[full]
        rows = self.array.rows(self.order, window)
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        self.windows, self.edges = rows[fresh], np.append(np.flatnonzero(fresh), len(rows))
        self.widths = (self.windows > 0).sum(axis=1)
        self.sums = self.array.prefix_sums()

    def occurrences(self, shard: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Group and place of each occurrence of a window."""
        groups, places = [], []
        for at in range(0, len(self.windows), _ROWS):
            rows, widths = self.windows[at : at + _ROWS], self.widths[at : at + _ROWS]
            low, high = (shard.bound(rows, widths, after) for after in (False, True))
            counts = high - low
            groups.append(np.repeat(np.arange(at, at + len(rows)), counts))
            slot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            places.append(shard.order[slot])
        return (np.concatenate(groups), np.concatenate(places)) if groups else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _common(self, shard: SuffixArray, sums: np.ndarray, powers: np.ndarray, places: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        """How many words agree from each place and each suffix on: by binary search on hashes of runs."""
        own, own_powers = self.sums
        at = self.order[suffixes]
        low = np.zeros(len(places), np.int64)
        high = np.minimum(shard.run[places], self.array.run[at])
        with np.errstate(over="ignore"):
            while (low < high).any():
                middle = (low + high + 1) // 2
                left = (sums[places + middle] - sums[places]) * own_powers[at]
                right = (own[at + middle] - own[at]) * powers[places]
                same = left == right
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def longest(self, shard: SuffixArray, groups: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest match at each place with a suffix of the group, and that suffix: one of the two beside its rank."""
        if not len(places):
            return places, places
        sums, powers = shard.prefix_sums()
        low, high = self.edges[groups].copy(), self.edges[groups + 1].copy()
        begin, end = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            n = self._common(shard, sums, powers, places[live], middle)
            less = self.array.words[self.order[middle] + n] < shard.words[places[live] + n]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
            live = live[low[live] < high[live]]
        before, after = np.maximum(low - 1, begin), np.minimum(low, end - 1)
        n_before, n_after = (self._common(shard, sums, powers, places, x) for x in (before, after))
        return np.maximum(n_before, n_after), np.where(n_before >= n_after, before, after)


_FOUND = "match_items array<string>, match_item_words array<int>, match_words array<int>, match_lengths array<int>, hits array<struct<start:int,end:int>>, items array<string>, n_words long"


def _lists(docs: np.ndarray, n_docs: int, values: pa.Array) -> pa.Array:
    """A list for each document of the values at its number, in their order."""
    bounds = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=n_docs))))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values.take(pa.array(np.argsort(docs, kind="stable"))))


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The document's number for each element of the lists, and the elements."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()


def _shard(table: pa.Table, tests: TestSet, window: int) -> tuple[np.ndarray, SuffixArray]:
    bounds, words = folded_words(texts_of(table))
    known = pc.fill_null(pc.index_in(words, value_set=tests.vocabulary), -1).to_numpy(zero_copy_only=False)
    return bounds, SuffixArray(known.astype(np.int64) + 1, bounds, window, window)


def found_in(table: pa.Table, tests: TestSet, window: int, before: pa.Table | None) -> dict[str, pa.Array]:
    """What the block finds in each document, with what earlier blocks did."""
    bounds, shard = _shard(table, tests, window)
    n_docs = table.num_rows
    group, place = tests.occurrences(shard)
    length, suffix = tests.longest(shard, group, place)
    doc = np.searchsorted(shard.doc_start, place, side="right") - 1
    starts = bounds[doc] + place - shard.doc_start[doc]

    lengths = tests.widths[group]
    if before is not None:
        owner, old = _flat(before["hits"].combine_chunks())
        ends = [pc.struct_field(old, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end")]
        starts_all, lengths = np.concatenate((starts, bounds[owner] + ends[0])), np.concatenate((lengths, ends[1] - ends[0]))
    else:
        starts_all = starts
    hit = covered(starts_all, lengths, int(bounds[-1]))
    turn = np.diff(np.concatenate(([0], hit.view(np.int8), [0]))) != 0
    turn[bounds] = True
    edge = np.flatnonzero(turn)
    full = np.flatnonzero(hit[edge[:-1]]) if len(edge) > 1 else np.zeros(0, np.int64)
    owner = np.searchsorted(bounds, edge[full], side="right") - 1
    spans = {k: pa.array((e - bounds[owner]).astype(np.int32)) for k, e in (("start", edge[full]), ("end", edge[full + 1] if len(full) else edge[:0]))}

    by = np.lexsort((-length, starts))
    best = by[np.flatnonzero(np.diff(starts[by], prepend=-1))]
    item_docs, items = _items(tests, doc, group)
    added = {
        "match_items": (doc[best], pa.array([tests.names[i] for i in tests.item[suffix[best]].tolist()], pa.string())),
        "match_item_words": (doc[best], pa.array(tests.word[suffix[best]].astype(np.int32))),
        "match_words": (doc[best], pa.array((starts - bounds[doc])[best].astype(np.int32))),
        "match_lengths": (doc[best], pa.array(length[best].astype(np.int32))),
        "items": (item_docs, items),
    }
    if before is not None:
        for name, (docs, values) in added.items():
            old_docs, old = _flat(before[name].combine_chunks())
            added[name] = (np.concatenate((old_docs, docs)), pa.concat_arrays([old.cast(values.type), values]))
    lists = {name: _lists(docs, n_docs, values) for name, (docs, values) in added.items()}
    return lists | {"n_words": pa.array(np.diff(bounds).astype(np.int64)), "hits": _lists(owner, n_docs, pa.StructArray.from_arrays(list(spans.values()), names=list(spans)))}


def _items(tests: TestSet, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The items that have a window in each document, each once; one document is marked at a time."""
    pairs = np.unique(doc * (len(tests.windows) + 1) + group)
    docs, groups = np.divmod(pairs, len(tests.windows) + 1)
    marked, owner, found = np.zeros(len(tests.names), bool), [], []
    edges = np.append(np.flatnonzero(np.diff(docs, prepend=-1)), len(docs))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for g in groups[a:b].tolist():
            marked[tests.item[tests.edges[g] : tests.edges[g + 1]]] = True
        own = np.flatnonzero(marked)
        marked[own] = False
        owner += [int(docs[a])] * len(own)
        found += own.tolist()
    return np.array(owner, np.int64), pa.array([tests.names[i] for i in found], pa.string())


def _pass(block, window: int, schema: pa.Schema, first: bool):
    """A pass of one block over whole documents; later passes add to what earlier ones found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSet(block.value, window)
        for table in text_chunks(batches, limit=SHARD_BYTES):
            found = found_in(table, tests, window, None if first else table)
            columns = [found[f.name] if f.name in found else table[f.name].combine_chunks() for f in schema]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], names=schema.names).to_batches()

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[object, str | None]], bool]]:
    """The items in blocks, and whether a block is the last; one at least."""
    held, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        length = len((text or "").encode())
        if held and size + length > BLOCK_BYTES:
            yield held, False
            held, size = [], 0
        held.append((item, text))
        size += length
    yield held, True


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with n_words, hits (spans of words inside a window), items (names of those found) and match lists.

    These have an entry for each word of the document where a window of an item begins (window words, or the whole of
    a shorter item): the longest verbatim match from there, and the item and its word where it begins. Null or
    empty texts and items have no words and no matches. A null item_id counts as ''. Long texts and items take memory
    in proportion. Repeated rows each get their result. An empty benchmark finds nothing. The documents' other
    columns, whatever their names, aren't read.
    """
    out = docs.select("doc_id", "text")
    found = StructType.fromDDL(_FOUND)
    first = True
    for block, last in _blocks(benchmark):
        schema = StructType([f for f in out.schema.fields if f.name not in found.fieldNames() and (f.name != "text" or not last)] + found.fields)
        out = short_batches(out).mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(block), window, to_arrow_schema(schema), first), schema)
        out, first = out if last else saved(out), False
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: words, words inside an occurrence of a window, items found, and the verdict."""
    n_hit = F.aggregate("hits", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_sort(F.array_distinct("items"))
    return matches(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.coalesce(F.array_max("match_lengths"), F.lit(0)).cast("long").alias("longest_match"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence, with their own columns; one pass for each block of the benchmark."""
    out = docs
    for block, last in _blocks(benchmark):
        out = short_batches(out).mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(block), window), docs.schema)
        out = out if last else saved(out)
    return out


def _filter(block, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSet(block.value, window)
        for table in text_chunks(batches, limit=SHARD_BYTES):
            _, shard = _shard(table, tests, window)
            clean = np.ones(table.num_rows, bool)
            clean[np.searchsorted(shard.doc_start, tests.occurrences(shard)[1], side="right") - 1] = False
            yield from table.filter(pa.array(clean)).to_batches()

    return run
