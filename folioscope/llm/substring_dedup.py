"""Exact removal of passages that occur earlier in the corpus, by seeds that are extended.

A window is WINDOW consecutive words. Documents are joined on winnowed anchors: hashes of ANCHOR words of which each
run of WINDOW - ANCHOR + 1 keeps the least, so equal windows keep an equal anchor at an equal place. Only anchors
that occur twice are seeds. From a seed the match is extended both ways to every window around it; windows whose 128
bits occur earlier elsewhere are matches (extension goes by listing the windows that a seed serves, each of which is
compared whole, and not by growing pairs, so copies meet once each), and their unions are the maximal repeats of at least WINDOW words.
Both joins send a hash once for each chunk of documents (see exchange), so no group of copies is ever paired up.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from folioscope.llm.common import covered, distinct_sorted, hashes, owners, split_words, texts_of, window_hashes, word_codes
from folioscope.llm.exchange import ANSWERED, ASKED, Plan, asked, flags_back, flags_of, in_chunks, met, shared, shortened, unpacked_rows

WINDOW, ANCHOR = 20, 10
LAST = np.iinfo(np.int64).max


class Words:
    """The words of a chunk's documents, and hashes of their runs."""

    def __init__(self, table: pa.Table, window: int):
        table = table.sort_by("doc_id") if table.num_rows > 1 else table
        self.doc_ids = table["doc_id"].combine_chunks()
        self.bounds, self.words = split_words(texts_of(table))
        codes, distinct = word_codes(self.words)
        self.values = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        self.owner = owners(self.bounds)
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        self.starts = np.flatnonzero(np.arange(len(codes)) + window <= ends)

    def anchors(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchors that windows keep (of equal hashes the last), each once, and which of them each window keeps."""
        runs = window_hashes(self.values, anchor)
        at, least = self.starts.copy(), runs[self.starts]
        for step in range(1, window - anchor + 1):
            there = runs[self.starts + step]
            lower = np.flatnonzero(there <= least)
            least[lower] = there[lower]
            at[lower] = self.starts[lower] + step
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        return least[new], np.cumsum(new) - 1


def _anchors(plan: Plan, window: int, anchor: int):
    def run(rows: pa.Table) -> pa.Table:
        kept, _ = Words(unpacked_rows(rows), window).anchors(window, anchor)
        return asked(rows["chunk"][0].as_py(), plan.part_bits, [shortened(distinct_sorted(kept), plan.short_bits)[0]], plan.short_bits)

    return run


def _alike(first: np.ndarray, second: np.ndarray, docs: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order with equal windows together, the earliest first, and where each kind begins."""
    by = np.argsort(first, kind="stable")
    fresh = np.ones(len(by), bool)
    fresh[1:] = first[by[1:]] != first[by[:-1]]
    near = np.flatnonzero(~fresh)
    a, b = by[near - 1], by[near]
    if (second[a] != second[b]).any() or ((docs[a] > docs[b]) | ((docs[a] == docs[b]) & (offset[a] > offset[b]))).any():
        by = np.lexsort((offset, docs, second, first))
        fresh[1:] = (first[by[1:]] != first[by[:-1]]) | (second[by[1:]] != second[by[:-1]])
    return by, fresh


def _windows(words: Words, answers: pa.Table, plan: Plan, window: int, anchor: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Windows around a seed by where they start, and the distinct ones: two hashes, first document and start."""
    kept, own = words.anchors(window, anchor)
    keys, inverse, times = np.unique(kept, return_inverse=True, return_counts=True)
    short, one = shortened(keys, plan.short_bits)
    # An anchor that two places of one chunk have is a seed too.
    seed = flags_of(answers, short, plan.part_bits, plan.short_bits)[one] | (times > 1)
    starts = words.starts[seed[inverse][own]] if len(own) else words.starts
    first = window_hashes(words.values, window)[starts] if len(starts) else np.zeros(0, np.uint64)
    second = window_hashes(words.values, window, 0xC2B2AE3D27D4EB4F)[starts] if len(starts) else first
    docs = pc.fill_null(words.doc_ids, int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)[words.owner[starts]]
    offset = starts - words.bounds[words.owner[starts]]
    by, fresh = _alike(first, second, docs, offset)
    return starts, [first, second, docs, offset, by, fresh]


def _extended(plan: Plan, window: int, anchor: int):
    def run(_, rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, (first, second, docs, offset, by, fresh) = _windows(Words(unpacked_rows(rows), window), answers, plan, window, anchor)
        lead = by[fresh]
        return asked(rows["chunk"][0].as_py(), plan.part_bits, [first[lead], second[lead], docs[lead], offset[lead]])

    return run


def _later(table: pa.Table) -> pa.Table:
    """Which windows another chunk has at an earlier document or start."""
    chunks, counts, (first, second, docs, offset) = met(table, [np.uint64, np.uint64, np.int64, np.int64])
    by, fresh = _alike(first, second, docs, offset)
    lead = by[np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))]
    later = np.zeros(len(by), bool)
    later[by] = (docs[by] != docs[lead]) | (offset[by] != offset[lead])
    return flags_back(table["part"][0].as_py(), chunks, counts, later)


def _cut(plan: Plan, window: int, anchor: int):
    def run(_, rows: pa.Table, answers: pa.Table) -> pa.Table:
        seeds, later = (answers.filter(pc.equal(answers["step"], k)) for k in range(2))
        words = Words(unpacked_rows(rows), window)
        starts, (first, _, docs, offset, by, fresh) = _windows(words, seeds, plan, window, anchor)
        group = np.cumsum(fresh) - 1
        lead = by[fresh]
        elsewhere = flags_of(later, first[lead], plan.part_bits)
        repeat = np.zeros(len(by), bool)
        repeat[by] = elsewhere[group] | (docs[by] != docs[lead][group]) | (offset[by] != offset[lead][group])
        gone = covered(starts[repeat], np.full(repeat.sum(), window), len(words.words))
        kept = pa.array(~gone)
        left = np.concatenate(([0], np.cumsum(~gone)))[words.bounds]
        lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.words.filter(kept).cast(pa.string()))
        turn = np.diff(np.concatenate(([0], gone.view(np.int8), [0]))) != 0
        turn[words.bounds] = True
        edge = np.flatnonzero(turn)
        spans: list[list[dict]] = [[] for _ in range(len(words.doc_ids))]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if a < b and gone[a]:
                doc = int(words.owner[a])
                spans[doc].append({"start": a - int(words.bounds[doc]), "end": b - int(words.bounds[doc])})
        n = np.diff(words.bounds)
        return pa.table({
            "doc_id": words.doc_ids.cast(pa.int64()),
            "n_words": pa.array(n.astype(np.int64)),
            "n_removed": pa.array((n - np.diff(left)).astype(np.int64)),
            "kept_text": pc.binary_join(lists, " "),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        })

    return run


CUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """A row per document: words kept, joined by a space, and the removed spans of words.

    A word goes if a window over it has the same words as one that starts earlier (smaller doc_id, or the same
    document and an earlier start), judged on the input. A null doc_id comes after all others; rows with equal
    doc_id count as one document, so repeated rows are not earlier than each other. A null or empty text keeps
    nothing and loses nothing; a very long one is a chunk of its own. An empty table gives no rows. Columns besides doc_id and text aren't read.
    """
    texts, plan = in_chunks(docs, "doc_id", "text")
    grouped = texts.groupBy("chunk")
    asking = grouped.applyInArrow(_anchors(plan, window, anchor), ASKED)
    seeds = plan.by(plan.by(asking, "part").groupBy("part").applyInArrow(shared, ANSWERED), "chunk")
    sent = grouped.cogroup(seeds.groupBy("chunk")).applyInArrow(_extended(plan, window, anchor), ASKED)
    later = plan.by(sent, "part").groupBy("part").applyInArrow(_later, ANSWERED)
    both = seeds.selectExpr("chunk", "part", "body", "0 AS step").union(later.selectExpr("chunk", "part", "body", "1 AS step"))
    return grouped.cogroup(plan.by(both, "chunk").groupBy("chunk")).applyInArrow(_cut(plan, window, anchor), CUT)
