"""Quality rules from repetition inside a document, found with suffix arrays.

Each task builds one suffix array over the words of a chunk of whole documents (documents never compare with each
other), takes the longest common prefixes of neighbouring suffixes, and forms their LCP intervals. An interval whose
suffixes don't all follow the same word is a maximal repeated substring. Its spans are unioned, and the covered share
of words and the longest repeat are limited. The union needs the deepest interval of each suffix only: what a
shallower one covers, or one that could grow to the left, a maximal repeat covers as well. No shuffle.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from folioscope.llm.common import covered, mixed, owners, short_batches, split_words, text_chunks, texts_of, word_codes

#: Words of common prefixes that are compared one by one; longer ones go by hashes of runs.
_PLAIN = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Production limits. A repeat counts from min_repeat words; a document fails over either limit or by the base rules."""

    min_words: int = 50
    window: int = 3
    max_window_percent: int = 50
    min_repeat: int = 8
    max_covered: float = 0.4
    max_longest: int = 200
    max_symbol_share: float = 0.05


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long, n_maximal_repeats long"


def suffix_array(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the LCP of each with the one before it (0 for the first); suffixes end with their text.

    Prefix doubling: suffixes ranked by their first h words are refined by the rank h words further on. Only
    suffixes that are still tied are sorted again.
    """
    n = len(codes)
    owner = owners(bounds)
    end = np.repeat(bounds[1:], np.diff(bounds))
    key = owner * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied, h = ~fresh, 1
    tied[:-1] |= ~fresh[1:]
    slots = np.flatnonzero(tied)
    del tied, key
    while len(slots):
        at = order[slots]
        further = np.where(at + h < end[at], rank[np.minimum(at + h, n)] + 1, 0)
        group = rank[at]
        by = np.argsort(group * (n + 2) + further, kind="stable")
        at, group, further = at[by], group[by], further[by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (further[1:] != further[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(~fresh)
    lcp[at] = common_prefixes(codes, end, order[at - 1], order[at])
    return order, lcp


def common_prefixes(codes: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from a and from b on, inside their text."""
    most = np.minimum(end[a] - a, end[b] - b)
    low, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(_PLAIN):
        live = live[most[live] > k]
        live = live[codes[a[live] + k] == codes[b[live] + k]]
        low[live] = k + 1
    if len(live):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), _BASE))), dtype=np.uint64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)))
            x, y, got, high = a[live], b[live], low[live], most[live]
            while (got < high).any():
                middle = (got + high + 1) // 2
                same = (sums[x + middle] - sums[x]) * powers[y] == (sums[y + middle] - sums[y]) * powers[x]
                got, high = np.where(same, middle, got), np.where(same, high, middle - 1)
        low[live] = got
    return low


def maximal_repeats(codes: np.ndarray, bounds: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The LCP intervals of at least `least` words that no word to the left extends: words, first and last slot."""
    first = np.zeros(len(codes), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    before = np.where(first, -1 - np.arange(len(codes)), np.roll(codes, 1))[order]
    change = np.cumsum(np.concatenate(([0], before[1:] != before[:-1])))
    deep = np.flatnonzero(lcp >= least)
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []

    def close(below: int, last: int) -> int:
        """Intervals deeper than below end at the slot last; where the one that goes on begins."""
        begin = last
        while stack and stack[-1][0] > below:
            depth, begin = stack.pop()
            if change[last] > change[begin]:
                found.append((depth, begin, last))
        return begin

    previous = -2
    for slot, depth in zip(deep.tolist(), lcp[deep].tolist()):
        if slot != previous + 1:
            close(0, previous)
        begin = close(depth, slot - 1)
        if not stack or stack[-1][0] < depth:
            stack.append((depth, begin))
        previous = slot
    close(0, previous)
    return found


def longest_repeats(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on occur again in its text: the depth of its suffix's deepest interval."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if len(order) else 0
    return out


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = owners(at - at[0])
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    codes, distinct = word_codes(lines)
    key = (owner * (len(distinct) + 1) + codes)[worded]
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(owner[worded][again], minlength=len(texts))[: len(texts)]


def symbols(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    table = np.zeros(256, bool)
    table[list(b"#*$%&|<>")] = True
    return per_text(table[data], offsets - offsets[0])


def measured(table: pa.Table, limits: Limits) -> pa.RecordBatch:
    texts = texts_of(table)
    bounds, words = split_words(texts)
    n_words = np.diff(bounds)
    codes, distinct = word_codes(words)
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    order, lcp = suffix_array(codes, bounds)
    far = longest_repeats(order, lcp)
    owner = owners(bounds)

    windows = np.flatnonzero(far >= limits.window)
    n_repeat = per_text(covered(windows, np.full(len(windows), limits.window), len(codes)), bounds)
    starts = np.flatnonzero(far >= limits.min_repeat)
    n_covered = per_text(covered(starts, far[starts], len(codes)), bounds)
    longest, n_maximal = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for depth, slot, _ in maximal_repeats(codes, bounds, order, lcp, limits.min_repeat):
        doc = owner[order[slot]]
        longest[doc] = max(longest[doc], depth)
        n_maximal[doc] += 1

    word_chars, n_symbols = per_text(chars[codes], bounds), symbols(texts)
    failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_window_percent * n_words)
    kept = ~failed & (n_covered <= limits.max_covered * n_words) & (longest <= limits.max_longest) & (n_symbols <= limits.max_symbol_share * word_chars)
    columns = [n_words, word_chars, n_symbols, repeated_lines(texts), n_repeat, failed, kept, n_covered, longest, n_maximal]
    arrays = [table["doc_id"].combine_chunks().cast(pa.int64())] + [pa.array(c if c.dtype == bool else c.astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])


def repetition(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document with its counts and the verdict.

    A null or empty text has no words and fails the base rules; a null doc_id stays null; equal rows each get a row;
    an empty table gives no rows; a very long text is worked on alone, in memory in proportion to it; columns besides doc_id and text aren't read, whatever their names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            yield measured(table, limits)

    return short_batches(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with their own columns; verdicts are made beside the rows, without a join."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            kept = measured(table.select(["doc_id", "text"]), limits)["kept"]
            yield from table.filter(kept).select(names).to_batches()

    return short_batches(docs).mapInArrow(run, docs.schema)
