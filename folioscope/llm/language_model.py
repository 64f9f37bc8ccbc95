"""Scores by an n-gram model as a weighted automaton with failure arcs.

Counts of all n-grams up to ORDER are taken over the whole training corpus (see exchange): a chunk of documents first
asks which of its n-grams other chunks may have, then sends those with its own training counts and gets the corpus
counts back; an n-gram of one chunk alone has that chunk's count. From them each chunk builds the part of the
automaton that its documents can reach: seen n-grams of fewer than ORDER words are states, a seen n-gram is an arc
to the state of its longest suffix, and a failure arc leads to the state one word shorter at the price of what
smoothing left. One traversal from left to right carries the state and adds up log10 probabilities.

Smoothing is Dirichlet's: P(w | h) = (c(hw) + PRIOR P(w | h')) / (c(h) + PRIOR), with h' one word shorter and
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). It needs nothing but counts and sums to one over the words and the unknown.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import distinct_sorted, hashes, lower_ascii, mixed, split_words, texts_of, word_codes
from folioscope.llm.exchange import ANSWERED, ASKED, Plan, answered, asked, flags_of, in_chunks, met, numbers_of, packed, shared, shortened, unpacked, unpacked_rows

ORDER, PRIOR = 3, 8.0
FOLDS, HELD_OUT = 5, 1
#: Bytes of text for each chunk: its automaton takes some 50 bytes for each.
CHUNK_TEXT = 4 << 20
#: Tokens that a lane of the traversal takes; lanes advance together.
LANE = 256
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Tokens:
    """A chunk's tokens, an end after each document's words, and a key for the n-gram that ends at each place.

    The lowest two bits of a key are n, so order is 3 at most; places that lack n - 1 words before them have key 0,
    which nothing asks for.
    """

    def __init__(self, table: pa.Table, order: int):
        bounds, words = split_words(lower_ascii(texts_of(table)))
        codes, distinct = word_codes(words)
        n_docs = len(bounds) - 1
        self.bounds = bounds + np.arange(n_docs + 1)
        ends = self.bounds[1:] - 1
        self.kinds = len(distinct) + 1
        self.codes = np.full(self.bounds[-1], len(distinct), np.int64)
        body = np.ones(len(self.codes), bool)
        body[ends] = False
        self.codes[body] = codes
        values = np.append(hashes(distinct), np.uint64(0x5851F42D4C957F2D))[self.codes]
        place = np.arange(len(self.codes)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        self.keys, run = [], mixed(values)
        for n in range(1, order + 1):
            if n > 1:
                with np.errstate(over="ignore"):
                    run = mixed(np.concatenate((run[:1], run[:-1])) * np.uint64(0x9E3779B97F4A7C15) + values)
            self.keys.append(np.where(place >= n - 1, (run & ~np.uint64(3)) | np.uint64(n), np.uint64(0)))

    def distinct(self) -> np.ndarray:
        found = distinct_sorted(np.concatenate(self.keys))
        return found[int(len(found) > 0 and found[0] == 0) :]

    def training_counts(self, distinct: np.ndarray, held_out: np.ndarray) -> np.ndarray:
        train = np.repeat(~held_out, np.diff(self.bounds))
        found, times = np.unique(np.concatenate([k[train] for k in self.keys]), return_counts=True)
        counts = np.zeros(len(distinct), np.int64)
        full = found != 0
        counts[np.searchsorted(distinct, found[full])] = times[full]
        return counts


def _held_out(table: pa.Table) -> np.ndarray:
    return table["held_out"].to_numpy().astype(bool)


def _first(plan: Plan, order: int):
    """A chunk's n-grams of two words and more, shortened."""

    def run(rows: pa.Table) -> pa.Table:
        distinct = Tokens(unpacked_rows(rows), order).distinct()
        return asked(rows["chunk"][0].as_py(), plan.part_bits, [shortened(_long(distinct), plan.short_bits)[0]], plan.short_bits)

    return run


def _long(distinct: np.ndarray) -> np.ndarray:
    return distinct[distinct & np.uint64(3) > 1]


def _elsewhere(distinct: np.ndarray, flags: pa.Table, plan: Plan) -> np.ndarray:
    """Which n-grams other chunks may have: all single words, and those whose short key another chunk sent."""
    out = distinct & np.uint64(3) == 1
    short, own = shortened(_long(distinct), plan.short_bits)
    out[~out] = flags_of(flags, short, plan.part_bits, plan.short_bits)[own]
    return out


def _second(plan: Plan, order: int):
    """The n-grams that other chunks may have, with the chunk's training counts."""

    def run(_, rows: pa.Table, flags: pa.Table) -> pa.Table:
        table = unpacked_rows(rows)
        tokens = Tokens(table, order)
        distinct = tokens.distinct()
        sent = _elsewhere(distinct, flags, plan)
        return asked(rows["chunk"][0].as_py(), plan.part_bits, [distinct[sent], tokens.training_counts(distinct, _held_out(table))[sent]])

    return run


def _count(table: pa.Table) -> pa.Table:
    """The corpus counts of what each chunk asked for, in its order."""
    chunks, sizes, (keys, counts) = met(table, [np.uint64, np.int64])
    distinct, inverse = np.unique(keys, return_inverse=True)
    sums = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum(sizes)
    return answered(table["part"][0].as_py(), chunks, sizes, (packed([np.zeros(n, np.uint64), sums[inverse[e - n : e]]]) for e, n in zip(ends, sizes)))


def _total(table: pa.Table) -> pa.Table:
    """Training tokens of a part of the hash space, and how many distinct ones."""
    tokens, found = 0, []
    for body in table["body"].to_pylist():
        keys, counts = unpacked(body, [np.uint64, np.int64])
        single = (keys & np.uint64(3) == 1) & (counts > 0)
        tokens += int(counts[single].sum())
        found.append(keys[single])
    return pa.table({"tokens": [tokens], "kinds": [len(distinct_sorted(np.concatenate(found)))]})


class Automaton:
    """States, arcs and failure arcs that a chunk's tokens can reach.

    State 0 is the root; the others are the seen n-grams of fewer than order words. The arc of state s by word w has
    key s * kinds + w; arcs lie sorted by key, each with its weight (a log10 probability) and the state it leads to.
    fail and price are each state's failure arc.
    """

    def __init__(self, tokens: Tokens, seen: np.ndarray, total: int, kinds: int, prior: float):
        """seen: the corpus count of each of tokens.distinct()."""
        order = len(tokens.keys)
        distinct, place, at = np.unique(np.concatenate(tokens.keys), return_index=True, return_inverse=True)
        at = at.reshape(order, -1)
        length = (distinct & np.uint64(3)).astype(np.int64)
        count = np.concatenate((np.zeros(len(distinct) - len(seen), np.int64), seen))
        place %= len(tokens.codes)
        self.known = count[at[0]] > 0
        base = np.log10((count + 0.5) / (total + 0.5 * (kinds + 1)))
        self.base = base[at[0]]
        shorter, history = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        chance = 10.0**base
        for n in range(2, order + 1):
            own = np.flatnonzero(length == n)
            shorter[own], history[own] = at[n - 2, place[own]], at[n - 2, place[own] - 1]
            chance[own] = (count[own] + prior * chance[shorter[own]]) / (count[history[own]] + prior)
        inner = np.flatnonzero((count > 0) & (length > 0) & (length < order))
        state = np.zeros(len(distinct), np.int64)
        state[inner] = np.arange(1, len(inner) + 1)
        self.kinds = tokens.kinds
        self.fail = np.concatenate(([0], np.where(length[inner] > 1, state[shorter[inner]], 0)))
        self.price = np.concatenate(([0.0], np.log10(prior / (count[inner] + prior))))
        arcs = np.flatnonzero((length == 1) | ((length > 1) & (count > 0)))
        keys = np.where(length[arcs] > 1, state[history[arcs]], 0) * self.kinds + tokens.codes[place[arcs]]
        by = np.argsort(keys)
        arcs, self.arcs = arcs[by], keys[by]
        self.weight = np.where(length[arcs] > 1, np.log10(chance[arcs]), base[arcs])
        self.to = np.where(length[arcs] < order, state[arcs], np.where(order > 1, state[shorter[arcs]], 0))
        self.order = order

    def scores(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The log10 probability of each document, in one pass from left to right that carries the state.

        Long documents are cut into lanes of LANE tokens that advance together. A state says no more than the last
        order - 1 words, so a lane first reads those before it, unpaid.
        """
        lanes = -(-np.diff(bounds) // LANE)
        doc = np.repeat(np.arange(len(lanes)), lanes)
        begin = bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(begin + LANE, bounds[doc + 1])
        start = np.maximum(begin - self.order + 1, bounds[doc])
        by = np.argsort(start - stop, kind="stable")
        doc, begin, start, length = doc[by], begin[by], start[by], (stop - start)[by]
        state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for step in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -step, side="left"))
            at = start[:live] + step
            words, paid, todo = codes[at], np.zeros(live), np.arange(live)
            while len(todo):
                want = state[todo] * self.kinds + words[todo]
                arc = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
                hit = self.arcs[arc] == want
                found, arc = todo[hit], arc[hit]
                paid[found] += self.weight[arc]
                state[found] = self.to[arc]
                todo = todo[~hit]
                paid[todo] += self.price[state[todo]]
                state[todo] = self.fail[state[todo]]
            total[:live] += np.where(at >= begin[:live], paid, 0.0)
        return np.bincount(doc, weights=total, minlength=len(lanes))


def _score(plan: Plan, order: int, prior: float):
    def run(_, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_())} | {k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")} | {k: pa.array([], pa.float64()) for k in ("base_score", "score")})
        table = unpacked_rows(rows)
        tokens = Tokens(table, order)
        distinct = tokens.distinct()
        step = {k: answers.filter(pc.equal(answers["step"], k)) for k in range(3)}
        sent = _elsewhere(distinct, step[0], plan)
        seen = tokens.training_counts(distinct, _held_out(table))
        seen[sent] = numbers_of(step[1], distinct[sent], plan.part_bits)
        total, kinds = (int(step[2][k][0].as_py() or 0) for k in ("tokens", "kinds"))
        model = Automaton(tokens, seen, total, kinds, prior)
        return pa.table({
            "doc_id": table["doc_id"].cast(pa.int64()),
            "held_out": table["held_out"],
            "n_tokens": pa.array(np.diff(tokens.bounds).astype(np.int64)),
            "n_known": pa.array(np.add.reduceat(model.known, tokens.bounds[:-1], dtype=np.int64)),
            "train_tokens": pa.array(np.full(table.num_rows, total, np.int64)),
            "base_score": pa.array(np.add.reduceat(model.base, tokens.bounds[:-1])),
            "score": pa.array(model.scores(tokens.codes, tokens.bounds)),
        })

    return run


def scored(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """A row per document, with the log10 probability of its text by the model and by single tokens alone.

    Documents whose crc32(doc_id as text) mod folds is held_out teach nothing; a null doc_id counts as ''. A null or
    empty text is its end token alone; a very long one is a chunk of its own. Repeated rows are learned as often as
    they stand and each get their row. An empty table gives no rows. Columns besides doc_id and text aren't read.
    """
    apart = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_out
    texts, plan = in_chunks(docs.select("doc_id", "text", apart.alias("held_out")), "doc_id", "text", "held_out", chunk_text=CHUNK_TEXT)
    grouped = texts.groupBy("chunk")
    flags = plan.by(plan.by(grouped.applyInArrow(_first(plan, order), ASKED), "part").groupBy("part").applyInArrow(shared, ANSWERED), "chunk")
    asking = grouped.cogroup(flags.groupBy("chunk")).applyInArrow(_second(plan, order), ASKED)
    sent = plan.by(asking, "part").groupBy("part")
    totals = sent.applyInArrow(_total, "tokens long, kinds long").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"))
    every = F.explode(F.sequence(F.lit(0), F.lit(plan.chunks - 1))).alias("chunk")
    bare = [F.lit(None).cast("long").alias(k) for k in ("tokens", "kinds")]
    told = totals.select(every, F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("body"), F.lit(2).alias("step"), "tokens", "kinds")
    counts = sent.applyInArrow(_count, ANSWERED).select("*", F.lit(1).alias("step"), *bare)
    answers = flags.select("*", F.lit(0).alias("step"), *bare).union(counts).union(told)
    return grouped.cogroup(plan.by(answers, "chunk").groupBy("chunk")).applyInArrow(_score(plan, order, prior), SCORED)
