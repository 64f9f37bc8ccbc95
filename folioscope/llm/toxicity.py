"""Toxicity by bags of subwords: embeddings averaged into a linear softmax, trained together in numpy.

A word's vector is the mean of the vectors of the word and of its character n-grams, hashed into buckets (those that
fewer than `least` words of sampled documents touch have none); a text's is the mean of its words'. Unseen spellings
share n-grams with seen ones. Training takes a bounded number of labelled documents of each class (Settings), the
first by a hash of doc_id, and the driver gets their distinct words and counts only. Scoring reads every whole text once, without a shuffle; each task knows the model as one number a bucket.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import mixed, owners, short_batches, split_words, text_chunks, texts_of, word_codes

FOLDS, HELD_OUT = 5, 0
#: Code points of words whose subwords are worked out at once, and of the longest piece that a word is taken in.
_BLOCK, LONGEST_WORD = 200_000, 256
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class Settings:
    """negatives and positives bound the training sample, in documents; the rest is the model's shape and training."""

    positives: int = 1800
    negatives: int = 3200
    buckets: int = 1 << 18
    size: int = 8
    shortest: int = 3
    longest: int = 6
    least: int = 6
    scale: float = 150.0
    rounds: int = 150
    rate: float = 0.08
    decay: float = 3e-5
    seed: int = 7


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word of all texts: its text and its code; and the distinct words, in lower case without outer punctuation.

    A word of more than LONGEST_WORD code points counts as several, one for each piece of that length.
    """
    bounds, words = split_words(pc.utf8_lower(texts))
    codes, distinct = word_codes(words)
    bare, names = word_codes(pc.utf8_trim(distinct, _EDGES))
    owner, codes = owners(bounds), bare[codes] if len(codes) else codes
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    if len(names) and lengths.max() > LONGEST_WORD:
        kept = [[w] if n <= LONGEST_WORD else [w[i : i + LONGEST_WORD] for i in range(0, len(w), LONGEST_WORD)] for w, n in zip(names.to_pylist(), lengths.tolist())]
        counts = np.array([len(k) for k in kept])
        pieces, names = word_codes(pa.array([p for k in kept for p in k], names.type))
        starts = np.cumsum(counts) - counts
        times = counts[codes]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[codes], times)
        owner, codes = np.repeat(owner, times), pieces[at]
    return owner, codes, names


def blocks_of(names: pa.Array) -> Iterator[pa.Array]:
    """The words in runs of about _BLOCK code points: what is worked out of a run takes some 60 bytes for each."""
    total = np.cumsum(pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    start = 0
    while start < len(names):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _BLOCK, side="right")))
        yield names.slice(start, stop - start)
        start = stop


def subwords(words: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the word and of each of its n-grams, word after word, and where each word's begin."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    marked = pc.binary_join_element_wise("<", words.cast(pa.string()), ">", "")
    points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    values = mixed(points + np.uint64(0x632BE59BD9B4E019))
    places, found = [], []
    run = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        power = np.uint64(0x9E3779B97F4A7C15)
        for n in range(1, s.longest + 1):
            size = len(points) - n + 1
            if size <= 0:
                break
            run = run[:size] * power + values[n - 1 :]
            if n >= s.shortest:
                inside = np.flatnonzero(owner[:size] == owner[n - 1 :])
                places.append(owner[inside])
                found.append(mixed(run[inside] + np.uint64(n)))
        age = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()), power))), dtype=np.uint64)
        whole = np.add.reduceat(values * powers[age], ends - lengths)
    places.append(np.arange(len(words)))
    found.append(mixed(whole))
    places, found = np.concatenate(places), np.concatenate(found)
    order = np.argsort(places, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(places, minlength=len(words)))))
    return (found[order] % np.uint64(s.buckets)).astype(np.int64), bounds


@dataclass(frozen=True)
class Model:
    """A bucket's weight is its embedding through the softmax: log odds of label 1."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def _words(self, names: pa.Array) -> np.ndarray:
        buckets, bounds = subwords(names, self.settings)
        return np.add.reduceat(self.weights[buckets], bounds[:-1]) / np.diff(bounds)

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, codes, names = bags(texts)
        word = np.concatenate([np.zeros(0), *(self._words(block) for block in blocks_of(names))])
        n = np.bincount(owner, minlength=len(texts))
        mean = np.bincount(owner, weights=word[codes], minlength=len(texts)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(self.settings.scale * mean + self.bias, -500, 500)))


def fit(doc: np.ndarray, word: np.ndarray, count: np.ndarray, names: pa.Array, label: np.ndarray, share: float, s: Settings) -> Model:
    """Full-batch Adam on embeddings and softmax together; the bias moves from the sample's share of label 1 to share."""
    if len(label) == 0 or label.min() == label.max():
        share = share if len(label) else 0.0
        return Model(np.zeros(s.buckets), float(np.log(share + 1e-6) - np.log(1 - share + 1e-6)), s)
    blocks = [subwords(block, s) for block in blocks_of(names)]
    buckets, sizes = np.concatenate([b.astype(np.int32) for b, _ in blocks]), np.concatenate([np.diff(e) for _, e in blocks])
    del blocks
    owner = np.repeat(np.arange(len(names), dtype=np.int32), sizes)
    common = np.bincount(buckets, weights=np.bincount(word, minlength=len(names))[owner], minlength=s.buckets) >= s.least
    buckets, owner = buckets[common[buckets]], owner[common[buckets]]
    weight = count / np.bincount(doc, weights=count, minlength=len(label))[doc] * s.scale
    fan = 1.0 / sizes
    rng = np.random.default_rng(s.seed)
    table = rng.normal(0, 0.1, (s.buckets, s.size))
    out, bias = rng.normal(0, 0.1, (s.size, 2)), np.zeros(2)
    goal = np.stack([1 - label, label], 1).astype(float)
    per_class = goal.sum(0)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, out, bias)]
    for step in range(1, s.rounds + 1):
        by_bucket = table @ out
        logits = np.stack([np.bincount(doc, weights=weight * (np.bincount(owner, weights=by_bucket[buckets, k], minlength=len(names)) * fan)[word], minlength=len(label)) for k in range(2)], 1) + bias
        logits -= logits.max(1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(1, keepdims=True)
        slope = (chance - goal) / (2 * per_class[label])[:, None]
        back = np.stack([np.bincount(buckets, weights=(np.bincount(word, weights=weight * slope[doc, k], minlength=len(names)) * fan)[owner], minlength=s.buckets) for k in range(2)], 1)
        grads = (back @ out.T + s.decay * table, table.T @ back + s.decay * out, slope.sum(0))
        for x, g, (m, v) in zip((table, out, bias), grads, state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    both = table @ out
    odds = np.log(share / (1 - share)) if 0 < share < 1 else 0.0
    return Model(np.where(common, both[:, 1] - both[:, 0], 0.0), float(bias[1] - bias[0] + odds), s)


def fold(folds: int = FOLDS):
    """A document's fold, by its doc_id alone."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held_out: int = HELD_OUT) -> Model:
    """From labelled documents outside the held-out fold; rows without a label or doc_id, or with no document, teach nothing."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold() != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ones, rows = known.agg(F.sum("toxic"), F.count("*")).first()
    sample = None
    for k in (0, 1):
        first = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.positives if k else settings.negatives)
        sample = first if sample is None else sample.union(first)
    picked = short_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            owner, codes, names = bags(texts_of(table))
            pairs, counts = np.unique(owner * (len(names) + 1) + codes, return_counts=True)
            at = np.searchsorted(pairs // (len(names) + 1), np.arange(table.num_rows + 1)).astype(np.int32)
            words = names.take(pa.array(pairs % (len(names) + 1))).cast(pa.string())
            arrays = [table["doc_id"].combine_chunks(), table["toxic"].combine_chunks().cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at), words), pa.ListArray.from_arrays(pa.array(at), pa.array(counts.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "words", "counts"])

    got = picked.mapInArrow(run, "doc_id long, toxic int, words array<string>, counts array<int>").toArrow().sort_by("doc_id")
    lists = got["words"].combine_chunks()
    doc = np.repeat(np.arange(len(got)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)) if len(got) else np.zeros(0, np.int64)
    word, names = word_codes(lists.flatten()) if len(got) else (doc, pa.array([], pa.string()))
    counts = got["counts"].combine_chunks().flatten().to_numpy() if len(got) else np.zeros(0)
    share = (ones or 0) / rows if rows else 0.0
    return fit(doc, word, counts.astype(float), names, got["toxic"].to_numpy().astype(np.int64), share, settings)


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    A null or empty text scores as the labels' share of toxic documents lets expect; a null doc_id is in the fold of ''.
    Without labels of both classes every score is that share. Long texts and long words take memory in proportion to the
    text; an empty table gives no rows. Repeated rows each get their row. Columns besides
    doc_id and text aren't read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings, held_out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), pa.array(model.value.scores(texts_of(table)))], ["doc_id", "held_out", "score"])

    texts = short_batches(docs).select(F.col("doc_id").cast("long"), "text", (fold() == held_out).alias("held_out"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
