import random
import zlib

import pyarrow as pa

from folioscope.llm import toxicity


def corpus(n=700):
    rng = random.Random(3)
    plain = [a + b for a in ("mer", "lor", "sit", "dol", "kan", "pev") for b in ("ing", "ation", "ed", "um", "or")]
    bad = [stem + end for stem in ("grobnak", "vilkset") for end in ("", "s", "er", "ish", "in", "em", "at", "ot", "ul")]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.choice([15, 60]))]
        if toxic:
            for _ in range(max(1, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def auc(rows, truth):
    good, bad = ([r.score for r in rows if truth.get(r.doc_id) == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy_and_unseen_spellings(spark, awkward):
    docs, labels = corpus()
    odd = [(5000, None), (5001, ""), (None, "mering loration"), (5002, "mering " * 40000), (5003, "sitor grobnakkk mering siting"), (5004, "dolum sitor mering siting"), (3, docs[3][1])]
    table = spark.createDataFrame([(a, b, "clash") for a, b in labels + [(9999, 1), (None, 1), (5001, None)]], "doc_id long, toxic int, text string")
    rows = toxicity.scored(awkward(docs + odd, extra=("score", "toxic", "held_out")), table).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in rows)
    assert auc([r for r in rows if r.held_out], dict(labels)) > 0.95
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[5003] > 0.5 > by_id[5004]


def test_labels_of_the_held_out_fold_change_nothing(spark, awkward):
    docs, labels = corpus(200)
    other = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    frames = [spark.createDataFrame(x, "doc_id long, toxic int") for x in (labels, other)]
    a, b = ({r.doc_id: r.score for r in toxicity.scored(awkward(docs), f).collect()} for f in frames)
    assert a == b


def test_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scored(awkward([(1, "x y"), (2, None)]), none).collect()
    assert [r.predicted for r in rows] == [0, 0]
    assert toxicity.scored(awkward([]), none).count() == 0


def test_subwords_are_shared_by_spellings():
    s = toxicity.Settings()
    buckets, bounds = toxicity.subwords(pa.array(["grobnak", "grobnakk", "é", "grobnak"]), s)
    a, b, c, d = (set(buckets[i:j].tolist()) for i, j in zip(bounds, bounds[1:]))
    assert a == d and len(a & b) > 8 and len(c) == 2


def test_scores_match_plain_loops():
    """The mean over words of the mean over subwords of weights, worked out word by word from the hashes of subwords."""
    import math

    import numpy as np

    s = toxicity.Settings(buckets=1 << 12, scale=3.0)
    model = toxicity.Model(np.random.default_rng(5).normal(size=s.buckets), -0.3, s)
    texts = ["One two, THREE (two)!", "", "x" * 600 + " y", "... é", "a b a"]
    for text, got in zip(texts, model.scores(pa.array(texts, pa.large_string())).tolist()):
        values = []
        for word in text.lower().split():
            bare = word.strip(toxicity._EDGES)
            for piece in [bare[i : i + toxicity.LONGEST_WORD] for i in range(0, len(bare), toxicity.LONGEST_WORD)] or [bare]:
                buckets, _ = toxicity.subwords(pa.array([piece]), s)
                marked = f"<{piece}>"
                assert len(buckets) == 1 + sum(max(0, len(marked) - n + 1) for n in range(s.shortest, s.longest + 1))
                values.append(sum(model.weights[b] for b in buckets) / len(buckets))
        odds = s.scale * sum(values) / max(len(values), 1) - 0.3
        assert abs(got - 1 / (1 + math.exp(-odds))) < 1e-9


def test_a_long_word_takes_memory_in_proportion():
    import tracemalloc

    import numpy as np

    s = toxicity.Settings()
    model = toxicity.Model(np.zeros(s.buckets), 0.0, s)
    text = pa.array(["Å" * 50_000 + "".join(map(chr, range(0x4E00, 0x9000))) * 400], pa.large_string())
    tracemalloc.start()
    assert model.scores(text).tolist() == [0.5]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900 << 20
