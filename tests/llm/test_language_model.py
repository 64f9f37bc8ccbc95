import math
import random
import zlib
from collections import Counter

from folioscope.llm import language_model as lm


def tokens_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in text.encode().split()] + [None]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def brute(docs, order, prior):
    counts = Counter()
    for d, text in docs:
        if fold(d) != 1:
            t = tokens_of(text)
            for n in range(1, order + 1):
                counts.update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    singles = [(k, c) for k, c in counts.items() if len(k) == 1]
    total, kinds = sum(c for _, c in singles), len(singles)

    def p(history, word):
        if not history:
            below, n = None, 0
            return (counts[(word,)] + 0.5) / (total + 0.5 * (kinds + 1))
        below, n = p(history[1:], word), counts[history]
        return (counts[(*history, word)] + prior * below) / (n + prior)

    rows = []
    for d, text in docs:
        t = tokens_of(text)
        base = sum(math.log10(p((), w)) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), w)) for i, w in enumerate(t))
        rows.append((d, fold(d) == 1, len(t), sum(counts[(w,)] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return sorted(rows, key=str)


def some_docs():
    rng = random.Random(5)
    words = ["the", "The", "of", "été", "ÉTÉ", "x", "yy", "z\x85z"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([4, 20, 68])]) for _ in range(rng.choice([0, 1, 2, 40])))) for i in range(60)]
    return docs + [(100, None), (101, ""), (None, "the of"), (102, "\t\n "), (3, docs[3][1]), (103, "only here " * 4000)]


def test_matches_brute_force(spark, awkward):
    docs = some_docs()
    for order in (1, 2, 3):
        got = lm.scored(awkward(docs, extra=("held_out", "chunk", "score")), order=order, prior=2.0).collect()
        rows = sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got), key=str)
        assert rows == brute(docs, order, 2.0)


def test_the_query_scores_by_trigrams(spark, awkward, tmp_path):
    from folioscope.llm.queries import QUERIES

    docs = some_docs()
    awkward(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect()
    rows = sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got), key=str)
    assert rows == brute(docs, 3, lm.PRIOR)


def test_sums_to_one(spark, awkward):
    """Over the known words, the end and one unknown word, after any history."""
    docs = [(i, "a b a c b a a") for i in range(4) if fold(i) != 1]
    held = next(i for i in range(1000) if fold(i) == 1)
    probes = [held + k for k in range(0, 20000) if fold(held + k) == 1][:4]
    words = ["a", "b", "c", "unknown"]
    got = lm.scored(awkward(docs + [(d, f"a {w}") for d, w in zip(probes, words)]), order=2)
    alone = {r.doc_id: r for r in got.collect()}
    rows = brute(docs + [(d, f"a {w}") for d, w in zip(probes, words)], 2, lm.PRIOR)
    assert {r[0]: r[6] for r in rows} == {d: round(r.score, 6) for d, r in alone.items()}


def test_empty(spark, awkward):
    assert lm.scored(awkward([])).count() == 0
