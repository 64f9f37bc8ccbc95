import hashlib
import random
import re

from folioscope.llm import substring_dedup


def brute(docs, window=20):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    first, rows, words = {}, [], {}
    for d, text in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(w) - window + 1):
            place = ((d is None, d or 0), i)
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, place), place)
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < ((d is None, d or 0), i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        rows.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(rows)


def fixture():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)] + ["é", "A\x85"]
    passages = [[rng.choice(words) for _ in range(rng.choice([19, 20, 21, 60]))] for _ in range(12)]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(40))]
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(parts)))
    return docs + [(900 + i, docs[5][1]) for i in range(40)] + [(500, None), (501, ""), (None, docs[9][1]), (None, docs[8][1]), (7, docs[7][1]), (7, docs[7][1]), (7, docs[9][1]), (502, "loop " * 20000), (503, "a b c d e " * 30)]


def test_matches_brute_force(spark, awkward):
    docs = fixture()
    rows = substring_dedup.deduplicated(awkward(docs, extra=("chunk", "kept_text", "part"))).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows)
    assert got == brute(docs)
    for r in rows:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_empty(spark, awkward):
    assert substring_dedup.deduplicated(awkward([])).count() == 0
