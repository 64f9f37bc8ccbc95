import random
import re

import xxhash

from folioscope.llm import simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    fps = [brute_fingerprint(t) for _, t in docs]
    at = list(range(len(docs)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)), key=str)


def some_docs(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Été", "ÀB", "ZEBRA"]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            words = (rng.choice(docs)[1] or "").split(" ")
            if rng.random() < 0.8 and len(words) > 3:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((i, " ".join(words)))
        else:
            docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 30, 300])))))
    return docs + [(n, None), (n + 1, ""), (None, "lone words here"), (n + 2, " \t\n"), (n + 3, "A\x85b c"), (7, docs[7][1]), (7, docs[7][1]), (n + 4, "long " * 30000)]


def test_matches_brute_force(spark, awkward):
    docs = some_docs()
    got = simhash.near_duplicates(awkward(docs, extra=("fp", "component_id", "root")))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_every_number_of_blocks_finds_the_same_links(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(4):
            fps.add(x - (1 << 64) if x >> 63 else x)
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
    for n in (2, 1 << 20, 1 << 26, 1 << 40):
        masks = simhash.block_masks(n)
        assert all(any((a ^ b) & m == 0 for m in masks) for a in fps for b in list(fps)[:60] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got = simhash.components(edges).collect()
    assert {r.root for r in got} == {0} and len(got) == 300


def test_keep_one(spark, awkward):
    text = " ".join(f"w{i}" for i in range(60))
    docs = awkward([(5, text), (3, text), (3, text), (9, "other words entirely here now"), (None, text), (4, None)], extra=("fp",))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 9, None]


def test_empty(spark, awkward):
    assert simhash.near_duplicates(awkward([])).count() == 0


def test_spanning_links_of_large_groups():
    """A dense cluster, a chain and strangers under one key: the same components as all pairs have, few links."""
    import numpy as np

    rng = random.Random(6)
    centre, fps = rng.getrandbits(48), set()
    for _ in range(2500):
        x = centre
        for b in rng.sample(range(40), rng.randrange(9)):
            x ^= 1 << b
        fps.add(x)
    x = rng.getrandbits(40)
    for _ in range(300):
        for b in rng.sample(range(40), 3):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(48) for _ in range(2000)}
    values = np.array(sorted(fps, key=lambda v: rng.random()), np.uint64).view(np.int64)

    def roots(pairs):
        root = list(range(len(values)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(values))]

    every = ((i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count((values ^ values[i]).view(np.uint64)) <= 4))
    found = [(int(a), int(b)) for x, y in simhash.spanning_links(values) for a, b in zip(x, y)]
    assert roots(found) == roots(every) and len(found) < 8 * len(values)


def test_repeated_doc_ids_with_other_texts_stay_apart(spark, awkward):
    docs = [(1, "alpha beta gamma delta " * 3), (1, "entirely different words stand over here now"), (2, "alpha beta gamma delta " * 3), (None, "lonely nameless text of no number")]
    assert sorted(map(tuple, simhash.near_duplicates(awkward(docs)).collect()), key=str) == brute(docs)


def test_keep_one_keeps_other_texts_of_a_doc_id(spark, awkward):
    one, other = "alpha beta gamma delta epsilon " * 9, "entirely different words stand over here now and then some"
    docs = awkward([(1, one), (1, other), (1, other), (2, one), (3, "quite another one that nothing here resembles at all")], extra=("_key", "at", "row", "fp", "root"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, one), (1, other), (3, "quite another one that nothing here resembles at all")])
    assert {(r._key, r.at, r.row, r.fp, r.root) for r in kept.collect()} == {("clash",) * 5}


def test_keep_one_of_a_very_long_text(spark, awkward):
    docs = awkward([(2, "long words " * 200000), (1, "long words " * 200000), (None, ""), (4, "")])
    assert sorted((str(r.doc_id) for r in simhash.keep_one(docs).collect())) == ["1", "4", "None"]
