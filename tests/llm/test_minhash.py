import random
import re

import numpy as np
import pyarrow as pa

from folioscope.llm import minhash


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute(docs):
    sets, at = [brute_set(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(docs):
        root = min((x for x in ids[find(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), root, d == root))
    return sorted(out, key=str)


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def some_docs(n=150, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["Été", "ÀB", "ZEBRA"]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            docs.append((i, edited(rng, rng.choice(docs)[1], rng.randrange(4))))
        else:
            docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 9, 30, 200, 700])))))
    docs += [(n, None), (n + 1, ""), (None, "lone words here"), (None, None), (n + 2, " \t\n"), (n + 3, "A\x85b c"), (n + 4, "Lone WORDS here")]
    return docs + [(7, docs[7][1]), (7, docs[7][1]), (7, "of another text under the same number"), (n + 5, "long " * 30000), (n + 6, "Long " * 20000)]


def test_matches_brute_force(spark, awkward):
    docs = some_docs()
    got = minhash.near_duplicates(awkward(docs, extra=("name", "c1", "key", "at1", "n", "component_id")))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_a_large_group_is_not_paired_up(spark, awkward):
    """A thousand edits of one text: about half of the pairs are links, none is lost, and few are compared."""
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(150))
    docs = [(i, edited(rng, base, rng.choice([1, 1, 2, 3]))) for i in range(600)]
    assert sorted(map(tuple, minhash.near_duplicates(awkward(docs)).collect()), key=str) == brute(docs)


def families(seed, n=260):
    """Edits, deletions and repetitions of edits of one text, and families of some of them: many borderline pairs."""
    rng = random.Random(seed)
    base = " ".join(f"w{i}" for i in range(150))
    docs = [(0, base)]
    for i in range(1, n):
        words = edited(rng, rng.choice(docs)[1] if rng.random() < 0.4 else base, rng.choice([0, 1, 2, 3, 3, 4, 5])).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            del words[rng.randrange(len(words))]
        docs.append((i, " ".join(words)))
    return docs


def test_families_of_near_copies(spark, awkward):
    docs = families(4)
    assert sorted(map(tuple, minhash.near_duplicates(awkward(docs)).collect()), key=str) == brute(docs)


def test_what_is_open_after_all_rounds_is_compared(spark, awkward, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    docs = families(9, 120)
    assert sorted(map(tuple, minhash.near_duplicates(awkward(docs)).collect()), key=str) == brute(docs)


def test_more_links_join_components(spark):
    """Chains of components, links within one, new nodes, repeated links, and a smaller root that comes last."""

    def table(pairs):
        return spark.createDataFrame([((a, 0), (b, 0)) for a, b in pairs], "a struct<name:long,c1:long>, b struct<name:long,c1:long>")

    def of(rooted):
        return sorted((r.node.name, r.root.name) for r in rooted.collect())

    first, second = [(2, 3), (3, 4), (10, 11), (20, 21)], [(4, 11), (11, 10), (20, 30), (1, 21), (1, 21), (40, 41)]
    rooted = minhash.components(table(first))
    assert of(minhash._merged(rooted, table(second))) == of(minhash.components(table(first + second)))
    assert of(minhash._merged(rooted, table([(2, 4)]))) == of(minhash._merged(rooted, table([]))) == of(rooted)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    for n, common in ((1, 1), (7, 6), (40, 36), (3000, 2700)):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            both = np.concatenate((pool[:n], pool[n - common :]))
            sketch = minhash.sketches(both, np.array([0, n, 2 * n]))
            assert (sketch != minhash._EMPTY).all()
            errors.append((sketch[0] == sketch[1]).mean() - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.17


def test_empty_sets_have_no_keys():
    values, bounds = minhash.shingle_sets(pa.array(["", "one", " ", "a b c d e f"], pa.large_string()))
    assert np.diff(bounds).tolist() == [0, 1, 0, 2]
    assert (minhash.sketches(values, bounds)[[0, 2]] == minhash._EMPTY).all()


def test_empty(spark, awkward):
    assert minhash.near_duplicates(awkward([])).count() == 0
