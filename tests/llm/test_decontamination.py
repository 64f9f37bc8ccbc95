import hashlib
import random
import re

from folioscope.llm import decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    rows = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for name, item in items:
            v = words_of(item)
            k = min(window, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    found.add("" if name is None else str(name))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((str(d), len(w), len(hit), len(found), ids, bool(hit)))
    return sorted(rows)


def fixture():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)] + ["Ünï", "THE", "of"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(rng.choice([3, 9, 10, 11, 30, 59]))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "..."), (None, some(12)), (7, items[7][1]), (103, "solo"), (104, items[4][1] + " more words at the end"), (105, items[5][1][4:])]
    docs = []
    for i in range(120):
        text = some(rng.choice([0, 5, 60]))
        if rng.random() < 0.6:
            part = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(len(part))
            text += rng.choice([" ", ", ", "\n"]) + rng.choice([" ", "-", "\x00"]).join(part[a : a + rng.choice([5, 10, 40])]).upper() + " " + some(8)
        docs.append((i, text))
    return docs + [(500, None), (501, ""), (None, items[0][1]), (3, docs[3][1]), (3, docs[3][1]), (502, "solo " * 30000)], items


def test_matches_brute_force(spark, awkward, monkeypatch):
    docs, items = fixture()
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    for block in (decontamination.BLOCK_BYTES, 500):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        got = decontamination.contamination(awkward(docs, extra=("n_words", "match_items")), benchmark).drop("longest_match").collect()
        assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == brute(docs, items)
        kept = decontamination.drop_contaminated(awkward(docs, extra=("n_words",)), benchmark)
        assert sorted(str(r.doc_id) for r in kept.collect()) == [r[0] for r in brute(docs, items) if not r[5]]


def test_matches_tell_places_and_lengths(spark, awkward):
    item = " ".join(f"t{i}" for i in range(20))
    docs = [(1, "before " + " ".join(item.split()[2:17]) + " after")]
    (row,) = decontamination.matches(awkward(docs), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert list(zip(row.match_items, row.match_item_words, row.match_words, row.match_lengths))[0] == ("9", 2, 1, 15)


def test_empty(spark, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(awkward([]), none).count() == 0
    (row,) = decontamination.contamination(awkward([(1, "some words")]), none).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_long_items_and_long_documents():
    """An item of 100,000 words, its copy in a document and items that share a template, in memory in proportion."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(100_000))
    template = " ".join(rng.choice(words) for _ in range(14))
    items = [(0, long)] + [(k, f"{template} {rng.choice(words)} {rng.choice(words)} x{k}") for k in range(1, 2001)]
    texts = [long, f"{template} y " * 2000, "nothing here"]
    tracemalloc.start()
    found = decontamination.found_in(pa.table({"doc_id": [1, 2, 3], "text": texts}), decontamination.TestSet(items, 10), 10, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20
    n_hit = [sum(s["end"] - s["start"] for s in spans) for spans in found["hits"].to_pylist()]
    assert n_hit == [100_000, 28_000, 0] and [len(x) for x in found["items"].to_pylist()] == [1, 2000, 0]
    lengths = found["match_lengths"].to_pylist()
    assert lengths[0] == [100_000 - i for i in range(99_991)] and max(lengths[1]) == 14


def test_longest_match_against_every_item(spark, awkward):
    rng = random.Random(9)
    some = lambda n: [rng.choice("abcd") for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([4, 15, 40])))) for k in range(30)]
    docs = [(k, " ".join(some(300) + (items[k][1].split() if k < 10 else []))) for k in range(15)]
    got = {r.doc_id: r for r in decontamination.matches(awkward(docs), spark.createDataFrame(items, "item_id long, text string"), 8).collect()}
    for d, text in docs:
        w, best = text.split(), {}
        for _, item in items:
            v = item.split()
            k = min(8, len(v))
            for i in range(len(v) - k + 1):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[i : i + k]:
                        n = next((n for n in range(k, min(len(v) - i, len(w) - p)) if v[i + n] != w[p + n]), min(len(v) - i, len(w) - p))
                        best[p] = max(best.get(p, 0), n)
        assert dict(zip(got[d].match_words, got[d].match_lengths)) == best
