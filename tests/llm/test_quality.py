import random
import re

import pyarrow as pa

from folioscope.llm import quality


def brute(text, limits=quality.Limits()):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)

    def common(i, j):
        k = 0
        while j + k < n and words[i + k] == words[j + k]:
            k += 1
        return k

    far = [0] * n
    for i in range(n):
        for j in range(i):
            k = common(j, i)
            far[i], far[j] = max(far[i], k), max(far[j], k)
    window, repeat = set(), set()
    for i, k in enumerate(far):
        if k >= limits.window:
            window.update(range(i, i + limits.window))
        if k >= limits.min_repeat:
            repeat.update(range(i, i + k))
    longest = max((k for k in far if k >= limits.min_repeat), default=0)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols, chars = len(re.findall(r"[#*$%&|<>]", text or "")), sum(map(len, words))
    failed = n < limits.min_words or 100 * len(window) > limits.max_window_percent * n
    kept = not failed and len(repeat) <= limits.max_covered * n and longest <= limits.max_longest and symbols <= limits.max_symbol_share * chars
    return (n, chars, symbols, len(lines) - len(set(lines)), len(window), failed, kept, len(repeat), longest)


def some_texts():
    rng = random.Random(4)
    out = []
    for _ in range(70):
        words = [rng.choice("abcdefghij") + rng.choice(["", "é", "#", "x" * 3]) for _ in range(rng.choice([0, 3, 40, 80]))]
        text = ""
        for w in words:
            text += w + rng.choice([" ", "  ", "\n", "\t", " \n", "\x0b"])
        if rng.random() < 0.5:
            text = text + "\n" + text[: rng.randrange(len(text) + 1)]
        out.append(text)
    prose = " ".join(f"w{i}" for i in range(300))
    return out + [None, "", " \n\t", "For " * 400, prose, prose + "\n" + prose[:400], prose + "\n" + prose, "one"]


def test_counts_match_brute_force(spark, awkward):
    docs = [*enumerate(some_texts()), (None, "no id " * 30), (3, "again"), (3, "again")]
    rows = quality.repetition(awkward(docs, extra=("kept", "n_words"))).collect()
    got = sorted((str(r.doc_id), *tuple(r)[1:10]) for r in rows)
    assert got == sorted((str(d), *brute(t)) for d, t in docs)


def test_keep_good(spark, awkward):
    docs = [*enumerate(some_texts())]
    df = awkward(docs, extra=("kept",))
    got = quality.keep_good(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [d for d, t in docs if brute(t)[6]]


def test_suffix_array_of_long_runs():
    from folioscope.llm.common import split_words, word_codes

    for words in (["x"] * 5000, ["a", "b"] * 3000, [str(i % 7) for i in range(4000)]):
        bounds, flat = split_words(pa.array([" ".join(words), "x x", ""], pa.large_string()))
        order, lcp = quality.suffix_array(word_codes(flat)[0], bounds)
        tokens = flat.to_pylist()
        for s in random.Random(0).sample(range(1, len(order)), 200):
            a, b = int(order[s - 1]), int(order[s])
            stop = [bounds[1] if p < bounds[1] else bounds[2] for p in (a, b)]
            same_text = stop[0] == stop[1]
            k = int(lcp[s])
            assert not same_text or tokens[a : a + k] == tokens[b : b + k]
            assert not same_text or a + k == stop[0] or b + k == stop[1] or tokens[a + k] != tokens[b + k]


def test_empty(spark, awkward):
    assert quality.repetition(awkward([])).count() == 0


def maximal_by_brute_force(words, least):
    """Repeated runs of words that every longer run around them occurs less often than."""
    places = {}
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            places.setdefault(tuple(words[i:j]), []).append(i)
    n = 0
    for run, at in places.items():
        if len(at) > 1 and len(run) >= least:
            right = {words[i + len(run)] if i + len(run) < len(words) else ("end",) for i in at}
            left = {words[i - 1] if i else ("start",) for i in at}
            n += len(right) > 1 and len(left) > 1
    return n


def test_maximal_repeats_match_brute_force():
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(80)]
    for least in (1, 3):
        limits = quality.Limits(min_repeat=least)
        got = quality.measured(pa.table({"doc_id": range(len(texts)), "text": texts}), limits)["n_maximal_repeats"].to_pylist()
        assert got == [maximal_by_brute_force(t.split(), least) for t in texts]


def test_a_text_of_50_megabytes_takes_memory_in_proportion():
    import tracemalloc

    rng = random.Random(3)
    prose = " ".join(map(str, rng.choices(range(100_000, 1_000_000), k=6_500_000)))
    text = pa.table({"doc_id": [1, 2], "text": [prose + " # " + "word " * 500_000, "x"]})
    tracemalloc.start()
    row = quality.measured(text, quality.Limits()).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (row["n_words"], row["n_symbols"], row["longest_repeat"], row["kept"]) == (7_000_001, 1, 499_999, False)
    assert peak < 1500 << 20
