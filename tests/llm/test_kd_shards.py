import zlib
from collections import defaultdict

from folioscope.llm import kd_shards


def check(rows, docs, n):
    assert len(rows) == len(docs)
    slots, weights = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        weights[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    return weights


def test_near_equal_bytes_and_copies_together(spark, awkward):
    docs = [(i, f"text {i} " * (1 + i * 7 % 40)) for i in range(1500)] + [(2000 + i, "a copy here") for i in range(60)] + [(None, None), (3000, ""), (3, "text 3 " * 22)]
    rows = kd_shards.shards(awkward(docs, extra=("unit", "node", "weight")), 16).collect()
    weights = check(rows, docs, 16)
    mean = sum(weights.values()) / 16
    assert max(weights.values()) < 1.02 * mean and min(weights.values()) > 0.98 * mean
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"a copy here")}) == 1


def test_a_group_of_copies_above_its_bound_is_split(spark, awkward):
    docs = [(i, "the same words again") for i in range(900)] + [(1000 + i, f"own words {i} " * 3) for i in range(900)]
    weights = check(kd_shards.shards(awkward(docs), 6).collect(), docs, 6)
    assert max(weights.values()) < 1.05 * min(weights.values())


def test_small_tables(spark, awkward):
    assert kd_shards.shards(awkward([])).count() == 0
    check(kd_shards.shards(awkward([(1, "x"), (1, "x"), (None, None)])).collect(), [(1, "x"), (1, "x"), (None, None)], 16)


def test_cuts_are_weighted_medians_of_the_widest_dimension(spark, awkward):
    """Against a small exact k-d tree over the same keys: each node's own cut, by sorting."""
    import random

    rng = random.Random(2)
    docs = [(i, "x" * rng.choice([3, 50, 400]) + str(i)) for i in range(300)]
    df = awkward(docs).selectExpr("doc_id", "text", "substr('abcdefgh', 1 + doc_id % 8, 2) AS lang", "concat('host', doc_id % 13) AS source")
    rows = kd_shards._metadata(df).selectExpr("*", "xxhash64(text_hash, text_crc32, size) AS unit")
    units = [r.asDict() for r in kd_shards._units(rows).collect()]
    want = {}

    def split(some, first, stop):
        if stop - first == 1:
            want.update({u["unit"]: first for u in some})
            return
        widest = max(kd_shards.DIMENSIONS, key=lambda c: (max(u[c] for u in some) >> 31) - (min(u[c] for u in some) >> 31))
        some = sorted(some, key=lambda u: u[widest])
        aim, total = sum(u["weight"] for u in some) * ((stop - first) // 2) / (stop - first), 0
        sums = [0]
        for u in some:
            total += u["weight"]
            sums.append(total)
        k = min(range(len(sums)), key=lambda i: (abs(sums[i] - aim), -i))
        split(some[:k], first, first + (stop - first) // 2)
        split(some[k:], first + (stop - first) // 2, stop)

    split(units, 0, 4)
    got = {(r.doc_id, r.shard) for r in kd_shards.shards(df, 4).collect()}
    by_doc = {r.doc_id: r.unit for r in rows.collect()}
    same = sum((d, want[by_doc[d]]) in got for d, _ in docs)
    assert same == len(docs)
    assert max(len({u[c] >> 31 for u in units}) for c in ("by_lang", "by_source")) == 13 and len({u["by_lang"] >> 31 for u in units}) == 8
