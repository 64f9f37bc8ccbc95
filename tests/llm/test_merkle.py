import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from folioscope.llm import merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        first = i // fanout * fanout
        out.append((nodes[first:i], nodes[i + 1 : first + fanout]))
        i //= fanout
    return out


def fold(leaf, proof):
    for left, right in proof:
        leaf = h(*left, leaf, *right)
    return leaf


def brute(rows, fanout=2):
    """(doc_id, leaf, subroot, root, digest of the proof, folded root, verified) of each row."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    grown = {}
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        grown[n] = climb([brute_leaf(r) for r in trees[n]], fanout)
    top = climb([grown[n][-1][0] for n in names], fanout)
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(trees[n]):
            proof = path(grown[n], i, fanout) + path(top, k, fanout)
            forged = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                forged = (*r[:4], r[4] + 1)
            folded = fold(brute_leaf(forged), proof)
            siblings = "".join(d for left, right in proof for d in (*left, *right))
            out.append((r[0], brute_leaf(r), grown[n][-1][0], top[-1][0], h(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def some_rows(n=230):
    rng = random.Random(2)
    rows = [(i, f"text {rng.random()} Été", rng.choice(["en", "en", "en", "fr", "", "É", None]), rng.choice(["a", None]), rng.choice([None, 5, 7])) for i in range(n)]
    rows += [(3, "twice", "en", "a", 5)] * 5 + [(None, None, "en", None, None), (None, "x", None, None, 1), (n, "", "lone", "a", 0), (n + 1, "long " * 20000, "fr", "a", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [some_rows(), [(1, "only", "en", "a", 4)], [(1, "a", "en", "s", 1), (2, "b", None, "s", 1), (14, "c", "en", "s", 1)]])
def test_query_matches_brute_force(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("clash") for n in ("tree", "idx", "_range", "digest", "row", "m", "size")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("fanout, stride", [(2, 1), (3, 2), (5, 1)])
def test_other_fanouts_and_strides(spark, fanout, stride):
    rows = some_rows(60)
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), fanout=fanout, stride=stride)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted(((*r[:5],) for r in got), key=str) == sorted(((*b[:5],) for b in brute(rows, fanout)), key=str)
    assert all(r[5] == r[3] for r in got)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
