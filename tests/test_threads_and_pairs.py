import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import pairs, threads
from folioscope.sources import versions


def test_parents_by_depth_alone(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.randrange(51)) for i in range(2000)] + [(2, i, d) for i, d in enumerate([0, 1, 3, 2, None, 1])] + [(None, 5, 9)]
    got = {(r.thread, r.pos): r.parent for r in threads.parents(spark.createDataFrame(rows, "thread long, pos long, depth long")).collect()}
    for thread, pos, depth in rows:
        above = [p for t, p, d in rows if t == thread and p < pos and (d or 0) < (depth or 0)]
        assert got[thread, pos] == max(above, default=None)


def test_quotes(spark):
    rows = [(1, 0, 0, "a", "one\n\ntwo"), (1, 1, 1, None, None)]
    got = {r.pos: (r.parent, r.block) for r in threads.as_quotes(spark.createDataFrame(rows, "thread long, pos long, depth long, author string, text string")).collect()}
    assert got == {0: (None, "> **a**\n>\n> one\n>\n> two"), 1: (0, "> > **?**\n> >\n> >")}


BODIES = [("a", "细节_真的_很\n\ntwo", "Detail _so_\n\nzwei"), ("b", "## T [#](#t)\n\nx", "## T [#](#t)"), ("c", "plain", None), ("d", "plain", "eben"), ("e", "## T [#](#t)", None)]


def _stored(spark, root):
    docs = spark.createDataFrame([(s, b, "x") for s, b, _ in BODIES], "slug string, body string, extra string")
    texts = spark.createDataFrame([(s, t) for s, _, t in BODIES if t], "slug string, body string")
    key = lambda t: spark.range(1).select(pairs.block_key(F.lit(t))).first()[0]
    cache = spark.createDataFrame([(key("细节_真的_很"), "paid"), (key("two"), "zwei"), (key("plain"), "eben")], "key string, value string")
    versions.commit(spark, root, {"documents": docs, "translations": texts, "cache": cache})
    return key


def test_repair_of_pairs(spark, tmp_path):
    root = str(tmp_path / "vault")
    key = _stored(spark, root)
    fates = {r.slug: r.fate for r in pairs.repair_all(spark, root).collect()}
    assert fates == {"a": "repaired", "b": "refused", "c": "unchanged", "d": "unchanged", "e": "repaired"}
    now = versions.current(spark, root)
    assert {r.slug: r.body for r in now["documents"].collect()} == {"a": "细节*真的*很\n\ntwo", "b": "## T [#](#t)\n\nx", "c": "plain", "d": "plain", "e": "## T"}
    assert {r.extra for r in now["documents"].collect()} == {"x"} and {r.slug for r in now["translations"].collect()} == {"a", "b", "d"}
    assert {r.key: r.value for r in now["cache"].collect()} == {key("细节*真的*很"): "paid", key("two"): "zwei", key("plain"): "eben"}
    before = versions.manifest(spark, root).count()
    assert {r.fate for r in pairs.repair_all(spark, root).collect()} == {"unchanged", "refused"} and versions.manifest(spark, root).count() == before


def test_a_failed_half_leaves_the_old_pair(spark, tmp_path):
    root = str(tmp_path / "vault")
    _stored(spark, root)
    old = {n: sorted(map(tuple, t.collect())) for n, t in versions.current(spark, root).items()}
    bad = spark.range(1).select(F.raise_error(F.lit("disk full")).cast("string").alias("slug"))
    with pytest.raises(Exception, match="disk full"):
        versions.commit(spark, root, {"documents": spark.range(3), "translations": bad})
    assert {n: sorted(map(tuple, t.collect())) for n, t in versions.current(spark, root).items()} == old
    assert versions.current(spark, str(tmp_path / "none")) == {}
