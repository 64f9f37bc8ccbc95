import random

from pyspark.sql import functions as F

from folioscope.operators import document, library, maintenance, ranks, terms


def test_numbers_within_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, rng.randrange(50)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, v int, i int")
    want, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        want[i] = seen[g] = seen.get(g, -1) + 1
    got = ranks.numbered(df, "g", F.struct("v", "i"))
    assert got.columns == ["g", "v", "i", "position"] and {r.i: r.position for r in got.collect()} == want
    assert sorted(r.position for r in ranks.numbered(df, None, F.struct("v", "i")).collect()) == list(range(900))
    assert ranks.numbered(df.limit(0), "g", F.struct("v", "i")).count() == 0


def test_mates(spark):
    left = spark.createDataFrame([("a", 3), ("a", 1), ("b", 5), (None, 9), ("c", 1)], "k string, pos int")
    right = spark.createDataFrame([("a", 7), ("b", 2), ("b", 1), ("d", 1), (None, 4)], "k string, pos int")
    got = {(r.k, r.left, r.right) for r in ranks.mates(left, right, "k", "pos").collect()}
    assert got == {("a", 1, 7), ("a", 3, None), ("b", 5, 1), ("b", None, 2), ("c", 1, None), ("d", None, 1), (None, 9, None), (None, None, 4)}


def test_one_day_of_many_documents(spark):
    docs = spark.range(500).select(F.col("id").alias("slug"), F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.lit(5))).alias("at"), (F.col("id") % 3).alias("g"))
    got = library.numbered(docs, "at", "slug").collect()
    assert {r.slug: r.position for r in got} == {s: n for n, s in enumerate([*range(0, 500, 2), *range(1, 500, 2)])}
    assert [r.slug for r in library.page(docs, "at", "slug", 42).collect()] == [*range(485, 500, 2)]
    near = {r.slug: (r.newer, r.older) for r in library.neighbours(docs, "at", "slug", "g").collect()}
    assert near[6] == (0, 12) and near[498] == (492, 3) and near[0] == (None, 6)


def test_unclosed_math_is_prose():
    kinds = lambda text: [k for k, _ in document.split_blocks(text)]
    assert kinds("$$\na\n\nb\n\nc") == ["paragraph"] * 3 and kinds("$$\na\n$$\n\nb") == ["math", "paragraph"] and kinds("$$a$$\n\nb") == ["math", "paragraph"]
    assert kinds("$$\n\n" * 5000 + "$$ x")[-1] == "paragraph"


def test_chips_by_collation(spark):
    rows = spark.createDataFrame([("b", 2), ("B", 2), ("a", 2), ("中文", 2), ("阿", 2), ("z", 5)], "label string, n long")
    got = {r.label: r.position for r in terms.chips(rows, shown=2).collect()}
    order = sorted(got, key=got.get)
    assert order[0] == "z" and order.index("a") < order.index("b") < order.index("B") < order.index("阿") < order.index("中文")
    assert sum(r.first for r in terms.chips(rows, shown=2).collect()) == 2


def test_moves(spark):
    items = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "c"), (3, 0, "x")], "collection long, pos long, slug string")
    moves = spark.createDataFrame([("a", "b"), ("c", "b")], "slug string, new_slug string")
    assert sorted(map(tuple, maintenance.followed(items, moves).collect())) == [(1, 1, "b"), (2, 0, "b"), (3, 0, "x")]


def test_ranges_are_found_by_halving(spark):
    cuts = [[], [3], list(range(0, 400, 2)), [1] * 5 + [7] * 60, list(range(1000))]
    rows = [(c, v) for c in cuts for v in (-1, 0, 1, 2, 3, 7, 199, 398, 399, 1000)]
    got = spark.createDataFrame(rows, "c array<int>, v int").select("c", "v", ranks._below("c", F.col("v")).alias("n")).collect()
    assert all(r.n == sum(x < r.v for x in r.c) for r in got)
    placed = ranks.ranged(spark.range(2000), None, F.struct("id"))
    assert "filter(_cuts" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert [r[0] for r in placed.orderBy("id").select("_range").collect()] == sorted(r[0] for r in placed.select("_range").collect())
