from folioscope.operators import layout


def column(x, texts, top=700.0, width=200.0):
    return [(x, top - 12 * i, width, 10.0, t) for i, t in enumerate(texts)]


def test_two_columns_under_a_title():
    right, left = ([f"{k}{i} a line that fills its column" for i in range(4)] for k in "rl")
    runs = column(320, right) + column(60, left) + [(60, 730, 460, 16, "Title"), (60, 600, 460, 10, "Foot")]
    assert [t for _, t in layout.blocks(runs)] == ["Title", *left, *right, "Foot"]


def test_three_columns_and_bands():
    runs = [r for x in (0, 150, 300) for r in column(x, [f"{x} line {i} of a long column" for i in range(4)], width=120)] + [(0, 640, 420, 10, "across")]
    runs += [r for x in (0, 220) for r in column(x, [f"{x} below {i} of a long column" for i in range(3)], top=600, width=180)]
    got = [t for _, t in layout.blocks(runs)]
    assert got == [f"{x} line {i} of a long column" for x in (0, 150, 300) for i in range(4)] + ["across"] + [f"{x} below {i} of a long column" for x in (0, 220) for i in range(3)]


def test_tables_and_baselines():
    rows = [[("k", 60), ("v|w", 200), ("n", 340)], [("a", 60), ("1", 201), ("2", 340)], [("b", 61), ("3", 200), ("4", 341)]]
    runs = [(x, 500 - 14 * i + (i % 2), 30, 10.0, t) for i, row in enumerate(rows) for t, x in row] + [(60, 520, 40, 10.0, "Some"), (104, 520.5, 60, 10.0, "prose")]
    assert layout.blocks(runs) == [("line", "Some prose"), ("table", "| k | v\\|w | n |\n| --- | --- | --- |\n| a | 1 | 2 |\n| b | 3 | 4 |")]


def test_awkward_pages(spark):
    assert layout.blocks([]) == [] and layout.blocks([(0, 0, 5, 1, "one")]) == [("line", "one")]
    assert len(layout.blocks(column(60, [str(i) for i in range(20000)]))) == 20000
    rows = [(1, 1, 60.0, 10.0, 5.0, 10.0, "b"), (1, 1, 60.0, 30.0, 5.0, 10.0, "a"), (1, 2, 0.0, 0.0, 0.0, 0.0, None), (1, 1, 60.0, 10.0, 5.0, 10.0, "b")]
    got = layout.in_reading_order(spark.createDataFrame(rows, "doc long, page long, x double, y double, width double, size double, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, "line", "a"), (1, 1, 1, "line", "b b")]


def test_long_columns_share_baselines_only_within_reach():
    """Above 400 lines too, baselines count as shared by their distance: these lie just within it."""
    cells = lambda x, top: [(x, top - 12.0 * i, 30.0, 10.0, f"{x} {i}") for i in range(450)]
    assert layout.gutter(cells(60.0, 9000.9) + cells(200.0, 8999.1)) is None
    assert layout.gutter(cells(60.0, 9000.0) + cells(200.0, 8996.0)) == (90.0, 200.0)


def test_pages_are_read_without_a_table_for_each(spark):
    rows = [(d, p, 60.0, -12.0 * i, 100.0, 10.0, f"{d} {p} {i}") for d in range(40) for p in (1, 2) for i in range(30)] + [(None, 1, 0.0, 0.0, 1.0, 1.0, "no doc"), (99, 1, 0.0, 0.0, 1.0, 1.0, " ")]
    runs = spark.createDataFrame(rows[::-1], "doc long, page long, x double, y double, width double, size double, text string").repartition(7, "x", "y")
    read = layout.in_reading_order(runs)
    assert "FlatMapGroupsInPandas" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, read.collect()), key=str) == sorted([(d, p, -int(y / 12), "line", t) for d, p, _, y, _, _, t in rows[:-1]], key=str)
