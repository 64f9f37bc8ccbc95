"""Pages of positioned text in reading order: columns by recursive cuts at gutters, lines by baselines, cells as tables.

Runs are (doc, page, x, y, width, size, text), y growing upwards. A page is one group, so memory is a page. Lines
with a run as wide as most of a region, such as a title over two columns, part it into bands, which are read one after
the other; a band is cut at its widest gutter, and its left part is read before the right one, each cut on.
"""

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A gutter's least width, the share of a region's width that parts it into bands, and lines on each side, at least.
GUTTER, SPANS, LINES = 12.0, 0.6, 3
#: Baselines and starts of cells that differ by no more are the same; a gap between cells, in sizes of the text.
SAME_LINE, SAME_START, CELL_GAP = 2.0, 3.0, 1.5
#: Rows of a table, at least; characters of a cell, at most, where two sides of a gap share their baselines.
ROWS, CELL = 3, 24

NAMES, KINDS = ["doc", "page", "pos", "kind", "text"], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

Run = tuple[float, float, float, float, str]  # x, y, width, size, text


def lines(runs: list[Run]) -> list[list[Run]]:
    """Runs by baseline, from the top; each line from the left."""
    out: list[list[Run]] = []
    for run in sorted(runs, key=lambda r: (-r[1], r[0])):
        if out and out[-1][0][1] - run[1] <= SAME_LINE:
            out[-1].append(run)
        else:
            out.append([run])
    return [sorted(line) for line in out]


def gutter(runs: list[Run]) -> tuple[float, float] | None:
    """The widest gap between columns of a region, or None where it has but one."""
    left = min(r[0] for r in runs)
    best, end = None, left
    by_start = sorted(runs)
    for run in by_start:
        if run[0] - end >= GUTTER and (best is None or run[0] - end > best[1] - best[0]) and end > left:
            best = (end, run[0])
        end = max(end, run[0] + run[2])
    if best is None:
        return None
    sides = [lines([r for r in by_start if (r[0] >= best[1]) == k]) for k in (False, True)]
    if min(map(len, sides)) < LINES:
        return None
    # Short cells that share their baselines are a table's, not columns'.
    bases = [[line[0][1] for line in side] for side in sides]
    other = sorted(bases[1])
    shared = sum(any(abs(a - b) <= SAME_LINE for b in other[max(k - 1, 0) : k + 1]) for a in bases[0] for k in [bisect_left(other, a)])
    short = median(sum(len(r[4]) for r in line) for side in sides for line in side) <= CELL
    return None if short and shared >= 0.8 * min(map(len, sides)) else best


def regions(runs: list[Run]) -> Iterator[list[Run]]:
    """Regions of one column each, in reading order."""
    todo = [runs] if runs else []
    while todo:
        region = todo.pop()
        groups = lines(region)
        wide = SPANS * (max(r[0] + r[2] for r in region) - min(r[0] for r in region))
        parts: list[list[Run]] = [[]]
        for line in groups:
            if any(r[2] >= wide for r in line):
                parts += [line, []]
            else:
                parts[-1].extend(line)
        parts = [p for p in parts if p]
        if len(parts) == 1:
            cut = gutter(region) if len(groups) > 1 else None
            if cut is None:
                yield region
                continue
            parts = [[r for r in region if r[0] < cut[1]], [r for r in region if r[0] >= cut[1]]]
        todo += reversed(parts)


def cells(line: list[Run]) -> list[tuple[float, str]]:
    """A line's cells, by where they start: runs that stand closer than a gap are one."""
    out: list[list] = []
    for x, _, width, size, text in line:
        if out and x - out[-1][2] < CELL_GAP * size:
            out[-1][1], out[-1][2] = f"{out[-1][1]} {text}".replace("  ", " "), x + width
        else:
            out.append([x, text, x + width])
    return [(x, text) for x, text, _ in out]


def blocks(runs: list[Run]) -> list[tuple[str, str]]:
    """Kind (line or table) and text of a page's blocks in reading order."""
    out: list[tuple[str, str]] = []

    def close(rows: list[list[tuple[float, str]]]) -> None:
        if len(rows) >= ROWS:
            marked = [f"| {' | '.join(t.strip().replace('|', chr(92) + '|') for _, t in row)} |" for row in rows]
            out.append(("table", "\n".join([marked[0], f"|{' --- |' * len(rows[0])}", *marked[1:]])))
        else:
            out.extend(("line", " ".join(t for _, t in row)) for row in rows)

    for region in regions(runs):
        rows: list[list[tuple[float, str]]] = []
        for line in lines(region):
            row = cells(line)
            if rows and not (len(row) == len(rows[0]) > 1 and all(abs(a[0] - b[0]) <= SAME_START for a, b in zip(row, rows[0]))):
                close(rows)
                rows = []
            if len(row) > 1:
                rows.append(row)
            else:
                out.append(("line", row[0][1]))
        close(rows)
    return out


def in_reading_order(runs: DataFrame) -> DataFrame:
    """doc, page, pos, kind and text: a row for each line, and one for each table as Markdown. Blank and null runs are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted, so a page's are next to each other; only a page and the rows found in a batch are held.
        at, page, out = None, [], []

        def close() -> None:
            out.extend((*at, pos, kind, text) for pos, (kind, text) in enumerate(blocks(page)))
            page.clear()

        def found() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(KINDS)], NAMES)
            out.clear()
            return rows

        for batch in batches:
            for doc, nth, *values, text in zip(*(column.to_pylist() for column in batch.columns)):
                if at != (doc, nth):
                    if page:
                        close()
                    at = (doc, nth)
                if text and text.strip():
                    page.append((*values, text))
            yield found()
        if page:
            close()
        yield found()

    numbers = [F.col(c).cast("double") for c in ("x", "y", "width", "size")]
    rows = runs.select(F.col("doc").cast("long"), F.col("page").cast("long"), *numbers, F.col("text").cast("string")).repartition("doc", "page").sortWithinPartitions("doc", "page")
    return rows.mapInArrow(run, "doc long, page long, pos long, kind string, text string")
