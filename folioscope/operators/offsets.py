"""Where things stand inside pages and texts, in code points: addresses in tags, and what isn't prose, at any depth.

A page's tags are read by a small state machine over its marks; a text's ranges come from its blocks, so code in a list
or quote is found as well. Points are looked up in sorted ranges by halving, not one by one. All of it happens in tasks,
a row at a time, in time proportional to its length.
"""

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.document import FENCE, split_blocks
from folioscope.operators.emphasis import NOT_PROSE

#: Attributes whose values are addresses.
ADDRESSES = ("href", "src", "srcset")
_SPACE = " \t\n\r\f"
_OPENING = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?](?:[^>]*>|[^>]*\Z)|</?[A-Za-z][^\s/>]*", re.DOTALL)
_ATTRIBUTE = re.compile(r"""[\s/]*(?P<name>[^\s/>=]+|=(?=[^\s/>=]))(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:"(?P<double>[^"]*)(?:"|\Z)|'(?P<single>[^']*)(?:'|\Z)|(?P<bare>[^ \t\n\r\f>]*)))?""")
_CANDIDATE = re.compile(rf"[{_SPACE},]*([^{_SPACE}]+)")


def addresses(html: str | None) -> list[tuple[str, int, int]]:
    """Name, start and end of every address in a tag; srcset gives one for each of its candidates. Comments have none."""
    text, at, out = html or "", 0, []
    while opening := _OPENING.search(text, at):
        at = opening.end()
        if opening[0][:2] in ("<!", "<?"):
            continue
        while attribute := _ATTRIBUTE.match(text, at):
            at = attribute.end()
            name = attribute["name"].lower()
            group = next((g for g in ("double", "single", "bare") if attribute[g] is not None), None)
            if name not in ADDRESSES or group is None:
                continue
            start, end = attribute.span(group)
            out += [(name, start + a, start + b) for a, b in candidates(text[start:end])] if name == "srcset" else [(name, start, end)]
        # What is left of the tag is white space, slashes and its end.
        close = re.compile(r"[\s/]*>?").match(text, at)
        at = close.end()
    return out


def candidates(srcset: str) -> list[tuple[int, int]]:
    """Start and end of each address of a srcset: one ends at white space; commas at its end end the candidate as well."""
    at, out = 0, []
    while found := _CANDIDATE.match(srcset, at):
        start, end = found.span(1)
        bare = len(found[1].rstrip(","))
        if bare:
            out.append((start, start + bare))
        comma = srcset.find(",", end)
        at = end if bare < len(found[1]) else comma + 1 if comma >= 0 else len(srcset)
    return out


def ranges(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end of code, math, html and link targets at any depth, in order; none inside another."""
    out: list[tuple[str, int, int]] = []
    at = 0
    for kind, block in split_blocks(text):
        at = (text or "").index(block, at)
        if kind in ("code", "math", "html"):
            out.append((kind, at, at + len(block)))
        else:
            out += [(k, at + a, at + b) for k, a, b in _within(block)]
        at += len(block)
    return out


def _within(block: str) -> Iterator[tuple[str, int, int]]:
    """Ranges inside a block of prose: fences of its items and quotes first, then what the lines between them have."""
    at, begin, fence, opened = 0, 0, None, 0
    for line in block.split("\n"):
        bare = re.sub(r"^(?:[ \t]*(?:>[ ]?|(?:[-*+]|\d{1,9}[.)])[ \t]+))*[ \t]*", "", line) if fence is None else re.sub(r"^[ \t>]*", "", line)
        mark = FENCE.match(bare)
        if mark and fence is None:
            yield from _inline(block, begin, at)
            fence, opened = mark[1], at + len(line) - len(bare)
        elif mark and mark[1].startswith(fence or "\0") and not bare[len(mark[0]) :].strip():
            yield "code", opened, at + len(line)
            fence, begin = None, at + len(line) + 1
        at += len(line) + 1
    if fence is not None:
        yield "code", opened, len(block)
    else:
        yield from _inline(block, begin, len(block))


def _inline(block: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    kinds = {"`": "code", "$": "math", "<": "html", "(": "target", "[": "target", "h": "target", "w": "target"}
    for m in NOT_PROSE.finditer(block, start, end):
        if m[0][0] in kinds:
            yield kinds[m[0][0]], m.start(), m.end()


def inside(points: Iterable[int], spans: list[tuple[int, int]]) -> list[bool]:
    """Which points lie in one of the spans, that are in order and don't overlap."""
    starts = [a for a, _ in spans]
    return [(k := bisect_right(starts, p) - 1) >= 0 and p < spans[k][1] for p in points]


def _rows(docs: DataFrame, key: str, column: str, of: Callable[[str | None], list[tuple[str, int, int]]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, n, k, a, b, t[a:b]) for d, t in zip(batch[key].to_pylist(), batch[column].to_pylist()) for n, (k, a, b) in enumerate(of(t))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "pos", "kind", "start", "stop", "value"])

    return docs.select(F.col(key).cast("long"), column).mapInArrow(run, f"{key} long, pos long, kind string, start long, stop long, value string")


def page_addresses(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind (the attribute), start, stop and value: a row for each address in a page's tags."""
    return _rows(pages, "page_id", "html", addresses)


def text_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, pos, kind, start, stop and value: a row for each range of a text that isn't prose."""
    return _rows(docs, "doc_id", "text", ranges)
