"""Emphasis in Markdown as CommonMark reads it, and underscores beside CJK letters, which it can't read, as asterisks.

A segment (a paragraph, an item's line and what it goes on with, a cell) is read in three steps: what isn't prose is
masked; runs of delimiters are matched with a stack, the label of each link for itself; the underscores that are left
over are paired within their line. A pair becomes asterisks only if the stack then matches exactly what it matched
before and the new pairs. Everything happens in tasks, a document at a time, in time proportional to its length.
"""

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.document import FENCE, HEADING, ITEM, split_blocks

#: Scripts without spaces between words.
SCRIPTS = ("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC ITERATION", "IDEOGRAPHIC NUMBER")
LONGEST_RUN = 3
#: Fixed value: characters of texts that are strings of Python at a time, about; a longer text is one piece.
PIECE = 1 << 20
#: What isn't prose: escapes, code, math, tags and autolinks, bare addresses, destinations and references of links.
NOT_PROSE = re.compile(
    r"\\[!-/:-@\[-`{-~]|(?<!`)(?P<tick>`+)(?!`)[^`](?:.*?[^`])?(?P=tick)(?!`)|\$\$.+?\$\$|\$[^\s$](?:[^$\n]*[^\s$])?\$|<[A-Za-z/!?][^<>]*>|(?:https?://|www\.)[^\s<]*"
    r"|(?<=\])\((?:[^()\\\n]|\\.|\([^()\n]*\))*\)|(?<=\])\[[^\]\n]*\]",
    re.DOTALL,
)


def is_cjk(char: str) -> bool:
    return char > "\u1100" and unicodedata.name(char, "").startswith(SCRIPTS)


def segments(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Where the prose of a block begins and ends, piece by piece; emphasis never reaches from one to the next."""
    if kind in ("code", "math", "html", "definition", "thematicBreak"):
        return
    at, begin, fence = 0, None, None
    for line in text.split("\n"):
        bare = re.sub(r"^(?:[ \t]*>)+[ ]?", "", line) if kind == "blockquote" else line
        item = ITEM.match(bare.lstrip(" ")) if kind in ("list", "blockquote") else None
        opened = FENCE.match(bare.lstrip(" ")[item.end() if item else 0 :].lstrip(" "))
        if fence is not None or opened or not bare.strip() or item or kind == "table" or HEADING.match(bare):
            if begin is not None:
                yield begin, at - 1
            begin = None
        if kind == "table":
            yield from ((at + m.start(), at + m.end()) for m in re.finditer(r"(?:\\.|`[^`\n]*`|[^|\\])+", line))
        elif opened and fence is None:
            fence = opened[1]
        elif fence is not None:
            fence = None if opened and opened[1].startswith(fence) else fence
        elif bare.strip() and begin is None:
            begin = at
        at += len(line) + 1
    if begin is not None:
        yield begin, at - 1


class Segment:
    """A piece of prose: which characters are masked, the link label that each stands in, and the matched delimiters."""

    def __init__(self, text: str):
        self.text = text
        self.masked = bytearray(len(text))
        for m in NOT_PROSE.finditer(text):
            self.masked[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        self.flow = self._flows()
        self.pairs = self._matched()

    def _flows(self) -> list[int]:
        """The number of the innermost label around each character, 0 outside of labels."""
        flow, opened, n = [0] * len(self.text), [], 0
        for m in re.finditer(r"[\[\]]", self.text):
            at = m.start()
            if self.masked[at]:
                continue
            if m[0] == "[":
                opened.append(at)
            elif opened:
                start = opened.pop()
                if self.text[at + 1 : at + 2] in ("(", "[") and self.masked[at + 1]:
                    n += 1
                    for k in range(start, at + 1):
                        flow[k] = flow[k] or n
        return flow

    def runs(self, marks: str, free: bytearray | None = None) -> list[tuple[int, int]]:
        """Runs of one of the marks outside of masks, by where they begin and end."""
        hidden = self.masked if free is None else free
        out = []
        for m in re.finditer("|".join(f"{re.escape(c)}+" for c in marks), self.text):
            at = m.start()
            for k in range(m.start(), m.end() + 1):
                if k == m.end() or hidden[k]:
                    if k > at:
                        out.append((at, k))
                    at = k + 1
        return out

    def flanks(self, start: int, end: int) -> tuple[bool, bool]:
        """Whether a run may open and may close emphasis."""
        before, after = self.text[start - 1 : start] or " ", self.text[end : end + 1] or " "
        space = before.isspace(), after.isspace()
        sign = tuple(unicodedata.category(c)[0] in "PS" for c in (before, after))
        left = not space[1] and (not sign[1] or space[0] or sign[0])
        right = not space[0] and (not sign[0] or space[1] or sign[1])
        if self.text[start] == "*":
            return left, right
        return left and (not right or sign[0]), right and (not left or sign[1])

    def _matched(self) -> set[tuple[int, int, int]]:
        """Matched delimiters: where the opening and the closing one stand, and how long they are (1 or 2)."""
        out: set[tuple[int, int, int]] = set()
        by_flow: dict[int, list[tuple[int, int]]] = {}
        for run in self.runs("*_"):
            by_flow.setdefault(self.flow[run[0]], []).append(run)
        for runs in by_flow.values():
            openers: list[list] = []
            floor: dict[tuple, int] = {}
            for start, end in runs:
                mark, (opens, closes), length = self.text[start], self.flanks(start, end), end - start
                at = start
                while closes and at < end:
                    key = (mark, opens, length % 3)
                    found = None
                    for k in range(len(openers) - 1, floor.get(key, 0) - 1, -1):
                        o = openers[k]
                        thirds = (o[4] or opens) and (o[3] + length) % 3 == 0 and not (o[3] % 3 == 0 and length % 3 == 0)
                        if o[0] == mark and not thirds:
                            found = k
                            break
                    if found is None:
                        floor[key] = len(openers)
                        break
                    o = openers[found]
                    del openers[found + 1 :]
                    floor = {k: min(v, found + 1) for k, v in floor.items()}
                    size = 2 if o[2] - o[1] >= 2 and end - at >= 2 else 1
                    out.add((o[2] - size, at, size))
                    o[2] -= size
                    at += size
                    if o[1] == o[2]:
                        openers.pop()
                if opens and at < end:
                    openers.append([mark, at, end, length, closes])
        return out


def _outside(text: str, start: int, end: int) -> tuple[str, str]:
    return text[start - 1 : start] if start else "", text[end : end + 1]


def _is_meant(segment: Segment, start: int, stop: int, length: int) -> bool:
    """Whether underscores around text[start + length : stop] are emphasis but for the CJK letters beside them."""
    text = segment.text
    inner = text[start + length : stop]
    if not inner or inner[0].isspace() or inner[-1].isspace():
        return False
    beside = _outside(text, start, stop + length)
    if not any(c and is_cjk(c) for c in beside):
        return False
    if any(map(is_cjk, inner)):
        return True
    left, right = (" " if c in ("", "\n", "\r") or is_cjk(c) else c for c in beside)
    alone = Segment(f"a{left}{text[start : stop + length]}{right}b")
    return any(a - n + size <= 1 + len(left) <= a for a, _, size in alone.pairs for n in (length,))


def _candidates(segment: Segment) -> list[tuple[int, int, int]]:
    """Pairs of underscores that the stack left over and that are meant as emphasis."""
    text, used = segment.text, bytearray(segment.masked)
    for a, b, size in segment.pairs:
        used[a : a + size] = used[b : b + size] = b"\1" * size
    runs = segment.runs("_", used)
    opened = [(a, segment.flow[a]) for a, _, _ in segment.pairs if text[a] == "_"]

    def next_on_line(k: int) -> bool:
        between = text[runs[k][1] : runs[k + 1][0]] if k + 1 < len(runs) else "\n"
        return "\n" not in between and "\r" not in between

    out, k = [], 0
    while k < len(runs) - 1:
        (start, end), (stop, last) = runs[k], runs[k + 1]
        length, flow = end - start, segment.flow[start]
        fits = next_on_line(k) and last - stop == length <= LONGEST_RUN and segment.flow[stop] == flow
        fits = fits and not any(start < a < stop and f == flow for a, f in opened)
        if fits and any(used[end:stop]) and k + 2 < len(runs) and next_on_line(k + 1):
            # Across code or a link, a nearer pair of the same run goes first.
            third, beyond = runs[k + 2]
            fits = any(used[last:third]) or beyond - third != length or not _is_meant(segment, stop, third, length)
        if fits and _is_meant(segment, start, stop, length):
            out.append((start, stop, length))
            k += 1
        k += 1
    return out


def _swapped(text: str, pairs: list[tuple[int, int, int]]) -> str:
    chars = list(text)
    for a, b, n in pairs:
        chars[a : a + n] = chars[b : b + n] = "*" * n
    return "".join(chars)


def _parts(pairs: Iterable[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """A pair of three is one of two within one of one."""
    return {p for a, b, n in pairs for p in ([(a, b + 2, 1), (a + 1, b, 2)] if n == 3 else [(a, b, n)])}


def repaired_segment(text: str) -> str:
    if "_" not in text or text.isascii():
        return text
    before = Segment(text)
    pairs = _candidates(before)

    def holds(chosen: list[tuple[int, int, int]]) -> bool:
        after = Segment(_swapped(text, chosen))
        return after.masked == before.masked and after.pairs == before.pairs | _parts(chosen)

    if not pairs or holds(pairs):
        return _swapped(text, pairs)
    chosen: list[tuple[int, int, int]] = []
    for pair in pairs:
        if holds([*chosen, pair]):
            chosen.append(pair)
    return _swapped(text, chosen)


def _placed(text: str) -> Iterator[tuple[str, int, str]]:
    """Blocks with where they begin."""
    at = 0
    for kind, block in split_blocks(text):
        at = text.index(block, at)
        yield kind, at, block
        at += len(block)


def repaired(text: str | None) -> str | None:
    """The text with emphasis beside CJK letters in asterisks; as long as before, and a second time it stays as it is."""
    if not text or "_" not in text or text.isascii():
        return text
    out, last = [], 0
    for kind, at, block in _placed(text):
        for a, b in segments(kind, block):
            out += [text[last : at + a], repaired_segment(block[a:b])]
            last = at + b
    new = "".join([*out, text[last:]])
    return new if [k for k, _ in split_blocks(new)] == [k for k, _ in split_blocks(text)] else text


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """Every emphasis: where it opens and closes, in code points, and 1, or 2 for a strong one; in order."""
    found = [(at + a + x, at + a + y, size) for kind, at, block in _placed(text or "") for a, b in segments(kind, block) for x, y, size in Segment(block[a:b]).pairs]
    return sorted(found)


def pieces(batches: Iterable[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded bytes of text, without a copy: memory is a slice and a batch, however many rows come."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def with_cjk_emphasis(docs: DataFrame) -> DataFrame:
    """doc_id and text, repaired. Nulls stay null; equal rows are treated alike; columns besides the two aren't read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([repaired(t) for t in batch["text"].to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


def emphasised(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop and level: a row for each emphasis, with what it opens at and closes at, from 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [(d, *s) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for s in spans_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "stop", "level"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, stop long, level long")
