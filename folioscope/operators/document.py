"""Markdown documents as rows of top-level blocks: one line after the other, in tasks, without a shuffle."""

import re
from bisect import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[[^\]\n]+\]:[ \t]*\S")
HTML = re.compile(r" {0,3}<(?:!--|/?[A-Za-z][\w-]*(?=[\s/>]|$))")


def opens_block(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    item = ITEM.match(line)
    return bool(HEADING.match(line) or RULE.match(line) or FENCE.match(line) or re.match(r" {0,3}>", line) or line.lstrip(" ").startswith("$$") or (item and item[3] and item[2] in ("-", "*", "+", "1.", "1)")))


def split_blocks(text: str | None) -> list[tuple[str, str]]:
    """Type and text of each top-level block, as CommonMark parts them; tables and display math are blocks too.

    A list is one block however loose it is: a blank line inside goes on with what is indented below an item, or with
    the next item of the same mark. A quote takes lazy lines. A fence ends with one at least as long, or with the text.
    Display math that nothing closes is prose.
    """
    lines = (text or "").split("\n")
    out: list[tuple[str, str]] = []
    n = at = 0

    def take(kind: str, stop: int) -> None:
        nonlocal at
        while stop > at and not lines[stop - 1].strip():
            stop -= 1
        out.append((kind, "\n".join(lines[at:stop])))
        at = stop

    n = len(lines)
    closers = [k for k in range(n) if lines[k].rstrip().endswith("$$")]

    def _math_end(start: int) -> int:
        """Behind the line that closes display math; 0 where none does, and the line is prose."""
        own = lines[start].strip()
        if len(own) > 3 and own.endswith("$$"):
            return start + 1
        k = bisect(closers, start)
        return closers[k] + 1 if k < len(closers) else 0

    while at < n:
        line = lines[at]
        if not line.strip():
            at += 1
        elif fence := FENCE.match(line):
            mark = fence[1]
            close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            take("code", next((k + 1 for k in range(at + 1, n) if close.match(lines[k])), n))
        elif line.lstrip(" ").startswith("$$") and (stop := _math_end(at)):
            take("math", stop)
        elif re.match(r"(?: {4}|\t)", line):
            stop = at + 1
            while stop < n and (not lines[stop].strip() or re.match(r"(?: {4}|\t)", lines[stop])):
                stop += 1
            take("code", stop)
        elif HEADING.match(line):
            take("heading", at + 1)
        elif RULE.match(line):
            take("thematicBreak", at + 1)
        elif re.match(r" {0,3}>", line):
            stop = at + 1
            while stop < n and lines[stop].strip() and (re.match(r" {0,3}>", lines[stop]) or not opens_block(lines[stop])):
                stop += 1
            take("blockquote", stop)
        elif item := ITEM.match(line):
            take("list", _list_end(lines, at, item))
        elif HTML.match(line):
            end = "-->" if line.lstrip().startswith("<!--") else None
            stop = next((k + 1 for k in range(at, n) if end in lines[k]), n) if end else next((k for k in range(at, n) if not lines[k].strip()), n)
            take("html", stop)
        elif at + 1 < n and "|" in line and DELIMITER.match(lines[at + 1]) and ("|" in lines[at + 1] or "|" in line.strip()[:1]):
            stop = at + 2
            while stop < n and lines[stop].strip() and not opens_block(lines[stop]):
                stop += 1
            take("table", stop)
        elif DEFINITION.match(line):
            take("definition", at + 1)
        else:
            stop = at + 1
            while stop < n and lines[stop].strip() and not opens_block(lines[stop]) and not UNDERLINE.match(lines[stop]):
                stop += 1
            under = stop < n and UNDERLINE.match(lines[stop])
            take("heading" if under else "paragraph", stop + 1 if under else stop)
    return out


def _list_end(lines: list[str], at: int, item: re.Match) -> int:
    """Where a list ends: at a line that is neither indented under an item, nor another item of its mark, nor lazy."""
    mark = item[2][-1]
    indent, stop, blank, fence = item.end() if item[3] else item.end() + 1, at + 1, False, None
    opened = FENCE.match(lines[at][item.end() :])
    fence = opened[1] if opened else None
    while stop < len(lines):
        line = lines[stop]
        if not line.strip():
            blank = True
        else:
            own = len(line) - len(line.lstrip(" "))
            if own >= min(indent, item.start(2) + 5):
                inner = FENCE.match(line[min(own, indent) :])
                if inner:
                    fence = inner[1] if fence is None else None if inner[1].startswith(fence) else fence
            elif (other := ITEM.match(line)) and other[2][-1] == mark and not RULE.match(line):
                indent, fence = other.end() if other[3] else other.end() + 1, None
            elif blank or fence or opens_block(line) or other:
                break
            blank = False
        stop += 1
    return stop


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, type and text: a row for each top-level block. Null and blank texts have none; other columns aren't read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"type": k, "text": t} for k, t in split_blocks(text)] for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())])))], ["doc_id", "blocks"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, blocks array<struct<type:string,text:string>>")
    return found.select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.type", "b.text")


def with_pictures_outdented(parts: DataFrame) -> DataFrame:
    """Blocks (doc_id, pos, type, text) in which indented code of nothing but pictures is a paragraph of them."""
    only = (F.col("type") == "code") & F.col("text").rlike(r"\A(?:(?: {4}|\t)[ \t]*!\[[^\]\n]*\]\([^)\n]+\)[ \t]*(?:\n|\z))+\z")
    return parts.select("doc_id", "pos", F.when(only, "paragraph").otherwise(F.col("type")).alias("type"), F.when(only, F.regexp_replace("text", r"(?m)^[ \t]+|[ \t]+$", "")).otherwise(F.col("text")).alias("text"))


def with_links_inlined(parts: DataFrame) -> DataFrame:
    """Blocks (doc_id, pos, type, text) with reference links of their document's definitions inlined; definitions go.

    Labels are matched without case. Of two definitions of a label the first counts.
    """
    label = lambda c, g: F.lower(F.regexp_replace(F.trim(F.regexp_extract(c, g, 1)), r"\s+", " "))
    known = parts.where("type = 'definition'").select("doc_id", "pos", label(F.col("text"), r"^ {0,3}\[([^\]]+)\]:").alias("label"), F.regexp_extract("text", r"\]:[ \t]*<?([^\s>]+)", 1).alias("target"))
    maps = known.groupBy("doc_id", "label").agg(F.min_by("target", "pos").alias("target")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "target"))).alias("targets"))
    joined = parts.where("type <> 'definition'").join(maps, "doc_id", "left")
    pattern = r"\[[^\]\n]+\]\[[^\]\n]*\]"
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)

    def inlined(use):
        shown, named = F.regexp_extract(use, r"^\[([^\]]+)\]", 1), F.regexp_extract(use, r"\]\[([^\]]*)\]$", 1)
        key = F.lower(F.regexp_replace(F.trim(F.when(named == "", shown).otherwise(named)), r"\s+", " "))
        return F.coalesce(F.concat(F.lit("["), shown, F.lit("]("), F.try_element_at("targets", key), F.lit(")")), use)

    text = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, use: F.concat(gap, inlined(use))), ""), F.element_at(gaps, -1))
    return joined.select("doc_id", "pos", "type", F.when(F.col("targets").isNull() | (F.col("type") == "code"), F.col("text")).otherwise(text).alias("text"))
