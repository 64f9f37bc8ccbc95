"""Repairs of Markdown that change prose only, and masks of what must not change. Each repair is idempotent."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCED = r"(?ms)^(?:```|~~~)[^\n]*\n.*?(?:^(?:```|~~~)[ \t]*$|\z)"
_MASKED = r"(?s)```.*?```|`[^`\n]+`|\$\$.+?\$\$|\$[^$\n]+\$|(?<=\]\()[^)\s]+"


def outside_code(text: Column, change) -> Column:
    """change(prose) on all text outside of fenced code."""
    codes = F.regexp_extract_all(text, F.lit(_FENCED), F.lit(0))
    prose = F.transform(F.split(text, _FENCED, -1), change)
    return F.array_join(F.transform(prose, lambda p, i: F.concat(p, F.coalesce(F.get(codes, i), F.lit("")))), "")


_SPLIT_LINK = r"(?s)\[\n[ \t]*\n(.*?)\n[ \t]*\n\]\("


def split_links(prose: Column) -> Column:
    """A link whose content stands between blank lines inside its brackets, on one line; other line breaks stay."""
    inner = F.regexp_extract_all(prose, F.lit(_SPLIT_LINK), F.lit(1))
    one_line = lambda text: F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    joined = F.transform(F.split(prose, _SPLIT_LINK, -1), lambda gap, i: F.concat(gap, F.coalesce(F.concat(F.lit("["), one_line(F.get(inner, i)), F.lit("](")), F.lit(""))))
    return F.when(prose.rlike(_SPLIT_LINK), F.array_join(joined, "")).otherwise(prose)


def split_footnotes(prose: Column) -> Column:
    """A footnote's escaped bracket that a blank line parts from its number."""
    return F.regexp_replace(prose, r"(\\\[)\n[ \t]*\n(?=\d+\\\])", "$1")


def link_titles(prose: Column) -> Column:
    """White space in a link's title as single spaces."""
    return F.regexp_replace(prose, r'(\]\(\S+ "[^"\n]*)\s*\n\s*([^"\n]*"\))', "$1 $2")


def table_headers(prose: Column) -> Column:
    """A table's first row of data in the place of its empty header."""
    return F.regexp_replace(prose, r"(?m)^\|(?:[ \t]*\|)+[ \t]*\n(\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*)\n(\|[^\n]*)", "$2\n$1")


def list_markers(prose: Column) -> Column:
    """A marker that the item's text repeats, such as '1. (1) text', once."""
    return F.regexp_replace(prose, r"(?m)^([ \t]*(\d+)[.)] )\(?\2[.)][ \t]+", "$1")


def heading_anchors(prose: Column) -> Column:
    """Headings without the link to themselves."""
    return F.regexp_replace(prose, r"(?m)^(#{1,6} .*?)[ \t]*\[(?:#|¶|)\]\(#[^)]*\)[ \t]*$", "$1")


def body(text: Column) -> Column:
    def change(prose: Column) -> Column:
        for step in (link_titles, split_links, split_footnotes, table_headers, list_markers, heading_anchors):
            prose = step(prose)
        return prose

    return outside_code(text, change)


def masked(text: Column) -> Column:
    """struct<text, spans>: math, code and destinations as numbered tokens."""
    spans = F.regexp_extract_all(text, F.lit(_MASKED), F.lit(0))
    gaps = F.split(text, _MASKED, -1)
    tokens = F.transform(gaps, lambda g, i: F.when(i < F.size(spans), F.concat(g, F.lit("⟦"), i.cast("string"), F.lit("⟧"))).otherwise(g))
    return F.struct(F.array_join(tokens, "").alias("text"), spans.alias("spans"))


def unmasked(text: Column, spans: Column) -> Column:
    """The text with its spans again; null if a token is missing, twice or unknown."""
    found = F.transform(F.regexp_extract_all(text, F.lit("⟦([0-9]+)⟧"), F.lit(1)), lambda n: n.cast("int"))
    whole = F.array_sort(found).eqNullSafe(F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.size(spans) - 1)).otherwise(F.array().cast("array<int>")))
    gaps = F.split(text, "⟦[0-9]+⟧", -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(spans, F.get(found, i)), F.lit("")))), "")
    return F.when(whole, joined)
