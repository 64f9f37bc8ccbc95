"""Markdown's top-level blocks as arrays, in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.spans import inside, matches
from folioscope.functions.tags import folded


def blocks(text: Column) -> Column:
    """array<struct<pos, type, text>>: fenced code is one block; elsewhere blank lines part blocks."""
    parts = F.regexp_extract_all(text, F.lit(r"(?ms)^(?:```|~~~)[^\n]*\n.*?(?:^(?:```|~~~)[ \t]*$|\z)|^(?!```|~~~)[^\n]*\S[^\n]*(?:\n(?!```|~~~)[^\n]*\S[^\n]*)*"), F.lit(0))
    return F.transform(parts, lambda b, i: F.struct(i.alias("pos"), kind(b).alias("type"), F.regexp_replace(b, r"\s+$", "").alias("text")))


def kind(block: Column) -> Column:
    return (
        F.when(block.rlike(r"^(?:```|~~~)"), "code")
        .when(block.rlike(r"^#{1,6}\s"), "heading")
        .when(block.rlike(r"^[^\n]+\n(?:=+|-+)[ \t]*$"), "heading")
        .when(block.rlike(r"^ {0,3}(?:[-*_][ \t]*){3,}$"), "thematicBreak")
        .when(block.rlike(r"^ {0,3}>"), "blockquote")
        .when(block.rlike(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])\s"), "list")
        .when(block.rlike(r"^ {0,3}\|?[^\n]*\|[^\n]*\n[ \t]*\|?[ \t:|-]*-[ \t:|-]*$|^ {0,3}\|?[^\n]*\|[^\n]*\n[ \t]*\|?[ \t:|-]*-[ \t:|-]*\n"), "table")
        .when(block.rlike(r"^ {0,3}\$\$"), "math")
        .when(block.rlike(r"^ {0,3}<[A-Za-z!/]"), "html")
        .otherwise("paragraph")
    )


def counts(text: Column) -> Column:
    """Images, links and captions of a document."""
    images = F.regexp_count(text, F.lit(r"!\[[^\]]*\]\([^)\s]+[^)]*\)"))
    linked = F.regexp_count(text, F.lit(r"(?<!!)\[[^\]]*\]\([^)\s]+[^)]*\)"))
    return F.struct(images.cast("long").alias("images"), linked.cast("long").alias("links"))


def repair_emphasis(text: Column) -> Column:
    """Spaces just inside of strong marks go, so that they mark again."""
    return F.regexp_replace(text, r"\*\*[ \t]+([^*\n]+?)[ \t]*\*\*|\*\*([^*\n]+?)[ \t]+\*\*", "**$1$2**")


CODE = r"(?ms)^(?:```|~~~)[^\n]*\n.*?(?:^(?:```|~~~)[ \t]*$|\z)|`[^`\n]+`"
MATH = r"(?s)\$\$.+?\$\$|(?<![\\$])\$(?![\s$])[^$\n]+?(?<![\s\\])\$(?!\d)"
LINK = r"!?\[[^\]\n]*\]\([^)\s]+(?:\s+\"[^\"\n]*\")?\)"


def code_ranges(text: Column) -> Column:
    return matches(text, CODE)


def math_ranges(text: Column) -> Column:
    """Math that stands outside of code."""
    codes = code_ranges(text)
    return F.filter(matches(text, MATH), lambda m: ~inside(m["start"], codes))


def links(text: Column) -> Column:
    """array<struct<start, end, image, label, target>> of inline links and images outside of code."""
    codes = code_ranges(text)
    found = F.filter(matches(text, LINK), lambda m: ~inside(m["start"], codes))
    return F.transform(found, lambda m: F.struct(m["start"], m["end"], m["value"].startswith("!").alias("image"), F.regexp_extract(m["value"], r"^!?\[([^\]]*)\]", 1).alias("label"), F.regexp_extract(m["value"], r"\]\(([^)\s]+)", 1).alias("target")))


def plain_text(text: Column) -> Column:
    """What a reader sees: no images, marks or targets; code and link labels stay."""
    out = text
    for pattern, by in (
        (r"(?m)^(?:```|~~~)[^\n]*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?i)<br\s*/?>", " "), (r"<[^>\n]+>", ""),
        (r"(?m)^ {0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d{1,9}[.)][ \t]+)", ""), (r"(\*\*|__|\*|`)(\S(?:[^\n]*?\S)?)\1", "$2"), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def joined(rows: Column) -> Column:
    """Blocks as one text: a blank line between them, one newline at the end."""
    return F.concat(F.regexp_replace(F.array_join(F.transform(rows, lambda b: b["text"]), "\n\n"), r"\s+$", ""), F.lit("\n"))


def alignment_errors(a: Column, b: Column) -> Column:
    """Why two versions' blocks don't pair up: another number, other types, code or math that was changed."""
    pairs = F.arrays_zip(F.slice(a, 1, F.least(F.size(a), F.size(b))).alias("a"), F.slice(b, 1, F.least(F.size(a), F.size(b))).alias("b"))
    number = F.when(F.size(a) != F.size(b), F.array(F.concat(F.size(a).cast("string"), F.lit(" blocks, "), F.size(b).cast("string")))).otherwise(F.array().cast("array<string>"))
    each = F.transform(pairs, lambda p, i: F.when(p["a"]["type"] != p["b"]["type"], F.concat(i.cast("string"), F.lit(": "), p["a"]["type"], F.lit(", "), p["b"]["type"])).when(p["a"]["type"].isin("code", "math") & (p["a"]["text"] != p["b"]["text"]), F.concat(i.cast("string"), F.lit(": changed"))))
    return F.concat(number, F.array_compact(each))


def is_image_only(block: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(block, r"!\[[^\]]*\]\([^)]*\)", ""), r"\s", "").eqNullSafe(F.lit("")) & block.contains("![")


def with_lead(body: Column, dek: Column, picture: Column) -> Column:
    """struct<kind, text>: the body with a missing opening sentence or picture in front; unchanged if both are there."""
    start = F.lower(F.regexp_replace(plain_text(body), r"[^\p{L}\p{N}]+", ""))
    wanted = F.lower(F.regexp_replace(F.coalesce(dek, F.lit("")), r"[^\p{L}\p{N}]+", ""))
    add_dek = (wanted != "") & (F.instr(start, wanted) == 0)
    add_picture = F.coalesce(picture, F.lit("")) != ""
    add_picture = add_picture & ~body.contains(F.coalesce(picture, F.lit("\0")))
    front = F.concat_ws("\n\n", F.when(add_dek, dek), F.when(add_picture, F.concat(F.lit("![]("), picture, F.lit(")"))))
    return F.when(front == "", F.struct(F.lit("unchanged").alias("kind"), body.alias("text"))).otherwise(F.struct(F.lit("merged").alias("kind"), F.concat(front, F.lit("\n\n"), body).alias("text")))


def block_math(text: Column) -> Column:
    """Display math on one line gets a line for each of its marks, outside of fenced code."""
    parts = F.regexp_extract_all(text, F.lit(r"(?ms)^(?:```|~~~)[^\n]*\n.*?(?:^(?:```|~~~)[ \t]*$|\z)|(?:(?!^(?:```|~~~)).)+"), F.lit(0))
    one = lambda p: F.when(p.rlike(r"^(?:```|~~~)"), p).otherwise(F.regexp_replace(p, r"(?m)^[ \t]*\$\$[ \t]*([^$\n]*[^$\s])[ \t]*\$\$[ \t]*$", "\\$\\$\n$1\n\\$\\$"))
    return F.array_join(F.transform(parts, one), "")


def front_length(text: Column) -> Column:
    """Where a file's body begins after its front matter, in code points; null without any."""
    return F.nullif(F.length(F.regexp_extract(text, r"(?s)\A---\r?\n(?:.*?\r?\n)?---(?:\r?\n|\z)", 0)), F.lit(0))


def reader_view(blocks_: Column, translated: Column, failed: Column) -> Column:
    """How a document is shown: single without a usable translation, paired where blocks align, else stacked."""
    there = translated.isNotNull() & (F.size(translated) > 0) & ~F.coalesce(failed, F.lit(False))
    return F.when(~F.coalesce(there, F.lit(False)), "single").when(F.size(alignment_errors(blocks_, translated)) == 0, "paired").otherwise("stacked")


#: Quotes and dashes that headings and titles write differently.
_TYPED, _PLAIN = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2013\u2014", "\'\'\'\'\"\"\"\"--"


def title_key(title: Column) -> Column:
    """A title for comparison: compatibility forms, quotes, dashes, white space and case folded."""
    return F.lower(F.trim(F.regexp_replace(F.translate(folded(title), _TYPED, _PLAIN), r"(?U)\s+", " ")))


def first_heading(body: Column) -> Column:
    """The text of a body's first block if it is a heading of the first level, else null."""
    first = F.get(blocks(body), F.lit(0))
    one = F.when(first["type"] == "heading", F.nullif(F.regexp_extract(first["text"], r"^ {0,3}#[ \t]+([^\n]*?)(?:[ \t]+#+)?[ \t]*$", 1), F.lit("")))
    under = F.when(first["type"] == "heading", F.nullif(F.regexp_extract(first["text"], r"^([^#\n][^\n]*)\n=+[ \t]*$", 1), F.lit("")))
    return plain_text(F.coalesce(one, under))


def lifted(body: Column, translation: Column, title: Column) -> Column:
    """struct<title_zh, lifted>: whether a page shows the body's first heading as its title, and the translation's heading then.

    It is lifted if it says what the title says, and the translation, if there is one, has a heading too.
    """
    own, other = first_heading(body), first_heading(translation)
    same = F.coalesce(title_key(own) == title_key(title), F.lit(False))
    up = same & (translation.isNull() | other.isNotNull())
    return F.struct(F.when(up, other).alias("title_zh"), up.alias("lifted"))
