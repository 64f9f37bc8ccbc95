"""Measures and rewrites of text as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and characters a reader takes in a minute.
WORDS_A_MINUTE, CHARACTERS_A_MINUTE = 250, 400
#: Scripts written without spaces, by Unicode's blocks.
CJK_BLOCKS = ("Hiragana", "Katakana", "CJK_Unified_Ideographs_Extension_A", "CJK_Unified_Ideographs", "CJK_Compatibility_Ideographs", "Hangul_Syllables")
CJK = "[" + "".join(rf"\p{{In{b}}}" for b in CJK_BLOCKS) + "]"
#: A letter or digit of other scripts; one that an apostrophe, full stop or hyphen ties to the one before goes on with its word.
_SIGN = rf"[\p{{L}}\p{{N}}&&[^{CJK[1:-1]}]]"
WORD_BEGINS = rf"(?<!{_SIGN})(?<!{_SIGN}['’.-]){_SIGN}"


def reading_minutes(body: Column) -> Column:
    """Beginnings of words and CJK characters at their rates, rounded half up, one at least."""
    words, characters = (F.regexp_count(body, F.lit(p)) for p in (WORD_BEGINS, CJK))
    minutes = words / F.lit(WORDS_A_MINUTE) + characters / F.lit(CHARACTERS_A_MINUTE)
    return F.greatest(F.lit(1), F.floor(minutes + F.lit(0.5))).cast("long")


def count_words(body: Column) -> Column:
    """CJK characters, and pieces between white space that have a letter or digit."""
    cjk = F.regexp_count(body, F.lit(CJK))
    pieces = F.filter(F.split(F.regexp_replace(body, CJK, " "), r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return (cjk + F.size(pieces)).cast("long")


def letters(body: Column) -> Column:
    return F.regexp_count(body, F.lit(r"\p{L}")).cast("long")


def han_ratio(body: Column) -> Column:
    """Han letters among letters outside fenced code; 0 without letters."""
    prose = F.regexp_replace(body, r"(?ms)^```.*?^```[ \t]*$", "")
    return F.coalesce(F.regexp_count(prose, F.lit(r"\p{IsHan}")) / F.nullif(F.regexp_count(prose, F.lit(r"\p{L}")), F.lit(0)), F.lit(0.0)).cast("double")


def language(body: Column, threshold: float = 0.3) -> Column:
    return F.when(han_ratio(body) >= threshold, F.lit("zh")).otherwise(F.lit("en"))


#: Marks that close a sentence, and those that may stand behind one, once.
ENDS, CLOSERS = "。．.！!？?", "\"'」』”’）)】\\]"


def is_finished(summary: Column) -> Column:
    """Ends with a sentence mark that is no ellipsis, perhaps with one closing sign behind it."""
    last = F.regexp_extract(F.regexp_replace(summary, r"(?U)\s+$", ""), rf"([{ENDS}…]+)[{CLOSERS}]?$", 1)
    return (last != "") & ~last.rlike(r"\.\.$|…$")


def simplified_quotes(text: Column) -> Column:
    return F.translate(text, "「」『』", "“”‘’")


def first_paragraph(text: Column, length: int = 300) -> Column:
    """The first paragraph that isn't blank, its white space as single spaces, cut with an ellipsis."""
    paragraphs = F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))
    first = F.get(F.filter(paragraphs, lambda p: p != ""), F.lit(0))
    return F.when(F.length(first) > length, F.concat(F.rtrim(F.substring(first, 1, length)), F.lit("…"))).otherwise(first)


def escape_dollars(text: Column) -> Column:
    return F.replace(text, F.lit("$"), F.lit("\\$"))


def is_readable(body: Column) -> Column:
    return F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s", "") != ""


#: What a reader doesn't see: pictures, targets of links, tags, signs of markup, white space beyond one.
_TARGET = r"\((?:[^()\\]++|\\.|\([^()]*+\))*+\)"
UNSEEN = rf"(?U)!\[(?:[^\[\]\\]++|\\.)*+\]{_TARGET}|(?<=\]){_TARGET}|<[^<>]+>|[#>*_`~|\[\]-]+|\s+"


def visible_length(markdown: Column) -> Column:
    """Length of what a reader sees, each stretch of what he doesn't as one space."""
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(markdown, UNSEEN, " "), " {2,}", " "))).cast("long")


def retry_after_ms(header: Column) -> Column:
    return F.when(F.trim(header).rlike(r"^\d+$"), F.trim(header).cast("long") * 1000)


#: Refusals that may pass when asked again.
PASSING = (408, 425, 429)


def is_settled_failure(status: Column) -> Column:
    """Whether asking again would be refused again."""
    return status.between(400, 499) & ~status.isin(*PASSING)


def acceptable_title(title: Column, original: Column) -> Column:
    """Whether a translated title is one: it has Han letters and isn't the original."""
    return F.coalesce(title.rlike(r"\p{IsHan}") & (F.trim(title) != F.trim(F.coalesce(original, F.lit("")))), F.lit(False))


def counted_label(n: Column, one: str, more: str) -> Column:
    """A number with its noun."""
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {more}")))
