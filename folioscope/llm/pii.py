"""Personal data: patterns find it, and terms that reveal it are found by information theory. Built-in functions only.

Protected entities are the values that the patterns find. Terms are whole runs of letters and digits, of any length,
that no found span touches; those within REACH code points of an entity's place are its context. Over the whole corpus, how strongly a term t reveals an entity e is measured by
    P(e | t) = n(t, e) / n(t)   and   PMI(t, e) = log2(n(t, e) N / (n(t) n(e))), as a share of e's information log2(N / n(e)),
all four in distinct texts, so that copies of a document cancel: n(t, e) are the texts with the term in a context of the
entity. Where both exceed their thresholds, with support from at least MIN_CONTEXTS distinct contexts, the term is generalised wherever
it stands in the corpus: REACH bounds what counts as a context and not what is generalised.

Time is in proportion to a text's length: positions are running sums taken by blocks of an array, and pieces of a text
are cut from blocks of it and not from its start.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved

KINDS = ("email", "ip", "card", "phone", "term")
#: Leftmost matches of the four kinds. Possessive repeats and look-behinds spare what can't match; a card's run is
#: taken whole or not at all, so runs of fewer or more digits need no match of their own.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_SIGNS = ("[@]", r"[0-9]\.[0-9]", "[0-9]", r"\+[0-9]")
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
REACH = 64
MIN_CONTEXTS, MIN_CHANCE, MIN_SHARE = 2, 0.5, 0.5
#: Bits of the filter that goes to every task, whatever the number of terms (a power of two of 20 bits at most).
MASK_BITS = 1 << 20
#: Stands for each code point of a span where terms are looked for.
_FILL = "\x01"
_RUN = r"[\p{L}\p{N}\p{M}]"
#: A whole run that no span touches, in a text whose spans are filled.
TERM = rf"(?<![\x01\p{{L}}\p{{N}}\p{{M}}]){_RUN}++(?!\x01)"
#: Code points of a block of text.
_BLOCK = 4096
_SPAN = "array<struct<start:int,rank:int,end:int,entity:bigint,context:bigint,terms:array<string>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body's value, with the given one worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of numbers from 0, all up to it joined (a sum, the greatest)."""

    def last(a: Column) -> Column:
        return F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))

    def run(v: Column, start: Column, step: Column) -> Column:
        # Elements are got one by one: a slice would copy the whole array first.
        places = F.sequence(start, F.least(F.size(v), start + step) - 1)
        return F.aggregate(places, F.expr("CAST(array() AS array<int>)"), lambda a, i: F.concat(a, F.array(join(last(a), F.get(v, i)))))

    def of(v: Column) -> Column:
        # Growing arrays are copied; blocks of this length keep the copies of a block and those of the blocks' ends few.
        step = F.greatest(F.ceil(F.cbrt(2.0 * F.size(v))).cast("int"), F.lit(1))
        blocks = _let(step, lambda k: F.transform(F.sequence(F.lit(0), F.size(v) - 1, k), lambda start: run(v, start, k)))
        return F.when(F.size(v) > 0, blocks).otherwise(F.expr("CAST(array() AS array<array<int>>)"))

    def carried(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, block: F.concat(a, F.array(join(last(a), last(block)))))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda block, c: F.transform(block, lambda x: join(c, x))))

    return _let(values, lambda v: _let(of(v), carried))


def _matches(text: Column, pattern: str) -> Column:
    """Each match's start and end, in code points from 0, and its text."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _running(F.zip_with(gaps, found, lambda gap, value: F.length(gap) + F.length(value)), lambda a, b: a + b)
        return F.zip_with(found, ends, lambda value, end: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, length: Column) -> Column:
    """So many code points from a place on."""
    first = F.floor(start / _BLOCK).cast("int")
    last = F.floor((start + length) / _BLOCK).cast("int")
    return F.substring(F.array_join(F.transform(F.sequence(first, last), lambda k: F.get(blocks, k)), ""), start - first * _BLOCK + 1, length)


def _rewritten(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with put(span, end of those before) in place of spans, which are in order and may overlap."""

    def joined(blocks: Column, ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            return _let(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda at: F.concat(_cut(blocks, at, F.greatest(s["start"] - at, F.lit(0))), put(s, at)))

        tail = _let(F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)), lambda at: _cut(blocks, at, F.greatest(F.length(text) - at, F.lit(0))))
        return F.concat(F.array_join(F.transform(spans, piece), ""), tail)

    ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return _let(_blocks(text), lambda blocks: _let(ends, lambda e: joined(blocks, e)))


def _filled(text: Column, spans: Column) -> Column:
    """The text with each code point of a span as _FILL."""
    return F.when(F.size(spans) > 0, _rewritten(text, spans, lambda s, at: F.repeat(F.lit(_FILL), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))).otherwise(text)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(rank: int, value: Column) -> Column:
    if rank == 1:
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if rank == 2:
        return _luhn(value)
    if rank == 3:
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _terms(blocks: Column, start: Column, end: Column) -> Column:
    """Terms near a span, from blocks of the filled text; runs that REACH cuts are left out."""
    edge = F.greatest(start - REACH - 1, F.lit(0))
    left = _cut(blocks, edge, start + 1 - edge)
    right = _cut(blocks, end - 1, F.lit(REACH + 2))
    whole_left = F.when(start > REACH, F.regexp_replace(left, f"^{_RUN}+", "")).otherwise(left)
    whole_right = F.when(F.length(right) == REACH + 2, F.regexp_replace(right, f"{_RUN}++$", "")).otherwise(right)
    found = F.regexp_extract_all(F.concat_ws(" ", whole_left, whole_right), F.lit(TERM), F.lit(0))
    return F.transform(found, F.lower)


def _spans(text: Column) -> Column:
    """All spans of personal data in order, each with its entity, context and the terms in it."""

    def of_kind(rank: int) -> Column:
        valid = F.filter(_matches(text, PATTERNS[rank]), lambda m: _valid(rank, m["value"]))
        bare = F.transform(valid, lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), m["end"], m["value"]))
        empty = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,value:string>>)")
        return F.when(text.rlike(_SIGNS[rank]), bare).otherwise(empty)

    return F.array_sort(F.concat(*map(of_kind, range(len(PATTERNS)))))


def _with_context(text: Column, spans: Column) -> Column:
    def one(blocks: Column, s: Column) -> Column:
        entity = F.xxhash64(s["rank"], F.when(s["rank"].isin(2, 3), F.regexp_replace(s["value"], "[^0-9]", "")).otherwise(F.lower(s["value"])))
        near = _terms(blocks, s["start"], s["end"])
        return _let(near, lambda terms: F.struct(s["start"], s["rank"], s["end"], entity.alias("entity"), F.xxhash64(terms).alias("context"), terms.alias("terms")))

    return _let(_blocks(_filled(text, spans)), lambda blocks: F.transform(spans, lambda s: one(blocks, s)))


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the row's content and one of its text, and its spans with contexts; saved, since four later steps read it."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", _key()).withColumn("base", _spans(F.col("text")))
    spans = F.when(F.size("base") > 0, _with_context(F.col("text"), F.col("base"))).otherwise(F.expr(f"CAST(array() AS {_SPAN})"))
    return saved(base.select("doc_id", "key", F.xxhash64("text").alias("copy"), spans.alias("spans")))


def _pairs(rows: DataFrame) -> DataFrame:
    """entity and term with n_both, n_contexts and n_entity, for pairs that may exceed the thresholds; saved."""
    near = rows.select("copy", F.explode("spans").alias("s")).select("copy", "s.entity", "s.context", F.explode_outer("s.terms").alias("term")).distinct()
    entities = near.groupBy("entity").agg(F.count_distinct("copy").alias("n_entity"))
    named = near.where("term IS NOT NULL")
    pairs = named.groupBy("entity", "term").agg(F.count_distinct("copy").alias("n_both"), F.count_distinct("context").alias("n_contexts")).where(F.col("n_contexts") >= MIN_CONTEXTS)
    # The texts with the term near any entity are some of those with the term: pairs that fail by them alone go early.
    least = named.groupBy("term").agg(F.count_distinct("copy").alias("n_near"))
    return saved(pairs.join(least, "term").where(F.col("n_both") >= MIN_CHANCE * F.col("n_near")).drop("n_near").join(entities, "entity"))


def _candidates(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, copy and the places (start, end, term) of the pairs' terms, for texts with any; other terms may be among them. Saved."""
    mask = _mask(pairs)
    texts = docs.select(_key().alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(f"{_RUN}+"), F.lit(0)))
    some = texts.where(F.exists(runs, lambda t: _may_be(F.lower(t), mask))).withColumn("base", _spans(F.col("text")))
    filled = some.select("key", F.xxhash64("text").alias("copy"), _filled(F.col("text"), F.col("base")).alias("filled"))
    found = F.transform(_matches(F.col("filled"), TERM), lambda p: F.struct(p["start"], p["end"], F.lower(p["value"]).alias("term")))
    # Saved before rows without places go: a filter would be pushed down with all that it is worked out from.
    return saved(filled.select("key", "copy", F.filter(found, lambda p: _may_be(p["term"], mask)).alias("places"))).where(F.size("places") > 0)


def _exceeding(rows: DataFrame, pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    # Partial aggregation leaves a row of each text to a task, so a large group of copies weighs one row for each.
    texts = candidates.groupBy("copy").agg(F.first(F.array_distinct("places.term")).alias("terms"))
    terms = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    n = rows.select("copy").distinct().count()
    joined = pairs.join(terms, "term")
    pmi = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_term") * F.col("n_entity")))
    joined = joined.select("entity", "term", (F.col("n_both") / F.col("n_term")).alias("chance"), F.try_divide(pmi, F.log2(F.lit(float(max(n, 2))) / F.col("n_entity"))).alias("share"))
    return joined.where((F.col("chance") >= MIN_CHANCE) & (F.col("share") >= MIN_SHARE))


def revealing(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """entity, term, chance P(e | t) and share PMI / IC of the pairs that exceed the thresholds; copies of a text count once."""
    pairs = _pairs(rows)
    return _exceeding(rows, pairs, _candidates(docs, pairs))


def _bits(term: Column) -> list[Column]:
    """Three bits of a term in the filter."""
    return [F.shiftrightunsigned(F.xxhash64(term), 20 * k).bitwiseAND(F.lit(MASK_BITS - 1)) for k in range(3)]


def _mask(terms: DataFrame) -> Column:
    """An array of MASK_BITS bits with those of the terms set (a Bloom filter): it only spares work on what can't match."""
    bit = terms.select(F.explode(F.array(*_bits(F.col("term")))).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    bits = [0] * (MASK_BITS // 64)
    for row in words.collect():
        bits[row["at"]] = row["bits"]
    return F.from_json(F.lit(str(bits)), "array<bigint>")


def _may_be(term: Column, mask: Column) -> Column:
    a, b, c = (F.getbit(F.get(mask, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1 for bit in _bits(term))
    return a & b & c


def _added(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """By key, the spans of revealing terms, wherever they stand in the whole texts of the corpus."""
    pairs = _pairs(rows)
    candidates = _candidates(docs, pairs)
    terms = _exceeding(rows, pairs, candidates).select("term").distinct()
    # A row for each document and term, with all its places: repeats in one text weigh nothing in the join.
    at = candidates.select("key", "places", F.explode(F.array_distinct("places.term")).alias("term"))
    span = F.transform(F.filter("places", lambda p: p["term"] == F.col("term")), lambda p: F.struct(p["start"], F.lit(len(KINDS) - 1).alias("rank"), p["end"]))
    return at.select("key", "term", span.alias("spans")).join(terms, "term").groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("added"))


def sanitised_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key and all spans in order (start, kind's rank, end), those of the method among them."""
    rows = found(docs)
    base = F.transform("spans", lambda s: F.struct(s["start"], s["rank"], s["end"]))
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int>>)")
    return rows.select("doc_id", "key", base.alias("base")).join(_added(docs, rows), "key", "left").select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def _named(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def report(docs: DataFrame) -> DataFrame:
    """A row per document with the base counts, the digest of the base spans, and all spans.

    A null or empty text has none; a null doc_id keeps its row; repeated rows each get their row, and
    equal texts count once. A long text takes time in proportion, however many spans it has. An empty table gives no
    rows. Columns besides doc_id and text aren't read.
    """

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return sanitised_spans(docs).select("doc_id", *map(count, range(4)), F.sha2(_named("base").cast("binary"), 256).alias("base_sha256"), _named("spans").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with every span generalised to its kind, such as <EMAIL>; their other columns stay, n_chars follows.

    Null and empty texts stay as they are, and so does every row: repeated ones, and those without a doc_id. Spans are
    found by doc_id and text, so equal rows are treated alike. A long text takes time in proportion. An empty table
    stays empty. Columns may have any names.
    """
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    spans = sanitised_spans(docs).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    joined = docs.select(_key().alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).join(spans, "key", "left")
    text, clean = F.col("row.text"), F.col("spans").isNull()
    new = _rewritten(text, F.col("spans"), lambda s, at: F.when(s["start"] >= at, F.element_at(marks, s["rank"] + 1)).otherwise(""))
    changed = joined.withColumn("new", F.when(clean, text).otherwise(new))
    instead = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.when(clean, F.col("row.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[instead.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
