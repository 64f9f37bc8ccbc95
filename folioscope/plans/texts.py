"""Queries over texts, pages and Markdown."""

from pyspark.sql import functions as F

from folioscope.functions import html, markdown, text
from folioscope.operators import search, similar
from folioscope.plans.registry import query
from folioscope.plans.tables import table

#: Words: letters and digits, once the signs that tie two of them have gone (twice, since neighbours share a letter).
_TIED = r"([\p{L}\p{N}])[''’.-]([\p{L}\p{N}])"
_WORDS = rf"len(regexp_extract_all(regexp_replace(regexp_replace(text, '{_TIED}', '\1\2', 'g'), '{_TIED}', '\1\2', 'g'), '[\p{{L}}\p{{N}}]+'))"
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}]"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(rf"SELECT doc_id, CAST(greatest(1, floor({_WORDS} / 250 + 0.5)) AS BIGINT) AS minutes FROM documents")
def reading_minutes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.reading_minutes(F.col("text")).alias("minutes"))


@query(rf"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS BIGINT) AS words FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.count_words(F.col("text")).alias("words"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{L}')) AS BIGINT) AS letters FROM documents")
def letter_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.letters(F.col("text")).alias("letters"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{Han}')) / greatest(len(regexp_extract_all(text, '\p{L}')), 1) AS DOUBLE) AS ratio FROM documents")
def language_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.han_ratio(F.col("text")).alias("ratio"))


@query(rf"""SELECT doc_id, NOT regexp_matches(b, '(?:\.{{2,}}|…+)["''」』”’）)】\]]?$') AND regexp_matches(b, '[。．.！!？?]["''」』”’）)】\]]?$') AS finished FROM (SELECT doc_id, regexp_replace(text, '{_SPACE}+$', '') || CASE doc_id % 4 WHEN 0 THEN '.")' WHEN 1 THEN '?」' WHEN 2 THEN '…' ELSE '' END AS b FROM documents)""")
def summary_finished(spark, sf_dir):
    """Texts as they end, or with a mark and one or two closing signs, or an ellipsis."""
    end = F.get(F.array(F.lit('.")'), F.lit("?」"), F.lit("…"), F.lit("")), (F.col("doc_id") % 4).cast("int"))
    bare = F.regexp_replace("text", r"(?U)\s+$", "")
    return _docs(spark, sf_dir).select("doc_id", text.is_finished(F.concat(bare, end)).alias("finished"))


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: trim(regexp_replace(x, '{_SPACE}+', ' ', 'g'))), lambda x: x <> '')[1] AS first FROM documents)
SELECT doc_id, CASE WHEN length(first) > 300 THEN rtrim(substr(first, 1, 300)) || '…' ELSE first END AS excerpt FROM p""")
def excerpt_first_paragraph(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.first_paragraph(F.col("text")).alias("excerpt"))


@query("SELECT doc_id, length(replace(text, '$', '\\$')) - length(text) AS dollars FROM documents")
def escape_dollars(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", (F.length(text.escape_dollars(F.col("text"))) - F.length("text")).cast("long").alias("dollars"))


_VISIBLE = rf"""CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[(?:[^\[\]\\]|\\.)*\]\((?:\\.|[^()\\]|\([^()]*\))*\)', ' ', 'g'), '\]\((?:\\.|[^()\\]|\([^()]*\))*\)', ']', 'g'), '<[^<>]+>', ' ', 'g'), '[#>*_`~|\[\]-]+', ' ', 'g'), '{_SPACE}+', ' ', 'g'))) AS BIGINT)"""


@query(f"SELECT doc_id, {_VISIBLE} AS visible FROM documents WHERE {_VISIBLE} < 500")
def thin_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.visible_length(F.col("text")).alias("visible")).where("visible < 500")


@query("""SELECT event_id, CAST(390 + event_id % 120 AS INTEGER) AS status, event_id % 120 BETWEEN 10 AND 109 AND event_id % 120 NOT IN (18, 35, 39) AS settled FROM events""")
def failure_class(spark, sf_dir):
    status = (390 + F.col("event_id") % 120).cast("int")
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), text.is_settled_failure(status).alias("settled"))


_UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_SQUEEZED = r"trim(regexp_replace({}, '[ \t\r\n\f]+', ' ', 'g'))"


@query("SELECT page_id, " + _SQUEEZED.format(_UNESCAPED.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")) + " AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, pos, links[pos] AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1) AS links FROM pages), unnest(range(1, len(links) + 1)) AS t(pos)""")
def html_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("pos", "href"))
    return rows.withColumn("pos", (F.col("pos") + 1).cast("long"))


_GONE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style|nav|head|footer)\b[^>]*>.*?</(?:script|style|nav|head|footer)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query("SELECT page_id, " + _SQUEEZED.format(_UNESCAPED.format(_GONE)) + " AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda h: """ + _SQUEEZED.format(_UNESCAPED.format("regexp_replace(h, '<[^>]*>', '', 'g')")) + "), '|') AS headings FROM pages")
def html_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(html.headings(F.col("html")), "|").alias("headings"))


@query(r"""WITH pieces AS (SELECT page_id, i, regexp_extract(ps[i], '(?is)^(.*?)(?:</p>|</div>|</article>|</body>|\z)', 1) AS p FROM (SELECT page_id, string_split(html, '<p>') AS ps FROM pages), unnest(range(2, len(ps) + 1)) AS u(i)),
plain AS (SELECT page_id, i, trim(regexp_replace(replace(replace(regexp_replace(p, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) AS text FROM pieces)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, text FROM plain WHERE text <> ''""")
def html_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.paragraphs(F.col("html"))).alias("pos", "text"))


BLOCKS = r"""parts AS (SELECT doc_id, i - 1 AS pos, ps[i] AS b FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*') AS ps FROM documents), unnest(range(1, len(ps) + 1)) AS u(i)),
blocks AS (SELECT doc_id, pos, regexp_replace(b, '\s+\z', '') AS text, CASE WHEN regexp_matches(b, '\A#{1,6}\s') OR regexp_matches(b, '\A[^\n]+\n(?:=+|-+)[ \t]*\z') THEN 'heading' WHEN regexp_matches(b, '\A {0,3}(?:[-*_][ \t]*){3,}\z') THEN 'thematicBreak'
  WHEN regexp_matches(b, '\A {0,3}>') THEN 'blockquote' WHEN regexp_matches(b, '\A {0,3}(?:[-*+]|\d{1,9}[.)])\s') THEN 'list' WHEN regexp_matches(b, '\A {0,3}\$\$') THEN 'math' WHEN regexp_matches(b, '\A {0,3}<[A-Za-z!/]') THEN 'html' ELSE 'paragraph' END AS type FROM parts)"""


@query(f"WITH {BLOCKS} SELECT doc_id, pos, type, text FROM blocks")
def block_table(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(markdown.blocks(F.col("text"))).alias("b")).select("doc_id", "b.pos", "b.type", "b.text")


@query(f"WITH {BLOCKS} SELECT type, count(*) AS n FROM blocks GROUP BY type")
def block_counts(spark, sf_dir):
    blocks = _docs(spark, sf_dir).select(F.explode(markdown.blocks(F.col("text"))).alias("b"))
    return blocks.groupBy("b.type").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '!\[[^\]]*\]\([^)\s]+[^)]*\)')) + doc_id % 3 AS BIGINT) AS images FROM documents""")
def markdown_images(spark, sf_dir):
    """With up to two pictures put behind every text, one with a title, and a link that is none."""
    more = F.when(F.col("doc_id") % 3 > 0, " ![a](u/i.png)").otherwise("")
    body = F.concat("text", more, F.when(F.col("doc_id") % 3 == 2, ' ![](u/j.png "t")').otherwise(" [l](u)"))
    return _docs(spark, sf_dir).select("doc_id", markdown.counts(body)["images"].alias("images"))


@query("""SELECT conv_id, string_agg('**' || role || '**: ' || replace(text, chr(10), ' '), chr(10) || chr(10) ORDER BY turn) AS thread, count(*) AS turns FROM conversations GROUP BY conv_id""")
def thread_flatten(spark, sf_dir):
    return similar.flattened(table(spark, sf_dir, "conversations"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS words FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words), 1) >= 0.8 AS agrees FROM w AS a JOIN w AS b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def near_match(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", similar.words(F.col("text")).alias("words"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", (similar.agreement(F.col("words"), F.col("next")) >= similar.AGREEMENT).alias("agrees"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents),
stats AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
hits AS (SELECT doc_id, len(words) AS length, term, len(list_filter(words, lambda x: x = term)) AS tf FROM w, unnest(['the', 'von', 'queria', 'idiot']) AS q(term)),
df AS (SELECT term, count(*) AS df FROM hits WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM hits JOIN df USING (term), stats WHERE tf > 0 GROUP BY doc_id""")
def bm25_search(spark, sf_dir):
    return search.bm25(_docs(spark, sf_dir), "the von queria idiot").select("doc_id", F.round("score", 6).alias("score"))
