"""The numbered queries: each applies its operator, with production parameters, to the whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import byte_bpe, conversation_repair, decontamination, kd_shards, language_model, merkle, minhash, pii, quality, simhash, substring_dedup, toxicity, warc

ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(documents(spark, sf_dir), benchmark).drop("longest_match")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op9_benchmark_decontamination"] = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
found AS (
  SELECT doc_id, i, k, item
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
        FROM docs, (SELECT DISTINCT k FROM windows) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)) AS d
  JOIN windows USING (k, words)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(i, i + k)) AS u(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs AS d LEFT JOIN hits AS h USING (doc_id) LEFT JOIN named AS m USING (doc_id)"""

def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op7_substring_dedup"] = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM docs, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(i, i + 20)) AS t(p)),
placed AS (SELECT doc_id, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs AS d LEFT JOIN kept AS k USING (doc_id)"""

def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return byte_bpe.digests(byte_bpe.encoded(documents(spark, sf_dir), file.read(), public_tokenizers.PATTERN))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shards(documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


_BITS = "list_reduce(list_prepend('', list_transform(string_split(sha1(coalesce(html, '')), ''), lambda d: lpad(bin(strpos('0123456789abcdef', d) - 1), 4, '0'))), lambda a, b: a || b)"

ORACLES["op10_warc"] = f"""
WITH bits AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest, {_BITS} AS b FROM pages),
coded AS (
  SELECT page_id, n, min(page_id) OVER (PARTITION BY digest, n) AS first,
    list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + list_reduce(list_transform(range(1, 6), lambda k: CAST(substr(b, 5 * i + k, 1) AS INTEGER)), lambda x, y: 2 * x + y), 1)), lambda x, y: x || y) AS code
  FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, code AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM coded"""

def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = {f: F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS}
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf(list(tampered.values())))
    found = merkle.manifest(docs, keep={"forged": forged})
    folded = found.withColumn("folded_root", merkle.folded(F.coalesce("forged", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text in SQL, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    codes = f"list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), 4294967295)"


def _leaf(n_chars: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


_ABOVE = "list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')))"
_FOLD = "list_reduce(list_prepend({leaf}, proof), lambda node, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || node WHEN 'r' THEN node || s[2:] ELSE node END))"

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS forged FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
grown AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM leaves GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_ABOVE} FROM grown WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM grown WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY k) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_ABOVE} FROM top WHERE len(nodes) > 1),
cells AS (
  SELECT lang, false AS up, level, unnest(nodes) AS node, unnest(range(len(nodes))) AS at FROM grown WHERE len(nodes) > 1
  UNION ALL SELECT NULL, true, level, unnest(nodes), unnest(range(len(nodes))) FROM top WHERE len(nodes) > 1),
levels AS (SELECT DISTINCT lang, up, level FROM cells),
climbs AS (
  SELECT i, l.lang, v.up, v.level, (CASE WHEN v.up THEN k ELSE i END) // CAST(2 ** v.level AS BIGINT) AS at
  FROM leaves AS l JOIN subroots AS s ON l.lang IS NOT DISTINCT FROM s.lang
  JOIN levels AS v ON v.up OR v.lang IS NOT DISTINCT FROM l.lang),
proofs AS (
  SELECT c.i, c.lang, list(CASE WHEN n.node IS NULL THEN '' WHEN n.at < c.at THEN 'l' || n.node ELSE 'r' || n.node END ORDER BY c.up, c.level) AS proof
  FROM climbs AS c LEFT JOIN cells AS n
    ON n.up = c.up AND n.level = c.level AND n.at = xor(c.at, 1) AND (c.up OR n.lang IS NOT DISTINCT FROM c.lang)
  GROUP BY c.i, c.lang),
whole AS (
  SELECT l.*, s.subroot, coalesce(p.proof, []) AS proof, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root
  FROM leaves AS l JOIN subroots AS s ON l.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN proofs AS p ON p.i = l.i AND p.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_prepend('', list_transform(proof, lambda s: s[2:])), lambda a, b: a || b), '')) AS proof_sha256,
  {_FOLD.format(leaf='coalesce(forged, leaf)')} AS folded_root, {_FOLD.format(leaf='coalesce(forged, leaf)')} = root AS verified
FROM whole"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repaired(conversation_repair.damaged(turns), turns)


def _edit(letter: str, cost: int, to: int, line: str | None = None) -> str:
    """A way to the end as {k: cost in nine digits and audit, t: lines}, with one more edit in front."""
    lines = f"list_prepend({line}, s{to}.t)" if line else f"s{to}.t"
    return f"{{'k': lpad(CAST(CAST(s{to}.k[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || s{to}.k[10:], 't': {lines}}}"


def _least(ways: list[str]) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _ways(state: int) -> str:
    """The cheapest way from a state before a turn, insertions aside."""
    role, to = (("a", 3) if state == 2 else ("u", 2))
    named = {"u": "user", "a": "assistant"}[role]
    ways = [_edit("D", 4, state)]
    for letter, cost, after, line, test in [("K", 0, to, "role || ':' || text", f"initial = '{role}'"), ("R", 3, to, f"'{named}:' || text", "true")] + [("K", 0, 1, "role || ':' || text", "initial = 's'")] * (state == 0):
        ways += [f"CASE WHEN fault = {f} AND {test} THEN {_edit(letter, cost + worse, after, line)} END" for f, worse in ((0, 0), (3, 3))]
    return _least(ways)


ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fate FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fates WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), copy) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
ways AS (
  SELECT conv_id, n + 1 AS pos, {{'k': '000000000', 't': CAST([] AS VARCHAR[])}} AS s0, {{'k': '000000006II', 't': ['user:', 'assistant:']}} AS s1,
    {{'k': '000000003I', 't': ['assistant:']}} AS s2, {{'k': '000000000', 't': CAST([] AS VARCHAR[])}} AS s3
  FROM (SELECT DISTINCT conv_id, n FROM judged)
  UNION ALL
  SELECT conv_id, pos, {_least(['s0', _edit('I', 3, 2, "'user:'")])}, {_least(['s1', _edit('I', 3, 2, "'user:'")])}, s2, {_least(['s3', _edit('I', 3, 2, "'user:'")])}
  FROM (SELECT conv_id, pos, s0, s1, {_least(['s2', _edit('I', 3, 3, "'assistant:'")])} AS s2, s3
        FROM (SELECT j.conv_id, j.pos, {', '.join(f'{_ways(q)} AS s{q}' for q in range(4))}
              FROM ways AS w JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos - 1))),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM judged GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0.k[1:9], '0') AS BIGINT) AS cost,
  coalesce(s0.k[10:], '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN sums AS s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM ways WHERE pos = 1) AS w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


ORACLES["op13_minhash_near_dedup"] = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reached AS r JOIN both_ways AS l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs AS d LEFT JOIN sizes AS s USING (doc_id) LEFT JOIN least USING (doc_id)"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_kd_sharding, op3_pii, op10_warc, op11_merkle_manifest, op12_conversation_repair, op13_minhash_near_dedup, op4_quality_rules, op5_lm_scoring, op6_byte_bpe, op7_substring_dedup, op8_simhash_near_dedup, op9_benchmark_decontamination)}
