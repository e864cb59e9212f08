"""The registered query of each operator, and the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlens.llm import conversation_repair, decontaminate, exact_dedup, language_id, mixing, ngram_join, quality_ranker, quality_rules, sharding, spelling, suffix_dedup, toxicity, url_filter
from oddlens.llm.common import table


def held_out(remainder: int, of: int) -> Column:
    """Whether a row is kept from learning: by crc32 of doc_id as text; a null doc_id is learned from by nobody's fold, so it counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == remainder, F.lit(True))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cascade(table(spark, sf_dir, "documents")).drop("failed_rule")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), least=50)


#: The rules of op4's contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(0, 5)
    ranker = quality_ranker.learn(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    scored = quality_ranker.score(docs, ranker)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality_ranker.CUT).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(2, 4)
    found = language_id.predict(docs, language_id.learn(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(2, 4)
    grammar = toxicity.learn(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), n=3, threshold=90)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup.groups(table(spark, sf_dir, "documents"), carry={"text_sha256": digest}).drop("n_bytes")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), damage=spelling.drop_letter))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_sharding, op4_url_filter, op5_ngram_jaccard, op6_suffix_dedup, op7_quality, op8_decontamination, op9_toxicity, op10_language_id, op11_exact_dedup, op12_spelling, op13_conversation_repair)}


OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""


OP2 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
spots AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM spots) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
f AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN rep USING (r)
), s AS (SELECT *, greatest(n_words, 1) AS n, greatest(word_chars, 1)::DOUBLE AS c, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n AND 15 * n AND 10 * n_symbols <= n AND 10 * n_dup_lines <= 3 * n_lines
  AND (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) / c <= 0.4 AND (length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) / c >= 0.6
  AND (length(text) - length(regexp_replace(text, '\p{Nd}', '', 'g'))) / c <= 0.25 AND (length(text) - length(replace(text, '!', ''))) / c <= 0.05 AS kept
FROM s
"""

OP4 = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://((?s:[^?#]*))', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '/(?s:.*)$') AS path FROM u),
rules AS (SELECT * FROM (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) v(rule, h, start, verdict)),
fit AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""

CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
)"""

OP12 = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS m FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, m, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT run, m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs), crc_table
), words AS (
  SELECT word, sum(m)::BIGINT AS n FROM (SELECT CASE WHEN crc % 31 = 0 THEN run[1 : crc % length(run)] || run[crc % length(run) + 2 :] ELSE run END AS word, m FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2
), less AS (SELECT word, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)
), ranked AS (
  SELECT near.a, near.b, w.n, count(*) OVER (PARTITION BY near.a) AS n_near, row_number() OVER (PARTITION BY near.a ORDER BY w.n DESC, encode(near.b)) AS r FROM near JOIN words w ON w.word = near.b
), formed AS (
  SELECT w.word, CASE WHEN r.n >= 10 * w.n THEN r.b END AS form, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1
), ways AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT w.word, f.word, f.form FROM ways w JOIN formed f ON f.word = w.next
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word AND w.next IS NULL
"""
OP11 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP13 = rf"""
WITH RECURSIVE {CRC_TABLE}, raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), keyed AS (
  SELECT raw.*, xor(list_reduce(list_transform(range(length(k)), lambda i: ascii(k[i + 1])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM raw, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, c
  FROM keyed, (VALUES (0), (1)) v(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), c) AS i, left(role, 1) AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM damaged
), flawed AS (
  SELECT *, CASE WHEN e = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), figures AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM flawed GROUP BY conv_id
), ways AS (
  SELECT conv_id, rows AS i, {{'c': 0, 's': '', 't': ''}} AS w0, {{'c': 10, 's': 'II', 't': E'user:\nassistant:\n'}} AS ws, {{'c': 5, 's': 'I', 't': E'assistant:\n'}} AS wu, {{'c': 0, 's': '', 't': ''}} AS wa FROM figures
  UNION ALL
  SELECT conv_id, i, w0, CASE WHEN ws.c > wu.c + 5 OR (ws.c = wu.c + 5 AND ws.s > 'I' || wu.s) THEN {{'c': wu.c + 5, 's': 'I' || wu.s, 't': E'user:\n' || wu.t}} ELSE ws END, wu, wa FROM (
   SELECT conv_id, i, CASE WHEN w0.c > wu.c + 5 OR (w0.c = wu.c + 5 AND w0.s > 'I' || wu.s) THEN {{'c': wu.c + 5, 's': 'I' || wu.s, 't': E'user:\n' || wu.t}} ELSE w0 END AS w0, ws, wu, wa FROM (
    SELECT conv_id, i, w0, ws,
      CASE WHEN wu.c > wa.c + 5 OR (wu.c = wa.c + 5 AND wu.s > 'I' || wa.s) THEN {{'c': wa.c + 5, 's': 'I' || wa.s, 't': E'assistant:\n' || wa.t}} ELSE wu END AS wu,
      CASE WHEN wa.c > wu.c + 5 OR (wa.c = wu.c + 5 AND wa.s > 'I' || wu.s) THEN {{'c': wu.c + 5, 's': 'I' || wu.s, 't': E'user:\n' || wu.t}} ELSE wa END AS wa
    FROM (
     SELECT w.conv_id, w.i - 1 AS i,
      list_sort([{{'c': w0.c + 2, 's': 'D' || w0.s, 't': w0.t}}, {{'c': wu.c + owed + (CASE WHEN ini = 'u' THEN free ELSE 1000000 END), 's': 'K' || wu.s, 't': line || wu.t}}, {{'c': ws.c + owed + (CASE WHEN ini = 's' THEN free ELSE 1000000 END), 's': 'K' || ws.s, 't': line || ws.t}}, {{'c': wu.c + owed + 1 + free, 's': 'R' || wu.s, 't': 'user:' || text || chr(10) || wu.t}}])[1] AS w0,
      list_sort([{{'c': ws.c + 2, 's': 'D' || ws.s, 't': ws.t}}, {{'c': wu.c + owed + (CASE WHEN ini = 'u' THEN free ELSE 1000000 END), 's': 'K' || wu.s, 't': line || wu.t}}, {{'c': wu.c + owed + 1 + free, 's': 'R' || wu.s, 't': 'user:' || text || chr(10) || wu.t}}])[1] AS ws,
      list_sort([{{'c': wu.c + 2, 's': 'D' || wu.s, 't': wu.t}}, {{'c': wa.c + owed + (CASE WHEN ini = 'a' THEN free ELSE 1000000 END), 's': 'K' || wa.s, 't': line || wa.t}}, {{'c': wa.c + owed + 1 + free, 's': 'R' || wa.s, 't': 'assistant:' || text || chr(10) || wa.t}}])[1] AS wu,
      list_sort([{{'c': wa.c + 2, 's': 'D' || wa.s, 't': wa.t}}, {{'c': wu.c + owed + (CASE WHEN ini = 'u' THEN free ELSE 1000000 END), 's': 'K' || wu.s, 't': line || wu.t}}, {{'c': wu.c + owed + 1 + free, 's': 'R' || wu.s, 't': 'user:' || text || chr(10) || wu.t}}])[1] AS wa
     FROM ways w JOIN (SELECT *, role || ':' || text || chr(10) AS line, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS owed, CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 0 END AS free FROM flawed) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
    )
   )
  )
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(w0.c, 0)::BIGINT AS cost, coalesce(w0.s, '') AS audit, sha256(coalesce(left(w0.t, greatest(length(w0.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN (SELECT * FROM ways WHERE i = 0) w ON w.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op4_url_filter": OP4, "op5_ngram_jaccard": OP5, "op11_exact_dedup": OP11, "op12_spelling": OP12, "op13_conversation_repair": OP13}
