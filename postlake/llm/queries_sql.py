"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

import corpus_pipeline

EXACT_DEDUP = r"""
WITH digests AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
groups AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id
  FROM digests GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM digests JOIN groups USING (text_sha256)
"""


def _level(name: str, above: str, keys: list[str], key: str, weight: str) -> str:
    """Shares each parent's budget among its children, none beyond twice its tokens."""
    by = ", ".join(keys)
    all_keys = ", ".join([*keys, key])
    part = f"PARTITION BY {by}" if keys else ""
    parent = f"JOIN {above} USING ({by})" if keys else f"CROSS JOIN {above}"
    return f"""
{name}_nodes AS (
  SELECT {all_keys}, most, weight, given FROM (
    SELECT {all_keys}, (2 * sum(tokens))::HUGEINT AS most, ({weight})::HUGEINT AS weight
    FROM leaves GROUP BY {all_keys}) {parent}),
{name}_filled AS (
  SELECT *, (upto - most) * weight + most * rest <= given * weight AS is_full FROM (
    SELECT *,
      sum(most) OVER ({part} ORDER BY most / weight::DOUBLE, {key}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
      sum(weight) OVER ({part} ORDER BY most / weight::DOUBLE, {key}
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM {name}_nodes)),
{name} AS (
  SELECT {all_keys}, CASE WHEN is_full THEN most ELSE least(most,
      (given - coalesce(sum(most) FILTER (is_full) OVER ({part}), 0)) * weight
      // sum(weight) FILTER (NOT is_full) OVER ({part})) END AS given
  FROM {name}_filled)"""


MIX_SOURCES = rf"""
WITH parts AS (
  SELECT doc_id, 'd' || coalesce((try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4)::VARCHAR, '') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM parts GROUP BY ALL),
root AS (SELECT sum(tokens)::HUGEINT AS given FROM leaves),
{_level("domains", "root", [], "domain", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")},
{_level("langs", "domains", ["domain"], "lang", "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},
{_level("sources", "langs", ["domain", "lang"], "source", "CASE source WHEN 'src0' THEN 1 ELSE 2 END")},
copies AS (
  SELECT doc_id, domain, lang, source, epoch, given, l.tokens AS leaf_tokens, p.tokens,
    md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM parts p JOIN leaves l USING (domain, lang, source) JOIN sources USING (domain, lang, source),
    range(2) e(epoch)),
placed AS (
  SELECT *, epoch * leaf_tokens + coalesce(sum(tokens) OVER (
      PARTITION BY domain, lang, source, epoch ORDER BY key, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM copies)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, given::BIGINT AS leaf_budget
FROM placed WHERE leaf_tokens > 0 AND (before < given OR (epoch + 1) * leaf_tokens <= given)
"""

ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# A run's characters are below U+0100, so UTF-8 needs two bytes at most.  The hash takes a bit at a
# time: each byte is followed by seven zeros.
SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, {ALPHABET}) AS run FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7),
hashed AS (
  SELECT doc_id, run, n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0]
        ELSE [192 + unicode(c) // 64, 0, 0, 0, 0, 0, 0, 0, 128 + unicode(c) % 64, 0, 0, 0, 0, 0, 0, 0] END))::BIGINT[],
    lambda h, b: xor(xor(h, b) >> 1, 3988292384 * (xor(h, b) & 1)), 4294967295::BIGINT)) AS h
  FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run)),
edited AS (
  SELECT n, CASE WHEN h % 31 = 0
    THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (
  SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b USING (head, tail) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON b.word = a.head || a.tail),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS form, max(m) AS m
  FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN form END AS form,
    CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
ways AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT w.word, f.form, steps + 1 FROM ways w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, first(root ORDER BY steps DESC) AS root FROM ways GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN ends USING (word)
"""

LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {ALPHABET}) AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, line, place, coalesce(doc_id <> last_doc, false) AS gone
  FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL: dict[str, str] = {
    "op2_exact_dedup": EXACT_DEDUP,
    "op3_mix_sources": MIX_SOURCES,
    "op12_spelling_variants": SPELLING,
    "op13_line_dedup": LINE_DEDUP,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
