"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from reviewatlas.llm import quality, urls, warc

_WORD = r"[^\x20\x09-\x0D]+"


def warc_sql() -> str:
    return f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest AS d, min(page_id) AS first_id FROM p WHERE n >= {warc.LEAST_REVISIT} GROUP BY digest
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.d
"""


def quality_sql(min_docs: int = 20, min_percent: float = 0.2, min_left_words: int = 30, min_left_percent: int = 30) -> str:
    symbols = quality.SYMBOLS
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), base AS (
  SELECT rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '{symbols}', '')) AS n_symbols FROM d
), lines AS (
  SELECT rid, source, t, line, regexp_extract_all(translate(lower(line), '123456789', '000000000'), '{_WORD}') AS lw
  FROM (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d)
), own AS (
  SELECT rid, source, t, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM lines WHERE len(lw) > 0
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM own GROUP BY rid
), hosts AS (
  SELECT source, count(DISTINCT t) AS n_host FROM d GROUP BY source
), above AS (
  SELECT o.norm, o.source FROM own o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source
  GROUP BY o.norm, o.source, h.n_host HAVING count(DISTINCT o.t) >= {min_docs} AND 100 * count(DISTINCT o.t) >= {min_percent} * h.n_host
), lost AS (
  SELECT o.rid, sum(o.n) AS removed_words FROM own o JOIN above a ON o.norm = a.norm AND o.source IS NOT DISTINCT FROM a.source GROUP BY o.rid
), tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM base LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    removed_words > 0 AND (n_words - removed_words < {min_left_words} OR 100 * (n_words - removed_words) < {min_left_percent} * n_words) AS depleted FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, removed_words FROM v
"""


def url_sql() -> str:
    rule = "NULL"
    verdict = "NULL"
    for word, host, path in sorted(urls.RULES, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{word}' ELSE {verdict} END"
    hit = lambda t: f"(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::INT"
    soft = " + ".join(hit(t) for t in urls.SOFT if t not in urls.STRICT)
    strict = " + ".join(hit(t) for t in urls.STRICT)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH u AS (
  SELECT page_id, lower(coalesce(url, '')) AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT page_id, host, path, {rule} AS rule, {verdict} AS by_rule, ({strict}) AS n_strict, ({soft}) AS n_soft FROM h
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN n_strict > 0 OR n_soft >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
