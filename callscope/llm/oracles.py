"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from callscope.llm.license_scan import TEMPLATES, THRESHOLD


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def topk() -> str:
    return """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in rules)
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {values}),
rest AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, n,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT n, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.n = fits.n AND k = 1
"""


def license_scan() -> str:
    values = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in TEMPLATES)
    norm = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    words = "string_split_regex(trim(replace({}, chr(10), ' ')), ' +')"
    grams = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    return f"""
WITH notices AS (
  SELECT license, {grams} AS grams FROM (
    SELECT license, {words.format(norm.format('notice'))} AS words FROM (VALUES {values}) t(license, notice))),
texts AS (SELECT doc_id, {norm.format('text')} AS text FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT DISTINCT doc_id, {words.format('unit')} AS words FROM (
    SELECT doc_id, unnest(string_split(text, chr(10)) || string_split_regex(text, '\\n(?: ?\\n)+') || [text]) AS unit FROM texts)),
grams AS (SELECT doc_id, words, {grams} AS grams FROM units WHERE len(words) >= 2),
scored AS (
  SELECT doc_id, license, words, max(2 * len(list_intersect(g.grams, n.grams)) / (len(g.grams) + len(n.grams))::DOUBLE) AS dice
  FROM grams g JOIN notices n
    ON len(g.grams) * {THRESHOLD} <= len(n.grams) * (2 - {THRESHOLD}) + 1e-9 AND len(n.grams) * {THRESHOLD} <= len(g.grams) * (2 - {THRESHOLD}) + 1e-9
  GROUP BY doc_id, license, words)
SELECT doc_id, license, max(dice) AS best_dice, count(*) AS n_units
FROM scored WHERE dice >= {THRESHOLD} GROUP BY doc_id, license
"""


def warc() -> str:
    return """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, row_number() OVER () AS n FROM pages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest, payload_bytes ORDER BY page_id DESC NULLS LAST, n) AS k,
         first_value(page_id) OVER (PARTITION BY payload_digest, payload_bytes ORDER BY page_id DESC NULLS LAST, n) AS original FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= 1000 THEN original END AS refers_to
FROM ranked
"""


def hard_negatives() -> str:
    return """
WITH e AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, a.v AS anchor_v, c.id AS id, c.label AS label, list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e a JOIN e c ON len(a.v) = len(c.v) WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, anchor_label, anchor_v, id AS positive_id, score AS positive_score FROM scored WHERE id != anchor_id AND label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label, anchor_v ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.anchor_v, p.positive_id, p.positive_score ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND p.anchor_label = s.anchor_label AND p.anchor_v = s.anchor_v
  WHERE s.label != s.anchor_label AND 100 * s.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
