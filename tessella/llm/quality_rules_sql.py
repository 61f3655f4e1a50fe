"""The quality rules as SQL for DuckDB."""

from __future__ import annotations

from .quality_rules import BITS, LEAST_DOCS, LEAST_WORDS, MOST_REPEATED, RULES, WINDOW

_EACH = " UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, (1000 * {r.count}) // {r.of} AS value FROM counted WHERE {r.of} > 0" for r in RULES)
_LEVELS = {"fine": "lang, source", "coarse": "lang, NULL AS source", "whole": "NULL AS lang, NULL AS source"}


def _fences(level: str, keys: str) -> str:
    away = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN greatest({r.steps} * (q3 - q1), {r.least})" for r in RULES) + " END"
    return f"""
{level}_merged AS (SELECT {keys}, rule, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{level}_ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS docs FROM {level}_merged),
{level}_quartiles AS (
  SELECT lang, source, rule, max(docs) AS docs,
         min(CASE WHEN upto > (docs - 1) // 4 THEN bucket END) AS q1, min(CASE WHEN upto > (3 * (docs - 1)) // 4 THEN bucket END) AS q3
  FROM {level}_ranked GROUP BY lang, source, rule),
{level} AS (SELECT lang, source, rule, docs, q1 - {away} AS lo, q3 + {away} AS hi FROM {level}_quartiles)"""


def _inside(rule) -> str:
    value = f"(1000 * {rule.count}) // nullif({rule.of}, 0)"
    bounds = [f"{value} <= max(CASE WHEN rule = '{rule.name}' THEN hi END)"] + ([f"{value} >= max(CASE WHEN rule = '{rule.name}' THEN lo END)"] if rule.lower else [])
    return " AND ".join(f"coalesce({b}, false)" for b in bounds)


OP12_SQL = rf"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM words)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range({WINDOW}) t(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
vals AS ({_EACH}),
sketch AS (SELECT lang, source, rule, (value >> s) << s AS bucket, count(*) AS n FROM (SELECT *, CAST(greatest(length(bin(value)) - {BITS}, 0) AS BIGINT) AS s FROM vals) GROUP BY ALL),
{",".join(_fences(level, keys) for level, keys in _LEVELS.items())},
limits AS (
  SELECT f.lang, f.source, f.rule,
         CASE WHEN f.docs >= {LEAST_DOCS} THEN f.lo WHEN c.docs >= {LEAST_DOCS} THEN c.lo ELSE w.lo END AS lo,
         CASE WHEN f.docs >= {LEAST_DOCS} THEN f.hi WHEN c.docs >= {LEAST_DOCS} THEN c.hi ELSE w.hi END AS hi
  FROM fine f JOIN coarse c ON f.rule = c.rule AND f.lang IS NOT DISTINCT FROM c.lang JOIN whole w ON f.rule = w.rule),
judged AS (
  SELECT d.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, rule, lo, hi
  FROM counted d LEFT JOIN limits l ON d.lang IS NOT DISTINCT FROM l.lang AND d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_inside, RULES))} AS kept
FROM judged GROUP BY doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed
"""
