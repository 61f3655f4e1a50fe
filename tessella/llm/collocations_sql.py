"""Phrase collocations as SQL for DuckDB."""

from __future__ import annotations

from .collocations import FIRST, LEAST, MOST_WORDS, SHARE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + d - 1] AS p FROM placed, range(1, {MOST_WORDS + 1}) t(d) WHERE i + d - 1 <= len(w)),
f AS (SELECT lang, p, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY lang, p HAVING count(*) >= {LEAST}),
candidates AS (SELECT * FROM f WHERE len(p) > 1),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates),
parts AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, s.n, (1000 * c.a * s.n) // (x.a * y.a) AS score
  FROM cuts c JOIN sizes s USING (lang) JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, z.p[i:i + d - 1] AS p, max(z.a) AS most
  FROM candidates z, range(2, {MOST_WORDS}) t(d), range(1, {MOST_WORDS}) u(i) WHERE d < len(z.p) AND i + d - 1 <= len(z.p) GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.p = c.p WHERE i.most IS NULL OR 100 * i.most < {SHARE} * c.a)
SELECT lang, row_number() OVER w AS rank, array_to_string(p, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) QUALIFY row_number() OVER w <= {FIRST}
"""
