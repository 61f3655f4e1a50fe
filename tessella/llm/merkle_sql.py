"""The Merkle manifest as SQL for DuckDB: the trees and the folds are recursive queries."""

from __future__ import annotations

from .merkle import FIELDS

_TEXT = {c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in FIELDS}
_LEAF = " || ".join(_TEXT.values())
_TAMPERED = " || ".join({**_TEXT, "text": _TEXT["text"].replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}.values())
#: CRC-32 of the decimal id: after each byte eight shifts, at which a set last bit turns the polynomial's bits.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(id) + 1), lambda i: [ord(id[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def _steps(name: str, nodes: str, rows: str, first: str) -> str:
    """The siblings of each of ``rows`` (row, tree, rank, n) at each level of its tree; numbered from ``first`` on."""
    return f"""
{name} AS (
  SELECT r.row, {first} + r.level AS step, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos < r.pos), '') AS l,
         coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos > r.pos), '') AS r
  FROM (SELECT *, rank >> (3 * level) AS pos FROM (SELECT *, unnest(range(depth)) AS level FROM {rows})) r
  JOIN {nodes} n ON n.tree = r.tree AND n.level = r.level AND n.pos >> 3 = r.pos >> 3
  GROUP BY r.row, r.depth0, r.level)"""


OP11_SQL = f"""
WITH RECURSIVE texts AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
leaves AS (
  SELECT coalesce('=' || lang, '') AS tree, doc_id, sha256({_LEAF}) AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN sha256({_TAMPERED}) ELSE sha256({_LEAF}) END AS seen FROM texts),
placed AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, n, 0 AS level, rank AS pos, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, (n + 7) // 8, level + 1, pos >> 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, n, level, pos >> 3),
subroots AS (
  SELECT tree, level AS depth, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS tree, trees AS n, 0 AS level, place AS pos, subroot AS digest FROM subroots
  UNION ALL
  SELECT tree, (n + 7) // 8, level + 1, pos >> 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY tree, n, level, pos >> 3),
root AS (SELECT digest AS root, level AS height FROM tops WHERE n = 1),
low AS (SELECT p.row, p.tree, p.rank, s.depth, 0 AS depth0 FROM placed p JOIN subroots s USING (tree)),
high AS (SELECT p.row, 0 AS tree, s.place AS rank, (SELECT height FROM root) AS depth, s.depth AS depth0 FROM placed p JOIN subroots s USING (tree)),
{_steps("low_steps", "nodes", "low", "r.depth0")},
{_steps("high_steps", "tops", "high", "r.depth0")},
steps AS (SELECT * FROM low_steps UNION ALL SELECT * FROM high_steps),
folds AS (
  SELECT row, 0 AS step, seen AS digest FROM placed
  UNION ALL
  SELECT f.row, f.step + 1, sha256(s.l || f.digest || s.r) FROM folds f JOIN steps s ON s.row = f.row AND s.step = f.step),
ends AS (SELECT row, arg_max(digest, step) AS folded_root FROM folds GROUP BY row),
proofs AS (SELECT row, string_agg(l || r, '' ORDER BY step) AS siblings FROM steps GROUP BY row)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root.root AS verified
FROM placed p JOIN subroots s USING (tree) JOIN ends USING (row) LEFT JOIN proofs USING (row) CROSS JOIN root
"""
