"""DuckDB SQL for the rows of ``mixing.scheduled`` with the default target."""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, chr(1) || 'null') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
totals AS (SELECT source, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM words GROUP BY source),
ends AS (SELECT CAST(sum(tokens) AS DOUBLE) AS whole, CAST(max(tokens) AS DOUBLE) AS most,
                CAST(min(tokens) FILTER (tokens > 0) AS DOUBLE) AS least FROM totals),
bisected(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1,
         CASE WHEN met THEN low ELSE middle END,
         CASE WHEN met THEN middle ELSE high END
  FROM (SELECT step, low, high, (low + high) / 2 AS middle,
               pow((least / whole) / (most / whole), (low + high) / 2 - 1.0) <= 2.0 AS met
        FROM bisected, ends WHERE step < 30)),
chosen AS (SELECT CASE WHEN pow((least / whole) / (most / whole), -1.0) <= 2.0 THEN 0.0 ELSE high END AS alpha
           FROM bisected, ends WHERE step = 30),
weighed AS (SELECT t.*, CASE WHEN tokens > 0 THEN pow(tokens / whole, alpha) END AS weight FROM totals t, ends, chosen),
granted AS (
  SELECT source, n_docs, tokens, CAST(ceil(sqrt(n_docs)) AS BIGINT) AS blocks,
         CAST(coalesce(floor(weight * (SELECT max(tokens / weight) FROM weighed) + 0.5), 0) AS BIGINT) AS granted
  FROM weighed),
spread AS (SELECT source, blocks, CASE WHEN tokens > 0 THEN granted // tokens ELSE 1 END AS epochs,
                  CASE WHEN tokens > 0 THEN granted % tokens ELSE 0 END AS rest FROM granted),
located AS (
  SELECT w.*, epochs, rest,
         CAST(('0x' || substr(md5('block0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % blocks AS block
  FROM words w JOIN spread USING (source)),
blocks AS (
  SELECT source, block, any_value(epochs) AS epochs, any_value(rest) AS rest, sum(n_tokens) AS block_tokens
  FROM located GROUP BY source, block),
placed AS (
  SELECT *, rest - (sum(block_tokens) OVER (PARTITION BY source ORDER BY md5('order0|' || epochs || '|' || block), block) - block_tokens) AS room
  FROM blocks),
reached AS (
  SELECT l.*, p.room, p.block_tokens,
         sum(l.n_tokens) OVER (PARTITION BY l.source, l.block ORDER BY md5('row0|' || l.epochs || '|' || doc_id), doc_id, l.n_tokens
                               ROWS UNBOUNDED PRECEDING) - l.n_tokens AS reached
  FROM located l JOIN placed p USING (source, block)),
drawn AS (
  SELECT doc_id, source, block, n_tokens, unnest(generate_series(0, epochs)) AS epoch, epochs, room, block_tokens, reached FROM reached),
kept AS (
  SELECT * FROM drawn WHERE epoch < epochs OR (room > 0 AND (room >= block_tokens OR reached < room))),
places AS (
  SELECT source, block, epoch, row_number() OVER (PARTITION BY source, epoch ORDER BY md5('order0|' || epoch || '|' || block), block) AS block_pos
  FROM (SELECT source, block, unnest(generate_series(0, epochs)) AS epoch FROM blocks))
SELECT doc_id, nullif(source, chr(1) || 'null') AS source, n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block AS INTEGER) AS block,
       CAST(block_pos AS INTEGER) AS block_pos,
       CAST(row_number() OVER (PARTITION BY source, block, epoch ORDER BY md5('row0|' || epoch || '|' || doc_id), doc_id, n_tokens) AS INTEGER) AS doc_pos
FROM kept JOIN places USING (source, block, epoch)
"""
