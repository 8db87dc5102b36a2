"""DuckDB SQL of the conversation prefix trie."""

from __future__ import annotations

from .sql_merkle import crc32_sql


def trie_sql() -> str:
    return f"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
full_ AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY i) AS ts FROM turns GROUP BY c),
h AS (SELECT c, ts, {crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM full_),
rebuilt AS (SELECT a.c, list_concat(coalesce(list_slice(b.ts, 1, a.h), []), list_slice(a.ts, a.h + 1, len(a.ts))) AS ts FROM h a LEFT JOIN full_ b ON b.c = a.c - a.c % 100),
entry AS (SELECT c, len(ts) AS len, d, list_slice(ts, 1, d) AS p, CASE WHEN d = 0 THEN 0 ELSE length(ts[d].text) END AS size FROM rebuilt, LATERAL (SELECT unnest(range(0, len(ts) + 1)) AS d)),
node AS (SELECT p, d, min(c) AS rep, count(*) AS n, max(len) AS deepest, min(size) AS size, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len = d), '') AS ends FROM entry GROUP BY p, d),
pair AS (SELECT a.rep AS arep, a.d AS ad, b.rep AS brep, b.d AS bd, b.deepest = b.d AS leaf, (b.n - 1) * b.size AS saved
  FROM node b JOIN entry e ON e.c = b.rep AND e.d <= b.d JOIN node a ON a.p = e.p AND a.d = e.d),
tot AS (SELECT arep, ad, CAST(sum(CAST(leaf AS INT)) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(CAST(bd = ad + 1 AS INT)) AS BIGINT) AS n_children FROM pair GROUP BY arep, ad)
SELECT n.rep AS conv_id, n.d AS depth, q.rep AS parent_conv_id, n.n AS n_convs, t.n_children, t.n_leaves, t.saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN tot t ON t.arep = n.rep AND t.ad = n.d LEFT JOIN node q ON q.d = n.d - 1 AND q.p = list_slice(n.p, 1, n.d - 1)
"""
