"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .sql_merkle import merkle_sql
from .sql_mixing import mixing_sql
from .sql_trie import trie_sql

OP1_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     1 + CAST((CAST('0x' || substr(hex || '0', CAST(1 + (i * 5) // 4 AS INT), 2) AS INT) >> (8 - 5 - (i * 5) % 4)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM q
"""


_LINKED = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + <width> - 1), ' ')) AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - <width> + 1, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS node FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id<kept>
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def linked_sql(width: int, kept: bool) -> str:
    """Components of documents whose shingles are alike."""
    return _LINKED.replace("<width>", str(width)).replace("<kept>", ", w.doc_id = c.component_id AS kept" if kept else "")


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_WARC, "op2_minhash": linked_sql(4, kept=True), "op6_mixing": mixing_sql(), "op11_merkle": merkle_sql(), "op12_trie": trie_sql(), "op13_ngram_join": linked_sql(5, kept=False)}
