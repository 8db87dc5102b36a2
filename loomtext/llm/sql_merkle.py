"""DuckDB SQL of the hash tree."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 (reflected polynomial 0xEDB88320) of an ASCII string expression."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda c, k: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda a, b: {byte}), CAST(4294967295 AS BIGINT))"


def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def merkle_sql() -> str:
    return f"""
WITH RECURSIVE hit AS (SELECT *, n_chars IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS tampered FROM documents),
leaf AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN tampered THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS claim FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
tree AS (
  SELECT lang, 0 AS level, i, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2, n),
subs AS (SELECT lang, level AS above, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM subs
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM upper_tree WHERE n > 1 GROUP BY level, i // 2, n),
root AS (SELECT digest AS root FROM upper_tree WHERE n = 1),
doc AS (SELECT p.*, s.subroot, s.above, s.i AS sub FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT d.leaf, d.doc_id, d.lang, d.i, t.level AS step, (d.i >> t.level) & 1 AS side, s.digest AS sibling
  FROM doc d JOIN tree t ON d.lang IS NOT DISTINCT FROM t.lang AND t.i = d.i >> t.level AND t.n > 1
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.i = xor(t.i, 1)
  UNION ALL
  SELECT d.leaf, d.doc_id, d.lang, d.i, d.above + t.level, (d.sub >> t.level) & 1, s.digest
  FROM doc d JOIN upper_tree t ON t.i = d.sub >> t.level AND t.n > 1
  LEFT JOIN upper_tree s ON s.level = t.level AND s.i = xor(t.i, 1)),
paths AS (SELECT lang, i, list({{'side': side, 'sibling': coalesce(sibling, '')}} ORDER BY step) AS path, coalesce(string_agg(sibling, '' ORDER BY step), '') AS siblings FROM steps GROUP BY lang, i),
fold AS (
  SELECT d.lang, d.i, 1 AS step, d.claim AS digest, coalesce(p.path, []) AS path FROM doc d LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM d.lang AND p.i = d.i
  UNION ALL
  SELECT lang, i, step + 1, CASE WHEN path[step].side = 1 THEN sha256(path[step].sibling || digest) ELSE sha256(digest || path[step].sibling) END, path FROM fold WHERE step <= len(path)),
ended AS (SELECT lang, i, digest AS folded_root FROM fold WHERE step = len(path) + 1)
SELECT d.doc_id, d.leaf, d.subroot, root.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM doc d CROSS JOIN root JOIN ended e ON e.lang IS NOT DISTINCT FROM d.lang AND e.i = d.i
LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM d.lang AND p.i = d.i
"""
