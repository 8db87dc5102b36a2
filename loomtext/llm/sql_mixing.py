"""DuckDB SQL of the mixing operator as the query and the pipeline apply it; the raking is a recursive table."""

from __future__ import annotations

from .mixing import ALPHA, BRIEF, CUT, DIGITS, FIGURES, MARKED, MOST, SEED, SHARE, SIGNS, TOLERANCE

COLS = ("source", "lang", "topic")


def mixing_sql(docs: str = "documents", share: float = SHARE, alpha: float = ALPHA, seed: int = SEED) -> str:
    t = "coalesce(text, '')"
    words = f"trim(regexp_replace({t}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
    some = lambda chars: f"length({t}) - length(translate({t}, '{chars}', ''))"
    cols, shares = ", ".join(COLS), ", ".join(f"share_{c}" for c in COLS)
    targets = ",\n".join(f"t_{c} AS (SELECT {c}, w / sum(w) OVER () AS share_{c} FROM (SELECT {c}, pow(sum(mass), {alpha}) AS w FROM c GROUP BY {c}))" for c in COLS)
    joins = " ".join(f"JOIN t_{c} USING ({c})" for c in COLS)
    step = f"SELECT k + 1 AS k, {cols}, mass, {shares}, weight FROM r WHERE k < {MOST} AND NOT done"
    for c in COLS:
        step = f"SELECT k, {cols}, mass, {shares}, weight * share_{c} / sum(weight) OVER (PARTITION BY {c}) AS weight FROM ({step})"
    miss = ", ".join(f"abs(sum(weight) OVER (PARTITION BY {c}) / share_{c} - 1)" for c in COLS)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN {some(DIGITS)} > CAST({FIGURES} AS DOUBLE) * length({t}) THEN 'figures' WHEN {some(SIGNS)} > CAST({MARKED} AS DOUBLE) * length({t}) THEN 'marked' WHEN length({t}) < {BRIEF} THEN 'short' ELSE 'prose' END AS topic,
  CASE WHEN {words} = '' THEN 0 ELSE CAST(length({words}) - length(replace({words}, ' ', '')) + 1 AS BIGINT) END AS n_tokens FROM {docs}),
c AS (SELECT {cols}, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{targets},
r AS (
  SELECT 0 AS k, FALSE AS done, {cols}, mass, {shares}, mass / sum(mass) OVER () AS weight FROM c {joins}
  UNION ALL
  SELECT k, k % {CUT} = 0 AND max(miss) OVER () <= {TOLERANCE} AS done, {cols}, mass, {shares}, weight
  FROM (SELECT *, greatest({miss}) AS miss FROM ({step}))),
q AS (SELECT {cols}, mass, weight, weight / mass AS ratio FROM r WHERE k = (SELECT max(k) FROM r)),
f AS (SELECT {cols}, ratio, row_number() OVER o AS place,
  ({share} * sum(mass) OVER () - coalesce(sum(mass) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM q WINDOW o AS (ORDER BY ratio DESC, {cols})),
p AS (SELECT {cols}, coalesce(least(1.0, ratio * (SELECT arg_min(scale, place) FROM f WHERE scale * ratio <= 1 + 1e-12)), 1.0) AS probability FROM f)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(probability, 1.0), 6) AS probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(probability, 1.0) AS kept
FROM d LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
