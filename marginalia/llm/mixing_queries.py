"""Registered query of the source mix, with its SQL."""

from __future__ import annotations

from marginalia.llm import mixing
from marginalia.llm.common import table

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS si FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][si % 3 + 1] AS DOUBLE) AS weight, 3 * words AS most, CAST(sum(words) OVER () AS DOUBLE) AS budget FROM s),
f AS (
  SELECT *, (budget - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    >= most * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM w WINDOW o AS (ORDER BY most / weight, si)),
t AS (
  SELECT *, CASE WHEN is_full THEN CAST(most AS DOUBLE)
    ELSE weight * (budget - coalesce(sum(most) FILTER (is_full) OVER (), 0)) / sum(weight) FILTER (NOT is_full) OVER () END AS target FROM f),
q AS (SELECT *, least(CAST(floor(target) AS BIGINT), most) AS quota, (words + 511) // 512 AS blocks FROM t),
passes AS (SELECT si, words, quota, e, unnest(range(0, blocks)) AS b FROM (SELECT *, unnest(range(0, (quota + words - 1) // words)) AS e FROM q WHERE quota > 0)),
lengths AS (SELECT *, least(512, words - b * 512) AS n, md5('0:' || si || ':' || e || ':' || b) AS k FROM passes),
walk AS (SELECT si, e, b, n, e * words + sum(n) OVER (PARTITION BY si, e ORDER BY n < 512, k, b) - n AS before, quota FROM lengths),
uses AS (SELECT si, b, least(n, quota - before) AS take FROM walk WHERE quota > before),
p AS (
  SELECT d.doc_id, d.size, q.si, q.words, q.target,
    sum(d.size) OVER (PARTITION BY q.si ORDER BY md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS o,
    row_number() OVER () AS id
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT p.doc_id, p.size, p.words AS source_size, p.target,
  CAST(coalesce(sum(greatest(0, least(o + size, b * 512 + take) - greatest(o, b * 512))) FILTER (u.take IS NOT NULL), 0) AS BIGINT) AS taken
FROM p LEFT JOIN uses u ON u.si = p.si AND u.b >= o // 512 AND u.b <= (o + size - 1) // 512 AND size > 0
GROUP BY p.id, p.doc_id, p.size, p.words, p.target"""


def op12(spark, sf_dir):
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


QUERIES = {"op12_source_mix": op12}
ORACLES = {"op12_source_mix": OP12_SQL}
