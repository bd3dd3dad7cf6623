"""Registered query of the filter audit, with its SQL."""

from __future__ import annotations

from marginalia.llm import audit
from marginalia.llm.common import table

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(d.t, '[A-Z]')) > 2 * length(d.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > firsts.first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts ON firsts.t = d.t LEFT JOIN l ON l.doc_id = d.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, 1, CAST(i AS INTEGER) - 1) AS earlier, substr(filter_order, CAST(i AS INTEGER), 1) AS x FROM orders, range(1, 6) r(i)),
met AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails = x AS alone, contains(fails, x) AS fail,
    earlier <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone
  FROM cells, steps),
s AS (
  SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fail), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM s"""


def op13(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13}
ORACLES = {"op13_filter_audit": OP13_SQL}
