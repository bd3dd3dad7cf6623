"""Registered query of ranked lexical search, with its SQL."""

from __future__ import annotations

from marginalia.llm import ranked
from marginalia.llm.common import table

OP11_SQL = r"""
WITH words AS (
  SELECT id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS id, doc_id, text FROM documents)),
p AS (SELECT id, doc_id, term, count(*) AS tf FROM words GROUP BY id, doc_id, term),
n AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY id),
g AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(N_docs AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, N_docs),
asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
s AS (
  SELECT item_id, p.id, p.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * N_docs) // L)))) AS BIGINT) AS score
  FROM asked JOIN p USING (term) JOIN w USING (term) JOIN n ON n.id = p.id, g GROUP BY item_id, p.id, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def op11(spark, sf_dir):
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_ranked_search": op11}
ORACLES = {"op11_ranked_search": OP11_SQL}
