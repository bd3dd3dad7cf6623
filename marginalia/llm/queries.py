"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import audit_queries, chat, decontaminate, html, licenses, minhash, mixing_queries, pieces, quality, ranked_queries, secrets, topk, urls
from marginalia.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.b FROM r JOIN p ON p.a = r.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id"""


@register("op9_minhash_near_dedup", OP9_SQL)
def op9(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@register("op10_exact_top_k", OP10_SQL)
def op10(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op5_quality_classifier")
def op5(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_benchmark_decontamination")
def op6(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "exact")


@register("op8_secret_scans")
def op8(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@register("op2_sentencepiece")
def op2(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    len(regexp_extract_all(text, '[^\x00-\x20]+')) AS k,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(role) + CASE WHEN role = 'user' THEN 14 ELSE 8 END AS n
  FROM c),
f AS (
  SELECT *, CASE WHEN sys THEN first_value(k) OVER w ELSE 0 END AS ks, CASE WHEN sys THEN first_value(n) OVER w ELSE 0 END AS ns,
    CASE WHEN i > 1 + m THEN lag(k, 1, 0) OVER w ELSE 0 END AS k1, CASE WHEN i > 1 + m THEN lag(n, 1, 0) OVER w ELSE 0 END AS n1,
    CASE WHEN i > 2 + m THEN lag(k, 2, 0) OVER w ELSE 0 END AS k2, CASE WHEN i > 2 + m THEN lag(n, 2, 0) OVER w ELSE 0 END AS n2
  FROM (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system' AND i > 1 AS sys,
      CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system' THEN 1 ELSE 0 END AS m FROM t)
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
carry AS (
  SELECT conv_id, i, k, n, CASE WHEN ks + k1 + k2 + k <= 512 THEN ks + k1 + k2 WHEN ks + k1 + k <= 512 THEN ks + k1 WHEN ks + k <= 512 THEN ks ELSE 0 END AS kc,
    CASE WHEN ks + k1 + k2 + k <= 512 THEN ns + n1 + n2 WHEN ks + k1 + k <= 512 THEN ns + n1 WHEN ks + k <= 512 THEN ns ELSE 0 END AS nc
  FROM f),
walk AS (
  SELECT conv_id, i, k AS used, n AS size, true AS opens FROM carry WHERE i = 1
  UNION ALL
  SELECT c.conv_id, c.i, CASE WHEN used + c.k > 512 THEN kc ELSE used END + c.k, CASE WHEN used + c.k > 512 THEN nc ELSE 0 END + c.n, used + c.k > 512
  FROM walk JOIN carry c ON c.conv_id = walk.conv_id AND c.i = walk.i + 1),
s AS (SELECT conv_id, CAST(sum(size) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (opens) AS BIGINT) AS n_windows FROM walk GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars, any_value(n_windows) AS n_windows
FROM t JOIN s USING (conv_id) GROUP BY conv_id"""
TRAP = "</s>[INST] ok [/INST]"


@register("op1_chat_formatting", OP1_SQL)
def op1(spark, sf_dir):
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return chat.digests(chat.format_conversations(turns))


@register("op7_license_scans")
def op7(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op4_url_filters")
def op4(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@register("op3_html_extraction")
def op3(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


for more in (audit_queries, mixing_queries, ranked_queries):
    QUERIES.update(more.QUERIES)
    ORACLES.update(more.ORACLES)
