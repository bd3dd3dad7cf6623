"""Query understanding, lexical, vector and graph lanes, fusion, context."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from entries import sql as S
from marginalia import policy as P
from marginalia.functions.joins import materialise, shared_folder, small
from marginalia.functions.text import strings, tokenize
from marginalia.operators import corpus as C
from marginalia.operators import evals, fusion, lexical, links, usage, vectors
from marginalia.operators import queries as Q
from marginalia.plans import search as plan
from marginalia.sources import adapters as A
from marginalia.sources import files

AS_OF = "2024-12-31"
QUERIES, ORACLES = {}, {}

PROMPTS = [
    "What is the plan for", "recent Session log:", "next task,", "how does the API", "archived history of",
    "who owns the", "why rebuild", "Reference command", "handoff", "we decided to compare", "glossary meaning of",
    "cleanup and doctor", "what remains open", "overview repo architecture", "plain words about",
]


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def prompts(spark, sf):
    """Free-text questions from the event table."""
    e = A.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("query_id"),
        F.concat_ws(" ", A.cycle(PROMPTS, F.col("event_id")), "event_type", "props").alias("query"),
    )


PROMPTS_SQL = f"SELECT event_id AS query_id, {S.cycle(PROMPTS, 'event_id')} || ' ' || event_type || ' ' || props AS query FROM events"


def bar(c):
    return F.array_join(c, "|")


@register("qry_classify", S.with_([("queries", PROMPTS_SQL), *S.plans()], """
SELECT query_id, normalized, array_to_string(keywords, '|') AS keywords, intent,
  array_to_string(preferred_types, '|') AS preferred_types, array_to_string(excluded, '|') AS excluded_statuses FROM plans"""))
def qry_classify(spark, sf):
    d = Q.classify_queries(prompts(spark, sf))
    return d.select("query_id", "normalized", bar("keywords").alias("keywords"), "intent",
                    bar("preferred_types").alias("preferred_types"), bar("excluded_statuses").alias("excluded_statuses"))


@register("qry_expand", S.with_([("queries", PROMPTS_SQL), *S.plans()],
          "SELECT query_id, array_to_string(variants, '|') AS variants FROM plans"))
def qry_expand(spark, sf):
    return Q.expand_queries(Q.classify_queries(prompts(spark, sf))).select("query_id", bar("variants").alias("variants"))


@register("qry_plan", S.with_([("queries", PROMPTS_SQL), *S.plans()], """
SELECT query_id, intent, allow_archived, use_graph, needle, array_to_string(terms, '|') AS terms FROM plans"""))
def qry_plan(spark, sf):
    return Q.plan_queries(prompts(spark, sf)).select(
        "query_id", "intent", "allow_archived", "use_graph", "needle", bar("terms").alias("terms"))


def _inputs_sql():
    rules = " ".join(
        f"WHEN regexp_matches(lower({S.strip('query')}), {S.q(r[0])}) THEN {S.q('|'.join([r[1], r[2], r[3], ','.join(r[4])]))}"
        for r in P.INPUT_RULES)
    d = P.INPUT_DEFAULT
    picked = f"CASE {rules} ELSE {S.q('|'.join([d[0], d[1], d[2], ','.join(d[3])]))} END"
    return S.with_([("queries", PROMPTS_SQL), ("c", f"SELECT query_id, string_split({picked}, '|') AS x FROM queries")],
                   "SELECT query_id, x[1] AS request_intent, x[2] AS expected_note_type, x[3] AS reason, x[4] AS retrieval_types FROM c")


@register("qry_workflow_class", _inputs_sql())
def qry_workflow_class(spark, sf):
    d = Q.classify_inputs(prompts(spark, sf), "query")
    return d.select("query_id", "request_intent", "expected_note_type", "reason",
                    F.array_join("retrieval_types", ",").alias("retrieval_types"))


# --- corpus -------------------------------------------------------------------


@register("src_corpus", S.with_(S.base(), """
SELECT chunk_id, note_id, source_file, source_path, heading, type, sstatus AS status, repo_slug, tag AS tags, keyword AS keywords,
  summary, title, updated, validation_status, sha256(text) AS text_hash FROM corpus"""))
def src_corpus(spark, sf):
    n = A.notes(spark, sf).withColumn("validation_issues", strings([]))
    d = C.build_corpus(A.chunks(spark, sf), n)
    return d.select("chunk_id", "note_id", "source_file", "source_path", "heading", "type", "status", "repo_slug",
                    bar("tags").alias("tags"), bar("keywords").alias("keywords"), "summary", "title", "updated",
                    "validation_status", F.sha2("text", 256).alias("text_hash"))


@register("src_legacy_corpus", S.with_(S.base(), f"""
SELECT chunk_id, note_id, source_file, heading, title, status, type FROM (
  SELECT 'c-' || doc_id AS chunk_id, 'c-' || doc_id AS note_id, source_file, heading, heading AS title,
    CASE WHEN s IS NULL THEN CASE WHEN doc_id % 4 = 0 THEN 'architecture-record' ELSE 'x' END ELSE s END AS s0, s, t AS type,
    CASE WHEN s IS NULL THEN CASE WHEN t = 'architecture-record' THEN 'accepted' ELSE 'active' END
         WHEN s = 'active' AND t = 'architecture-record' THEN 'accepted' ELSE s END AS status
  FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'architecture-record' WHEN 1 THEN 'todo' WHEN 2 THEN 'custom' ELSE 'reference' END AS t,
               CASE doc_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'proposed' END AS s FROM corpus))"""))
def src_legacy_corpus(spark, sf):
    c, did = A.corpus(spark, sf), F.regexp_extract("note_id", r"(\d+)$", 1).cast("long")
    flat = c.select(
        F.concat(F.lit("c-"), did).alias("id"), F.lit(None).cast("string").alias("note_id"),
        F.lit(None).cast("string").alias("source_file"), "source_path", "heading",
        F.when(did % 4 == 0, "repo-decision").when(did % 4 == 1, "task").when(did % 4 == 2, "custom").alias("note_type"),
        F.when(did % 3 == 0, "In Progress").when(did % 3 == 1, "backlog").alias("status"),
        "repo_slug", "tags", "keywords", "summary", "text", "mtime_ms")
    return C.from_legacy_chunks(flat).select("chunk_id", "note_id", "source_file", "heading", "title", "status", "type")


@register("agg_corpus_stats", S.with_(S.base(), """
SELECT 'chunks' AS facet, 'all' AS key, count(*) AS n FROM corpus
UNION ALL SELECT 'vector_status', 'missing', 1
UNION ALL SELECT 'type', type, count(*) FROM corpus GROUP BY type
UNION ALL SELECT 'status', sstatus, count(*) FROM corpus GROUP BY sstatus"""))
def agg_corpus_stats(spark, sf):
    return C.corpus_stats(A.corpus(spark, sf))


# --- lexical ------------------------------------------------------------------

POSTING_COLS = ", ".join(
    f"coalesce(sum(tf.tf) FILTER (tf.f = '{f}'), 0)::BIGINT AS tf_{f}" for f in lexical.FIELDS)


@register("chk_postings", S.with_(S.base(*S.LEXICAL_TABLES), f"SELECT term, chunk_id, {POSTING_COLS} FROM tf GROUP BY ALL"))
def chk_postings(spark, sf):
    return lexical.postings(A.corpus(spark, sf)).select("term", "chunk_id", *[f"tf_{f}" for f in lexical.FIELDS])


@register("lex_index_stats", S.with_(S.base(*S.LEXICAL_TABLES), """
SELECT f AS field, sum(len)::BIGINT AS total, round(sum(len) * 1.0 / (SELECT count(*) FROM corpus), 6) AS avg_len,
  (SELECT count(*) FROM corpus) AS n_docs FROM lens GROUP BY f"""))
def lex_index_stats(spark, sf):
    s = lexical.field_stats(A.corpus(spark, sf))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"total_{f}").cast("long").alias("total")) for f in lexical.FIELDS])
    return s.select("n_docs", F.explode(rows).alias("x")).select(
        "x.field", "x.total", F.round(F.col("x.total") / F.col("n_docs"), 6).alias("avg_len"), "n_docs")


@register("lex_term_df", S.with_(S.base(*S.LEXICAL_TABLES), "SELECT term, df FROM dfs"))
def lex_term_df(spark, sf):
    return lexical.postings(A.corpus(spark, sf)).groupBy("term").agg(F.count("*").alias("df"))


def _parts(spark, sf):
    queries = A.queries(spark, sf)
    plans = materialise(Q.plan_queries(queries))
    corpus = materialise(A.corpus(spark, sf))
    terms = plans.select(F.explode("terms").alias("term")).distinct()
    return plans, corpus, lexical.build_lexical_index(corpus, terms)


@register("lex_bm25", S.with_(S.base(*S.plans(), *S.LEXICAL_TABLES, ("bm25", S.BM25)),
          "SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM bm25"))
def lex_bm25(spark, sf):
    plans, _, index = _parts(spark, sf)
    return lexical.bm25(plans, index).withColumn("bm25", F.round("bm25", 6))


# Short needles as well: one word, part of a word, a mark only.
NEEDLES = """
SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN array_to_string((regexp_extract_all(lower(text), '[a-z0-9/._-]+'))[1:2], ' ')
  WHEN 1 THEN substr(lower(text), 2, 5) WHEN 2 THEN substr(lower(text), 1, 18) WHEN 3 THEN '.' || chr(10) ELSE substr(lower(text), 4, 24) END AS query FROM benchmark
"""


def needles(spark, sf):
    low = F.lower("text")
    k = F.col("item_id") % 5
    return A.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(k == 0, F.concat_ws(" ", F.slice(tokenize("text"), 1, 2)))
        .when(k == 1, F.substring(low, 2, 5)).when(k == 2, F.substring(low, 1, 18)).when(k == 3, F.lit(".\n"))
        .otherwise(F.substring(low, 4, 24)).alias("query"))


def _phrase_base(queries):
    return [("notes", S.NOTES), ("corpus", S.CORPUS), ("queries", queries), *S.plans(), ("boosts", S.BOOSTS)]


_PHRASE_FINAL = """
SELECT query_id, chunk_id, phrase AS boost, concat_ws('|', CASE WHEN t_hit THEN 'exact-query-text' END,
  CASE WHEN h_hit THEN 'exact-query-heading' END, CASE WHEN s_hit THEN 'exact-query-summary' END) AS reasons FROM boosts WHERE phrase > 0"""


@register("lex_phrase_boosts", S.with_(_phrase_base(NEEDLES), _PHRASE_FINAL))
def lex_phrase_boosts(spark, sf):
    plans = materialise(Q.plan_queries(needles(spark, sf)))
    return lexical.phrase_boosts(plans, A.corpus(spark, sf)).select("query_id", "chunk_id", "boost", bar("reasons").alias("reasons"))


NAMED = """SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN 'Doc-' || doc_id WHEN 1 THEN 'Vault/' || source || '/' || lang || '/' || doc_id || '.md'
  WHEN 2 THEN upper(lang) ELSE ' ' || split_part(text, chr(10), 1) || ' ' END AS query FROM documents"""


@register("lex_identity_boosts", S.with_([("notes", S.NOTES), ("corpus", S.CORPUS), ("queries", NAMED), *S.plans(), ("pairs", """
SELECT query_id, chunk_id, c.note_id = needle AS i, lower(c.source_file) = needle OR lower(c.source_path) = needle AS p, lower(c.title) = needle AS t
FROM plans JOIN corpus c ON c.note_id = needle OR lower(c.source_file) = needle OR lower(c.source_path) = needle OR lower(c.title) = needle WHERE needle <> ''""")],
    """SELECT query_id, chunk_id, 20.0 * i::INT + 18.0 * p::INT + 12.0 * t::INT AS boost,
  concat_ws('|', CASE WHEN i THEN 'exact:id' END, CASE WHEN p THEN 'exact:path' END, CASE WHEN t THEN 'exact:title' END) AS reasons FROM pairs"""))
def lex_identity_boosts(spark, sf):
    d, did = A.table(spark, sf, "documents"), F.col("doc_id")
    named = d.select(did.alias("query_id"), F.when(did % 4 == 0, F.concat(F.lit("Doc-"), did))
                     .when(did % 4 == 1, F.concat(F.lit("Vault/"), "source", F.lit("/"), "lang", F.lit("/"), did, F.lit(".md")))
                     .when(did % 4 == 2, F.upper("lang"))
                     .otherwise(F.concat(F.lit(" "), F.substring_index("text", "\n", 1), F.lit(" "))).alias("query"))
    b = lexical.identity_boosts(Q.plan_queries(named), A.corpus(spark, sf))
    return b.select("query_id", "chunk_id", "boost", bar("reasons").alias("reasons"))


_HEUR = " UNION ALL ".join(
    f"SELECT chunk_id, term, {w} AS w FROM (SELECT DISTINCT chunk_id, unnest({e}) AS term FROM corpus)"
    for w, e in ((2.0, f"list_concat({S.tok('source_path')}, {S.tok('text')})"), (3.0, S.tok("source_path")),
                 (4.0, S.tok("keyword")), (2.0, S.tok("tag")), (3.0, S.tok("title"))))
_HEUR_ALL = """
SELECT query_id, chunk_id, sum(s) AS score FROM (
  SELECT p.query_id, h.chunk_id, h.w AS s FROM (SELECT query_id, unnest(terms) AS term FROM plans) p JOIN heur h USING (term)
  UNION ALL SELECT query_id, chunk_id, phrase + ident FROM boosts
  UNION ALL SELECT p.query_id, c.chunk_id,
    4.0 * (len(list_filter(p.variants, lambda v: contains(lower(c.source_path || chr(10) || c.text), lower(v)))) > 0)::INT
    + 3.0 * (len(list_filter(p.variants, lambda v: contains(lower(c.heading), lower(v)))) > 0)::INT
    + 6.0 * (contains(p.needle, 'decision') AND c.type = 'architecture-record')::INT
    + 6.0 * (contains(p.needle, 'session') AND c.type = 'session')::INT
    + 6.0 * (contains(p.needle, 'architecture') AND c.type = 'architecture-record')::INT FROM plans p, corpus c
) GROUP BY ALL"""
TOPICAL = f"SELECT item_id AS query_id, {S.cycle(['decision about', 'session on', 'architecture of', 'todo'], 'item_id')} || ' ' || array_to_string({S.tok('text')}, ' ') AS query FROM benchmark"


@register("lex_heuristic", S.with_([("notes", S.NOTES), ("corpus", S.CORPUS), ("queries", TOPICAL), *S.plans(), ("boosts", S.BOOSTS),
          ("heur", _HEUR), ("heur_all", _HEUR_ALL), ("lex", S.ranked("heur_all", 15, "score"))],
          "SELECT query_id, rank, chunk_id, score::DOUBLE AS score FROM lex"))
def lex_heuristic(spark, sf):
    b = A.table(spark, sf, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", A.cycle(["decision about", "session on", "architecture of", "todo"], F.col("item_id")),
                 *[F.concat_ws(" ", tokenize("text"))]).alias("query"))
    d = lexical.heuristic_lexical(materialise(Q.plan_queries(q)), A.corpus(spark, sf), pool=15)
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


@register("lex_search", S.with_(S.LEXICAL, "SELECT query_id, rank, chunk_id, score FROM lex"))
def lex_search(spark, sf):
    plans, corpus, index = _parts(spark, sf)
    d = lexical.lexical_search(plans, index, corpus, pool=15)
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


SCOPE = "WHERE repo_slug = 'src7' AND validation_status <> 'warning'"


@register("flt_scoped_search", S.with_([("notes", S.NOTES), ("corpus_all", S.CORPUS), ("queries", S.QUERIES), *S.plans(),
    *[(n, b.replace("FROM corpus", "FROM corpus_all").replace("count(*) FROM corpus_all)", "count(*) FROM corpus_all)")) for n, b in S.LEXICAL_TABLES],
    ("corpus", f"SELECT * FROM corpus_all {SCOPE}"),
    ("bm25", S.BM25.replace("FROM corpus)", "FROM corpus_all)")), ("boosts", S.BOOSTS), ("lex_all", S.LEX_ALL), ("lex", S.ranked("lex_all", 15))],
    "SELECT query_id, rank, chunk_id, score FROM lex"))
def flt_scoped_search(spark, sf):
    plans, corpus, index = _parts(spark, sf)
    d = lexical.lexical_search(plans, index, corpus, pool=15, repo_slug="src7", integrity_mode="exclude-warning")
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


@register("lex_duplicate_penalty", S.with_([("base_rows", """
SELECT (event_id % 50) AS query_id, json_extract_string(props, '$.k') AS note_id, 'c' || event_id AS chunk_id, value AS score FROM events"""),
    ("r", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM base_rows")],
    """SELECT query_id, chunk_id, rank, round(score - 3.0 * (row_number() OVER (PARTITION BY query_id, note_id ORDER BY rank) - 1), 3) AS score
    FROM r"""))
def lex_duplicate_penalty(spark, sf):
    e = A.table(spark, sf, "events").select(
        (F.col("event_id") % 50).alias("query_id"), F.get_json_object("props", "$.k").alias("note_id"),
        F.concat(F.lit("c"), "event_id").alias("chunk_id"), F.col("value").alias("score"))
    top = lexical.top_pool(e, None, F.desc("score"), F.col("chunk_id"))
    return lexical.duplicate_penalty(top).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


# --- vectors ------------------------------------------------------------------

_DICT = [("notes", S.NOTES), ("corpus", S.CORPUS), ("vtokens", f"SELECT chunk_id AS doc, unnest({S.tok('text')}) AS token FROM corpus"), *S.vector_ctes("vtokens")]


def _dictionary(spark, sf):
    return A.corpus(spark, sf).select(F.explode(tokenize("text")).alias("token")).distinct()


@register("vec_expand_tokens", S.with_(_DICT, "SELECT token, feature, w400::BIGINT AS w400, count(*) AS n FROM features GROUP BY ALL"))
def vec_expand_tokens(spark, sf):
    return vectors.expand_tokens(_dictionary(spark, sf)).groupBy("token", "feature", "w400").agg(F.count("*").alias("n"))


@register("vec_token_dims", S.with_(_DICT, "SELECT token, dim, w400 FROM token_dims"))
def vec_token_dims(spark, sf):
    return vectors.feature_dims(vectors.expand_tokens(_dictionary(spark, sf)))


_INPUT_SQL = [("notes", S.NOTES), ("corpus", S.CORPUS), ("vtokens", f"SELECT chunk_id AS doc, unnest({S.tok(S.CHUNK_INPUT)}) AS token FROM corpus"), *S.vector_ctes("vtokens")]


@register("vec_embed_chunks", S.with_(_INPUT_SQL, "SELECT doc AS chunk_id, dim, v FROM vec WHERE v <> 0"))
def vec_embed_chunks(spark, sf):
    d = vectors.embed_chunks(A.corpus(spark, sf))
    return d.select("chunk_id", F.posexplode("values").alias("dim", "v")).filter("v <> 0")


@register("vec_inputs", S.with_(S.base(*S.plans()), f"""
SELECT 'c' || note_id AS id, sha256({S.CHUNK_INPUT}) AS h FROM corpus UNION ALL SELECT 'q' || query_id, sha256({S.QUERY_INPUT}) FROM plans"""))
def vec_inputs(spark, sf):
    c = A.corpus(spark, sf).select(F.concat(F.lit("c"), "note_id").alias("id"), F.sha2(vectors.chunk_input(), 256).alias("h"))
    p = Q.plan_queries(A.queries(spark, sf)).select(F.concat(F.lit("q"), "query_id").alias("id"), F.sha2(vectors.query_input(), 256).alias("h"))
    return c.unionByName(p)


@register("vec_search", S.with_(S.base(*S.plans(), *S.VECTOR_TABLES), "SELECT query_id, rank, chunk_id, similarity FROM vlane"))
def vec_search(spark, sf):
    plans = materialise(Q.plan_queries(A.queries(spark, sf)))
    d = vectors.vector_search(plans, vectors.embed_chunks(A.corpus(spark, sf)), pool=15)
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "similarity")


@register("vec_label_neighbours", S.with_([
    ("unit", """SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE / n * 1e6)::BIGINT) AS v FROM
      (SELECT *, sqrt(list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b, 0.0::DOUBLE)) AS n FROM embeddings)"""),
    ("dims", "SELECT vec_id, label, unnest(v) AS v, generate_subscripts(v, 1) AS dim FROM unit"),
    ("cent", "SELECT label, dim, sum(v)::BIGINT AS s FROM dims GROUP BY ALL"),
    ("cnorm", "SELECT label, dim, round(s / sqrt(sum(s::DOUBLE * s::DOUBLE) OVER (PARTITION BY label)) * 1e6)::BIGINT AS c FROM cent"),
    ("dots", "SELECT c.label AS query_id, d.vec_id, sum(c.c * d.v)::BIGINT AS dot FROM cnorm c JOIN dims d USING (dim) GROUP BY ALL"),
    ("sim", "SELECT query_id, vec_id, floor((dot + 500000) / 1e6)::BIGINT / 1e6 AS similarity FROM dots WHERE dot > 0"),
    ("r", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sim WHERE similarity >= 0.18")],
    "SELECT query_id::BIGINT AS query_id, rank, vec_id, similarity FROM r WHERE rank <= 10"))
def vec_label_neighbours(spark, sf):
    """Nearest vectors of each label's mean vector."""
    v = A.driver_vectors(spark, sf)
    sums = v.select("label", F.posexplode("values").alias("dim", "x")).groupBy("label", "dim").agg(F.sum("x").alias("s"))
    # One row per label, 64 numbers each.
    means = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("d"))
    norm = F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + x["s"].cast("double") * x["s"].cast("double")))
    q = means.withColumn("norm", norm).select(
        F.col("label").cast("long").alias("query_id"),
        F.transform("d", lambda x: F.round(x["s"] / F.col("norm") * 1e6).cast("long")).alias("query_vector"),
        strings([]).alias("excluded_statuses"))
    d = vectors.similarity_top(v.withColumn("status", F.lit("")), q, id_col="vec_id", pool=10, keys=["vec_id"])
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "similarity")


# --- graph --------------------------------------------------------------------

_GRAPH = [("notes", S.NOTES), *S.GRAPH_TABLES]


def _edges(spark, sf):
    return links.split_links(A.link_rows(spark, sf), A.notes(spark, sf))


@register("jon_edges", S.with_(_GRAPH, "SELECT from_id, to_id, type FROM edges"))
def jon_edges(spark, sf):
    return _edges(spark, sf)[0]


@register("jon_unresolved_links", S.with_(_GRAPH, "SELECT DISTINCT from_id, target FROM links WHERE target NOT IN (SELECT id FROM notes)"))
def jon_unresolved_links(spark, sf):
    return _edges(spark, sf)[1]


@register("grf_two_hop", S.with_(_GRAPH, "SELECT seed, id, distance FROM two_hop"))
def grf_two_hop(spark, sf):
    return links.two_hop(_edges(spark, sf)[0], A.notes(spark, sf).select(F.col("id").alias("seed")))


@register("grf_link_lists", S.with_(_GRAPH, """
SELECT DISTINCT 'out' AS side, from_id, target AS to_id FROM links
UNION ALL SELECT DISTINCT 'in', from_id, target FROM links WHERE target IN (SELECT id FROM notes)"""))
def grf_link_lists(spark, sf):
    out, inbound = links.link_lists(A.link_rows(spark, sf), A.notes(spark, sf))
    return out.select(F.lit("out").alias("side"), "from_id", "to_id").unionByName(
        inbound.select(F.lit("in").alias("side"), "from_id", "to_id"))


# Body links in four shapes per note, then their resolution.
BODY = [
    "[a]({}.md#top)", "[[{}|label]]", "see [b](../de/{}.md?x=1) and [c](https://x.org/{})", "[[doc-{}#part]] [d](<./{}>)",
]


def _linked_notes(spark, sf):
    n, did = A.notes(spark, sf), F.col("doc_id")
    to = ((did * 5 + 1) % 997).cast("string")
    shape = did % 4
    body = F.coalesce(*[
        F.when(shape == i, F.concat(*[x for j, piece in enumerate(t.split("{}")) for x in
                                      ([to] if j else []) + [F.lit(piece)]])) for i, t in enumerate(BODY)])
    return n.select("id", "path", F.concat(F.lit("T "), did % 800).alias("title"), body.alias("body"), "type", "status")


_BODY_SQL = "CASE doc_id % 4 " + " ".join(
    f"WHEN {i} THEN " + " || ".join(x for j, piece in enumerate(t.split("{}")) for x in
                                    (["((doc_id * 5 + 1) % 997)"] if j else []) + [S.q(piece)]) for i, t in enumerate(BODY)) + " END"
_KEY = "lower(trim(regexp_replace(regexp_replace({0}, '^vault/', '', 'i'), '\\.md$', '', 'i')))"
_RESOLVE = [
    ("notes", S.NOTES),
    ("linked", f"SELECT id, path, 'T ' || (doc_id % 800) AS title, {_BODY_SQL} AS body, doc_id, repo_slug, tag FROM notes"),
    ("raw", """SELECT id AS from_id, path, repo_slug, 'markdown' AS kind, trim(unnest(regexp_extract_all(body, '\\[[^\\]]+\\]\\(([^)]+)\\)', 1))) AS target FROM linked
      UNION ALL SELECT id, path, repo_slug, 'wiki', trim(unnest(regexp_extract_all(body, '\\[\\[([^\\[\\]]+)\\]\\]', 1))) FROM linked"""),
    ("wanted", """SELECT *, CASE WHEN kind = 'wiki' THEN trim(split_part(split_part(target, '|', 1), '#', 1))
      ELSE trim(split_part(split_part(regexp_replace(target, '^<|>$', '', 'g'), '#', 1), '?', 1)) END AS w FROM raw"""),
    ("usable", "SELECT *, w <> '' AND NOT (kind = 'markdown' AND (regexp_matches(w, '^[a-z]+://', 'i') OR starts_with(w, 'mailto:'))) AS ok FROM wanted"),
    ("keyed", f"""SELECT *, lower(regexp_replace(regexp_replace(w, '^\\./', ''), '\\.md$', '', 'i')) AS k1,
      CASE WHEN starts_with(w, '../') THEN lower(repo_slug || '/' || regexp_replace(substr(w, 4), '\\.md$', ''))
           ELSE {_KEY.format("regexp_replace(path, '/[^/]*$', '') || '/' || regexp_replace(w, '^[.]/', '')")} END AS k2 FROM usable WHERE ok"""),
    ("paths", f"""SELECT key, min(id) AS id FROM (SELECT id, {_KEY.format('path')} AS key FROM linked
      UNION ALL SELECT id, split_part({_KEY.format('path')}, '/', -1) FROM linked) GROUP BY key HAVING count(DISTINCT id) = 1"""),
    ("titles", "SELECT lower(trim(title)) AS key, min(id) AS id FROM linked GROUP BY 1 HAVING count(DISTINCT id) = 1"),
    ("resolved", """SELECT k.from_id, k.kind, k.target, coalesce(n.id, p1.id, CASE WHEN k.kind = 'markdown' THEN p2.id ELSE t.id END) AS resolved
      FROM keyed k LEFT JOIN linked n ON n.id = k.w LEFT JOIN paths p1 ON p1.key = k.k1 LEFT JOIN paths p2 ON p2.key = k.k2
      LEFT JOIN titles t ON t.key = lower(trim(k.w))
      UNION ALL SELECT from_id, kind, target, NULL FROM usable WHERE NOT ok"""),
]


@register("chk_extract_links", S.with_(_RESOLVE[:3], "SELECT from_id, kind, target FROM raw"))
def chk_extract_links(spark, sf):
    return links.extract_links(_linked_notes(spark, sf)).select("from_id", "kind", "target")


@register("chk_explode_links", S.with_([("notes", S.NOTES), ("links", S.LINKS)], "SELECT from_id, link_group, target FROM links"))
def chk_explode_links(spark, sf):
    rows = A.link_rows(spark, sf)
    group = F.struct(*[F.when(F.col("link_group") == g, F.array("target")).otherwise(strings([])).alias(g) for g in P.LINK_GROUPS])
    return links.explode_links(rows.select(F.col("from_id").alias("id"), group.alias("links")))


@register("jon_resolve_links", S.with_(_RESOLVE, "SELECT from_id, kind, target, resolved FROM resolved"))
def jon_resolve_links(spark, sf):
    n = _linked_notes(spark, sf)
    return links.resolve_links(links.extract_links(n), n).select("from_id", "kind", "target", "resolved")


@register("grf_build_graph", S.with_([*_RESOLVE, ("links", S.LINKS), ("edges", S.EDGES)], """
SELECT 'edge' AS part, from_id, to_id, type FROM edges
UNION SELECT 'edge', from_id, resolved, 'references' FROM resolved WHERE resolved IS NOT NULL AND resolved <> from_id
UNION ALL SELECT 'node', id, NULL, type || ':' || status FROM notes"""))
def grf_build_graph(spark, sf):
    n = _linked_notes(spark, sf)
    nodes, edges, _ = links.build_graph(n, A.link_rows(spark, sf), links.extract_links(n))
    return edges.select(F.lit("edge").alias("part"), "from_id", "to_id", "type").unionByName(
        nodes.select(F.lit("node").alias("part"), F.col("id").alias("from_id"), F.lit(None).cast("string").alias("to_id"),
                     F.concat_ws(":", "type", "status").alias("type")))


@register("grf_search", S.with_([*S.LEXICAL, *S.GRAPH_TABLES, *S.FUSION_TABLES[:2]], "SELECT query_id, rank, chunk_id, score::DOUBLE AS score FROM glane"))
def grf_search(spark, sf):
    plans, corpus, index = _parts(spark, sf)
    ranked = materialise(lexical.lexical_search(plans, index, corpus, pool=15))
    d = links.graph_search(ranked, plans, _edges(spark, sf)[0], corpus, pool=15)
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


# --- hybrid -------------------------------------------------------------------

_HYBRID = [*S.LEXICAL, *S.GRAPH_TABLES, *S.VECTOR_TABLES, *S.FUSION_TABLES]


def hybrid(spark, sf, **options):
    queries = A.queries(spark, sf)
    index = plan.build_search_index(A.corpus(spark, sf), _edges(spark, sf)[0], queries)
    return plan.search(queries, index, as_of=AS_OF, limit=5, **options)


@register("fus_fused", S.with_(_HYBRID, """
SELECT query_id, frank AS fused_rank, chunk_id, fused_score, fused, coalesce(lr, 0) AS lexical_rank, coalesce(vr, 0) AS vector_rank,
  coalesce(gr, 0) AS graph_rank, coalesce(sim, 0) AS similarity FROM fused"""))
def fus_fused(spark, sf):
    plans, corpus, index = _parts(spark, sf)
    ranked = materialise(lexical.lexical_search(plans, index, corpus, pool=15))
    g = links.graph_search(ranked, plans, _edges(spark, sf)[0], corpus, pool=15)
    v = vectors.vector_search(plans, vectors.embed_chunks(corpus), pool=15)
    d = fusion.fuse(lexical.duplicate_penalty(ranked), v, g, 5)
    return d.select("query_id", F.col("fused_rank").cast("long").alias("fused_rank"), "chunk_id", "fused_score", "fused",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("lexical_rank", "vector_rank", "graph_rank")],
                    F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


@register("fus_search", S.with_(_HYBRID, f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id, score, fused FROM reranked WHERE {S.SUBSTANTIVE}"""))
def fus_search(spark, sf):
    return hybrid(spark, sf).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "fused")


@register("fus_search_no_vectors", S.with_([*S.LEXICAL, *S.GRAPH_TABLES,
          ("vlane", "SELECT query_id, chunk_id, rank, 0.0::DOUBLE AS similarity FROM lex WHERE false"), *S.FUSION_TABLES], f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id, score, 'disabled' AS vector_status FROM reranked WHERE {S.SUBSTANTIVE}"""))
def fus_search_no_vectors(spark, sf):
    return hybrid(spark, sf, vector_mode="off").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "vector_status")


_CONTEXT = S.with_([*S.LEXICAL, ("hits", "SELECT l.query_id, l.rank, l.chunk_id, greatest(1, ceil(length(c.text) / 4.0))::BIGINT AS t FROM lex l JOIN corpus c USING (chunk_id)")], """
SELECT query_id, array_to_string(list_transform(f.taken, lambda x: x), '|') AS items, array_to_string(list_transform(f.omitted, lambda x: x || ':token_budget'), '|') AS omitted,
  array_to_string(list_transform(f.taken, lambda x: split_part(x, ':', 2)), '|') AS note_ids, len(f.taken) AS n_taken,
  len(h)::BIGINT AS candidate_count, f.used AS estimated_tokens, len(f.omitted) > 0 AS truncated FROM (
  SELECT query_id, h, list_reduce(h, lambda a, x: CASE WHEN a.used + x.used <= 600
      THEN {'used': a.used + x.used, 'taken': list_concat(a.taken, x.taken), 'omitted': a.omitted}
      ELSE {'used': a.used, 'taken': a.taken, 'omitted': list_concat(a.omitted, x.taken)} END,
      {'used': 0::BIGINT, 'taken': []::VARCHAR[], 'omitted': []::VARCHAR[]}) AS f
  FROM (SELECT query_id, list({'used': t, 'taken': [chunk_id], 'omitted': []::VARCHAR[]} ORDER BY rank) AS h FROM hits GROUP BY query_id))""")


@register("ctx_assemble", _CONTEXT)
def ctx_assemble(spark, sf):
    plans, corpus, index = _parts(spark, sf)
    # Read twice, and few: texts of other chunks stay where they are.
    ranked = materialise(lexical.lexical_search(plans, index, corpus, pool=15))
    d = fusion.assemble_context(small(ranked).join(corpus.select("chunk_id", "text", "source_path", "type", "status", "validation_status", "validation_issues"), "chunk_id"))
    return d.select(
        "query_id", bar(F.transform("items", lambda h: h["chunk_id"])).alias("items"), bar(F.transform("omitted", lambda h: F.concat_ws(":", h["chunk_id"], h["reason"]))).alias("omitted"),
        bar(F.transform("references", lambda h: h["note_id"])).alias("note_ids"), F.col("selected_count").alias("n_taken"), "candidate_count", "estimated_tokens", "truncated")


@register("evl_golden_context", S.with_([*S.LEXICAL, ("h", "SELECT l.query_id, l.rank, l.chunk_id, greatest(1, ceil(length(c.text) / 4.0))::BIGINT AS t FROM lex l JOIN corpus c USING (chunk_id) WHERE l.rank <= 3")], """
SELECT query_id, chunk_id AS expected, passed, (a <= 400)::BIGINT + (b IS NOT NULL AND CASE WHEN a <= 400 THEN a ELSE 0 END + b <= 400)::BIGINT AS selected_count,
  CASE WHEN a <= 400 THEN a ELSE 0 END + CASE WHEN b IS NOT NULL AND CASE WHEN a <= 400 THEN a ELSE 0 END + b <= 400 THEN b ELSE 0 END AS context_tokens
FROM (SELECT query_id, max(t) FILTER (rank = 1) AS a, max(t) FILTER (rank = 2) AS b FROM h GROUP BY query_id)
JOIN (SELECT query_id, chunk_id, rank <= 3 AS passed FROM lex) USING (query_id)"""))
def evl_golden_context(spark, sf):
    """Every hit as an expected one: those of the first three pass; each with its query's small context."""
    plans, corpus, index = _parts(spark, sf)
    ranked = materialise(lexical.lexical_search(plans, index, corpus, pool=15))
    judgements = ranked.select("query_id", F.col("source_file").alias("expected_path"), F.lit(None).cast("string").alias("expected_heading"), F.col("chunk_id").alias("expected"))
    d = evals.golden_checks(ranked.join(corpus.select("chunk_id", "text"), "chunk_id"), judgements)
    return d.select("query_id", "expected", "passed", "selected_count", "context_tokens")


@register("src_hit_events", S.with_(S.LEXICAL, "SELECT query_id AS event_id, rank, chunk_id, score, true AS weak_use, false AS strong_use, 'lexical' AS sources FROM lex"))
def src_hit_events(spark, sf):
    """Hits as search events, logged in two batches, one of them twice, and read back."""
    plans, corpus, index = _parts(spark, sf)
    ranked = materialise(lexical.lexical_search(plans, index, corpus, pool=15)).withColumn("retrieval_sources", F.array(F.lit("lexical")))
    asked = plans.select("query_id", F.col("query_id").cast("long").alias("event_id"), F.timestamp_seconds(F.col("query_id").cast("long")).alias("timestamp"), "query")
    events, path = materialise(usage.shown_events(asked, ranked)), f"{shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    for batch in (0, 1, 1):
        files.append_events(events.filter(F.pmod("event_id", F.lit(2)) == batch), path, batch)
    return usage.explode_results(usage.searches(files.read_events(spark, path))).filter("rank IS NOT NULL").select(
        "event_id", "rank", "chunk_id", "score", "weak_use", "strong_use", bar("retrieval_sources").alias("sources"))


_IN_REPO = [(n, body.replace("NOT list_contains(p.excluded, c.sstatus)", "NOT list_contains(p.excluded, c.sstatus) AND c.repo_slug = p.query_id")) for n, body in _HYBRID]
_HOMED = f"""SELECT * REPLACE (CASE WHEN homed THEN 'repo-home' ELSE type END AS type, CASE WHEN homed THEN {S.q(P.REPO_CONTEXT_HEADINGS[0])} ELSE heading END AS heading,
  CASE WHEN homed THEN 'vault/{P.REPOSITORY_ROOT}/' || repo_slug || '/{P.REPO_HOME_FILE}' ELSE source_file END AS source_file)
FROM (SELECT *, repo_slug LIKE '%3' AND doc_id % 3 = 0 AS homed FROM ({S.CORPUS}))"""
_REPO_ASK = "SELECT DISTINCT source AS query_id, 'architecture spec plan memory ' || source AS query FROM documents WHERE source NOT IN (SELECT repo_slug FROM corpus WHERE homed)"


@register("flt_repo_search", S.with_([(n, {"corpus": _HOMED, "queries": _REPO_ASK}.get(n, body)) for n, body in _IN_REPO], f"""
SELECT query_id AS repo_slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS position, chunk_id, 'search' AS origin FROM reranked WHERE {S.SUBSTANTIVE}
UNION ALL SELECT repo_slug, 1, min(chunk_id), 'home' FROM corpus WHERE homed GROUP BY repo_slug"""))
def flt_repo_search(spark, sf):
    """FLT3: the context of every source: some have a home note, for the others the search answers."""
    corpus = A.corpus(spark, sf)
    home = F.col("repo_slug").endswith("3") & (F.substring_index("note_id", "-", -1).cast("long") % 3 == 0)
    named = corpus.withColumns({
        "type": F.when(home, "repo-home").otherwise(F.col("type")), "heading": F.when(home, F.lit(P.REPO_CONTEXT_HEADINGS[0])).otherwise(F.col("heading")),
        "source_file": F.when(home, F.concat(F.lit(f"vault/{P.REPOSITORY_ROOT}/"), "repo_slug", F.lit(f"/{P.REPO_HOME_FILE}"))).otherwise(F.col("source_file"))})
    index = plan.build_search_index(named, _edges(spark, sf)[0], plan.repo_queries(corpus))
    return plan.repo_context(corpus.select("repo_slug"), index, as_of=AS_OF)
