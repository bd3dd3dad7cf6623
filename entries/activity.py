"""Use signals, evaluation, catalog, board, lists, stories, changes, site, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from entries import sql as S
from entries.retrieval import bar
from marginalia import policy as P
from marginalia.functions.joins import shared_folder
from marginalia.functions.text import strings
from marginalia.operators import board as B
from marginalia.operators import catalog as C
from marginalia.operators import evals as E
from marginalia.operators import usage as U
from marginalia.sources import adapters as A
from marginalia.sources import files
from marginalia.streaming import events as ST

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- usage --------------------------------------------------------------------

_SETS = ["lexical", "lexical|vector", "vector"]
_EV = [
    ("ev", "SELECT event_id, ts, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type IN ('view', 'purchase', 'click')"),
    ("shown", " UNION ALL ".join(
        f"SELECT event_id AS search_id, ts AS search_ts, {r + 1}::BIGINT AS rank, 'chunk-' || ((k + {step}) % 100) AS chunk_id, 'vault/' || ((k + {step}) % 100) || '.md' AS source_path, "
        f"{S.cycle(_SETS, f'(event_id % 3 + {r})')} AS src FROM ev WHERE event_type = 'view'" for r, step in enumerate((0, 7, 13)))),
    ("asked", """SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'chunk-' || k END AS chunk_id, 'vault/' || k || '.md' AS source_path FROM ev WHERE event_type = 'purchase'"""),
    ("sig", """SELECT event_id, x.search_id, x.rank, x.chunk_id, x.source_path FROM (
      SELECT a.event_id, arg_max({'search_id': s.search_id, 'rank': s.rank, 'chunk_id': s.chunk_id, 'source_path': s.source_path}, {'t': s.search_ts, 'i': s.search_id, 'r': -s.rank}) AS x
      FROM asked a JOIN shown s ON (s.source_path = a.source_path OR s.chunk_id = a.chunk_id) AND (s.search_ts, s.search_id) < (a.ts, a.event_id) GROUP BY a.event_id)"""),
    ("weak", "SELECT event_id, k FROM ev WHERE event_type = 'view' AND event_id NOT IN (SELECT search_id FROM sig)"),
    ("sfp", """SELECT g.event_id, 'query ' || e.k AS query, s.rank, s.chunk_id, s.source_path, 'top_rank_but_lower_rank_won' AS reason FROM sig g JOIN ev e ON e.event_id = g.search_id
        JOIN shown s ON s.search_id = g.search_id AND s.rank = 1 WHERE g.rank <> 1 AND s.src = 'vector'
      UNION ALL SELECT w.event_id, 'query ' || w.k, s.rank, s.chunk_id, s.source_path, 'only_weak_use_query' FROM weak w JOIN shown s ON s.search_id = w.event_id WHERE s.src = 'vector'"""),
]


@register("chk_explode_results", S.with_(_EV[:2], "SELECT search_id AS event_id, (rank - 1)::INT AS position, rank, chunk_id, src AS sources FROM shown"))
def chk_explode_results(spark, sf):
    r = U.explode_results(U.searches(A.retrieval_events(spark, sf)))
    return r.select("event_id", "position", "rank", "chunk_id", bar("retrieval_sources").alias("sources"))


@register("jon_use_signals", S.with_(_EV, "SELECT event_id, search_id, rank, chunk_id, source_path FROM sig"))
def jon_use_signals(spark, sf):
    return U.use_signals(A.retrieval_events(spark, sf))


@register("rpt_weak_only", S.with_(_EV, """
SELECT w.event_id, 'query ' || w.k AS query, 3::BIGINT AS result_count, 'chunk-' || w.k AS top_chunk_id,
  (SELECT string_agg(s.rank::VARCHAR, '|' ORDER BY s.rank) FROM shown s WHERE s.search_id = w.event_id AND s.src = 'vector') AS vector_only_ranks FROM weak w"""))
def rpt_weak_only(spark, sf):
    e = A.retrieval_events(spark, sf)
    return U.weak_only(U.use_signals(e), e).select("event_id", "query", "result_count", "top_chunk_id", bar("vector_only_ranks").alias("vector_only_ranks"))


@register("rpt_lower_rank_wins", S.with_(_EV, """
SELECT g.event_id, 'query ' || e.k AS query, g.rank AS selected_rank, g.chunk_id AS selected_chunk_id, 'chunk-' || e.k AS top_chunk_id
FROM sig g JOIN ev e ON e.event_id = g.search_id WHERE g.rank > 1"""))
def rpt_lower_rank_wins(spark, sf):
    e = A.retrieval_events(spark, sf)
    return U.lower_rank_wins(U.use_signals(e), e).select("event_id", "query", "selected_rank", "selected_chunk_id", "top_chunk_id")


@register("rpt_semantic_false_positives", S.with_(_EV, "SELECT event_id, query, rank, chunk_id, source_path, reason FROM sfp"))
def rpt_semantic_false_positives(spark, sf):
    e = A.retrieval_events(spark, sf)
    return U.semantic_false_positives(U.use_signals(e), e)


@register("rpt_usage_report", S.with_(_EV, """
SELECT 'total_events' AS measure, count(*) AS n FROM ev UNION ALL SELECT 'search_events', count(*) FROM ev WHERE event_type = 'view'
UNION ALL SELECT 'queries', count(*) FROM ev WHERE event_type = 'view' UNION ALL SELECT 'context_events', count(*) FROM ev WHERE event_type = 'click'
UNION ALL SELECT 'unfold_events', count(*) FROM asked UNION ALL SELECT 'only_weak_use_queries', count(*) FROM weak
UNION ALL SELECT 'strong_use_from_lower_rank', count(*) FROM sig WHERE rank > 1 UNION ALL SELECT 'semantic_only_false_positives', count(*) FROM sfp"""))
def rpt_usage_report(spark, sf):
    return U.usage_report(A.retrieval_events(spark, sf))


# --- evaluation ---------------------------------------------------------------

_RES = """SELECT source AS query_id, lang AS mode, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rank, doc_id, 'doc-' || doc_id AS chunk_id,
  'vault/' || source || '/' || doc_id || '.md' AS source_file, split_part(text, chr(10), 1) AS heading, n_chars FROM documents"""


def _results(spark, sf):
    from marginalia.operators.lexical import top_pool

    d = A.table(spark, sf, "documents").select(
        F.concat_ws(":", "source", "lang").alias("query_id"), "source", "lang", "n_chars", "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("chunk_id"),
        F.concat(F.lit("vault/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("source_file"), F.substring_index("text", "\n", 1).alias("heading"))
    return top_pool(d, None, F.desc("n_chars"), "doc_id")


@register("evl_judged_retrieval", S.with_([("r", _RES), ("best", "SELECT query_id, min(chunk_id) FILTER (n_chars = m) AS expected FROM (SELECT *, max(n_chars) OVER (PARTITION BY query_id) AS m FROM r) GROUP BY ALL"),
    ("j", "SELECT DISTINCT query_id, mode FROM r")], """
SELECT j.mode, count(*) AS total, count(*) FILTER (r.chunk_id = b.expected) AS passed, count(*) FILTER (r.chunk_id <> b.expected) AS failed
FROM j JOIN best b USING (query_id) JOIN r ON r.query_id = j.query_id AND r.mode = j.mode AND r.rank = 1 GROUP BY j.mode"""))
def evl_judged_retrieval(spark, sf):
    r = _results(spark, sf).select(F.col("source").alias("query_id"), F.col("lang").alias("mode"), "rank", "chunk_id", "n_chars")
    best = r.groupBy("query_id").agg(F.min(F.struct(-F.col("n_chars"), "chunk_id")).alias("b")).select("query_id", F.col("b.chunk_id").alias("expected_chunk_id"))
    judgements = r.select("query_id", "mode").distinct().join(best, "query_id")
    return E.evaluation_summary(E.evaluate_retrieval(r, judgements))


@register("evl_hits_at_k", S.with_([("r", _RES)], """
SELECT query_id || ':' || mode AS query_id, '/' || doc_id || '.md' AS expected_path, rank <= 3 AS passed FROM r"""))
def evl_hits_at_k(spark, sf):
    r = _results(spark, sf)
    j = r.select("query_id", F.concat(F.lit("/"), "doc_id", F.lit(".md")).alias("expected_path"), F.when(F.col("rank") % 2 == 0, F.col("heading")).alias("expected_heading"))
    return E.evaluate_hits_at_k(r.select("query_id", "rank", "source_file", "heading"), j).select("query_id", "expected_path", "passed")


@register("evl_catalog", """
WITH r AS (SELECT p_brand, p_partkey, 'part-' || p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part),
j AS (SELECT p_brand, 'part-' || min(p_partkey) AS e1, list_distinct(['part-' || min(p_partkey), 'part-' || max(p_partkey)]) AS e3, ['part-' || arg_max(p_partkey, p_retailprice), 'none'] AS f FROM part GROUP BY p_brand)
SELECT j.p_brand AS query_id, (SELECT id FROM r WHERE r.p_brand = j.p_brand AND rank = 1) = e1 AS top_1_ok,
  list_has_all((SELECT list(id) FROM r WHERE r.p_brand = j.p_brand AND rank <= 3), e3) AS top_3_ok, NOT list_has_any((SELECT list(id) FROM r WHERE r.p_brand = j.p_brand), f) AS forbidden_ok FROM j""")
def evl_catalog(spark, sf):
    p = A.table(spark, sf, "part")
    name = lambda c: F.concat(F.lit("part-"), c)
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    ranked = p.select(F.col("p_brand").alias("query_id"), name(F.col("p_partkey")).alias("id"), F.row_number().over(w).alias("rank"))
    j = p.groupBy(F.col("p_brand").alias("query_id")).agg(
        name(F.min("p_partkey")).alias("expected_top_1"), F.array(name(F.min("p_partkey")), name(F.max("p_partkey"))).alias("expected_top_3"),
        F.array(name(F.max_by("p_partkey", "p_retailprice")), F.lit("none")).alias("forbidden"))
    return E.evaluate_catalog(ranked, j)


_KEYS = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN path || ' § ' || title || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE '' END END AS sp, path AS sf, title || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE '' END AS h FROM notes"""


@register("flt_find_chunk", S.with_([("notes", S.NOTES), ("corpus", S.CORPUS), ("keys", _KEYS)], """
SELECT doc_id AS key_id, (SELECT min(chunk_id) FROM corpus c WHERE CASE WHEN sp IS NOT NULL THEN c.source_path = sp ELSE c.source_file = sf AND c.heading = h END) AS chunk_id FROM keys"""))
def flt_find_chunk(spark, sf):
    n, k = A.notes(spark, sf), F.col("doc_id")
    odd = F.when(k % 7 == 0, "?").otherwise("")
    keys = n.select(k.alias("key_id"), F.when(k % 2 == 0, F.concat("path", F.lit(" § "), "title", odd)).alias("source_path"),
                    F.col("path").alias("source_file"), F.concat("title", odd).alias("heading"))
    return E.find_chunk(A.corpus(spark, sf), keys).select("key_id", "chunk_id")


_HEADS = [*P.REPO_CONTEXT_HEADINGS, "Other"]


@register("flt_repo_context", f"""
WITH c AS (SELECT 'c' || c_nationkey AS repo_slug, {S.cycle(_HEADS, 'c_custkey')} AS heading, 'chunk-' || lpad(c_custkey::VARCHAR, 9, '0') AS chunk_id, c_custkey FROM customer WHERE c_custkey % 3 <> 1 AND c_custkey % 10 <> 5)
SELECT repo_slug, list_position({S.array(_HEADS)}, heading) AS position, min(chunk_id) AS chunk_id FROM c WHERE heading <> 'Other' GROUP BY ALL""")
def flt_repo_context(spark, sf):
    c, k = A.table(spark, sf, "customer"), F.col("c_custkey")
    slug = F.concat(F.lit("c"), "c_nationkey")
    rows = c.select(
        slug.alias("repo_slug"), A.cycle(_HEADS, k).alias("heading"), F.concat(F.lit("chunk-"), F.lpad(k.cast("string"), 9, "0")).alias("chunk_id"),
        F.when(k % 3 == 1, "spec").otherwise("repo-home").alias("type"), F.lit("p").alias("source_path"), F.lit("t").alias("text"),
        F.concat(F.lit("vault/00 Repositories/"), slug, F.when(k % 10 == 5, "/Other.md").otherwise("/00 Repo Home.md")).alias("source_file"))
    return E.repo_context(rows, rows.select("repo_slug")).select("repo_slug", "position", "chunk_id")


# --- catalog ------------------------------------------------------------------

_CATALOG = f"""SELECT 'part-' || p_partkey AS id, p_name AS display_name, 'Handles ' || p_type || ' of size ' || p_size AS description, p_type AS tag, string_split(p_name, ' ') AS triggers,
  CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS banned, {S.cycle(P.CATALOG_GROUPS, 'p_partkey')} AS "group", {S.cycle(P.CATALOG_TIERS, 'p_partkey')} AS tier, p_partkey % 4 AS tr FROM part"""
_TASKS = f"""SELECT DISTINCT p_name AS task_id, CASE length(p_name) % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' for the notes' WHEN 2 THEN 'Brand#3 rules' WHEN 3 THEN 'zzz qqq ' || length(p_name) ELSE 'ECONOMY of ' || p_name END AS task FROM part"""


def _tasks(spark, sf):
    n = F.length("p_name")
    return A.table(spark, sf, "part").select(
        F.col("p_name").alias("task_id"),
        F.when(n % 5 == 0, F.col("p_name")).when(n % 5 == 1, F.concat("p_name", F.lit(" for the notes"))).when(n % 5 == 2, F.lit("Brand#3 rules"))
        .when(n % 5 == 3, F.concat(F.lit("zzz qqq "), n)).otherwise(F.concat(F.lit("ECONOMY of "), "p_name")).alias("task")).distinct()


_CT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: len(w) >= 2 AND NOT list_contains(" + S.array(P.CATALOG_STOP_WORDS) + ", w)))"
_ROUTE = [
    ("catalog", _CATALOG), ("tasks", _TASKS),
    ("el", """SELECT id, 'triggers' AS kind, unnest(triggers) AS text, 4 AS m FROM catalog UNION ALL SELECT id, 'tags', tag, 3 FROM catalog UNION ALL SELECT id, 'name', id || ' ' || display_name, 1 FROM catalog
      UNION ALL SELECT id, 'description', description, 1 FROM catalog UNION ALL SELECT id, 'anti', banned, 4 FROM catalog WHERE banned IS NOT NULL"""),
    ("elt", "SELECT kind, text, " + _CT.format("text") + " AS toks FROM (SELECT DISTINCT kind, text FROM el)"),
    ("tt", "SELECT *, " + _CT.format("task") + " AS toks FROM tasks"),
    ("es", "SELECT t.task_id, e.kind, e.text, 10 * contains(lower(trim(e.text)), lower(trim(t.task)))::INT + 2 * len(list_intersect(e.toks, t.toks)) AS s FROM elt e, tt t"),
    ("pairs", """SELECT es.task_id, el.id, sum(s * m) FILTER (el.kind = 'triggers') AS tr, sum(s * m) FILTER (el.kind = 'tags') AS tg, sum(s * m) FILTER (el.kind = 'name') AS nm,
        sum(s * m) FILTER (el.kind = 'description') AS ds, coalesce(sum(s * m) FILTER (el.kind = 'anti'), 0) AS an FROM es JOIN el USING (kind, text) GROUP BY ALL"""),
    ("ev", """SELECT p.*, c.tier, c.tr AS tier_rank, CASE WHEN tier = 'daily' THEN 0.5 ELSE 0 END + p.tr + tg + nm + ds - an AS evidence,
        contains(p.id, lower(t.task)) OR contains(lower(c.display_name), lower(t.task)) AS name_match, p.tr + tg + nm + ds + an > 0 AS touched
      FROM pairs p JOIN catalog c USING (id) JOIN tasks t USING (task_id)"""),
    ("act", """SELECT *, CASE WHEN tier = 'explicit' THEN CASE WHEN name_match THEN 0 ELSE 2 END WHEN tier = 'quiet' THEN CASE WHEN evidence >= 12 OR name_match THEN 0 ELSE 1 END ELSE 0 END AS activation,
      concat_ws('|', CASE WHEN tr > 0 THEN 'evidence match' END, CASE WHEN tg > 0 THEN 'tag match' END, CASE WHEN nm > 0 THEN 'name match' END, CASE WHEN ds > 0 THEN 'description match' END, CASE WHEN an > 0 THEN 'anti-trigger penalty' END) AS reasons FROM ev"""),
]


@register("cat_route_evidence", S.with_(_ROUTE, "SELECT task_id, id, evidence::DOUBLE AS evidence, name_match, activation, reasons FROM act WHERE touched OR name_match"))
def cat_route_evidence(spark, sf):
    d = C.activation(C.route_evidence(_tasks(spark, sf), A.catalog(spark, sf)))
    return d.select("task_id", "id", "evidence", "name_match", "activation", bar("reasons").alias("reasons"))


@register("cat_rank", S.with_(_ROUTE, """
SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY evidence DESC, activation, tier_rank, id) AS rank FROM act WHERE touched AND evidence > 0"""))
def cat_rank(spark, sf):
    d = C.rank_catalog(C.activation(C.route_evidence(_tasks(spark, sf), A.catalog(spark, sf))))
    return d.select("task_id", "id", F.col("rank").cast("long").alias("rank"))


_ROUTED = [*_ROUTE,
    ("top", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY evidence DESC, activation, tier_rank, id) AS rn FROM act WHERE evidence > 0) WHERE rn = 1"),
    ("prim", "SELECT t.task_id, t.task, coalesce(p.id, 'engineering-workflow') AS primary_id, coalesce(p.evidence, 0) AS pe FROM tasks t LEFT JOIN top p USING (task_id)"),
    ("sec", """SELECT a.task_id, a.id, a.evidence, a.activation, a.tier_rank FROM act a JOIN prim p USING (task_id)
      WHERE a.id <> p.primary_id AND a.evidence > CASE WHEN pe >= 20 THEN 8 WHEN pe >= 10 THEN 5 ELSE 3 END"""),
]


@register("cat_route", S.with_(_ROUTED, f"""
SELECT task_id, 'implement' AS mode, CASE WHEN pe >= 20 THEN 'high' WHEN pe >= 8 THEN 'medium' ELSE 'low' END AS confidence, primary_id AS "primary", pe::DOUBLE AS evidence,
  1 + (SELECT count(*) FROM sec s WHERE s.task_id = p.task_id) AS n_secondary,
  concat_ws('|', CASE WHEN regexp_matches(lower(task), {S.q(P.ROUTE_INFRA_PATTERN)}) THEN 'agent-infrastructure' END, CASE WHEN regexp_matches(lower(task), {S.q(P.ROUTE_MEMORY_PATTERN)}) THEN 'memory-note-routing' END) AS extra_rules FROM prim p"""))
def cat_route(spark, sf):
    d = C.route_tasks(_tasks(spark, sf), A.catalog(spark, sf))[0]
    return d.select("task_id", "mode", "confidence", "primary", "evidence", F.col("n_secondary").cast("long").alias("n_secondary"), bar("extra_rules").alias("extra_rules"))


@register("cat_route_secondary", S.with_(_ROUTED, """
SELECT task_id, 1 AS position, 'engineering-workflow' AS id FROM prim
UNION ALL SELECT task_id, 1 + row_number() OVER (PARTITION BY task_id ORDER BY evidence DESC, activation, tier_rank, id), id FROM sec"""))
def cat_route_secondary(spark, sf):
    d = C.route_tasks(_tasks(spark, sf), A.catalog(spark, sf))[1]
    return d.select("task_id", F.col("position").cast("long").alias("position"), "id")


_CQ = ["reddish widgets", "widget", "smal", "bolts and ringing", "ci pipeline ux", "part-12", "ECONOMI blu", "qqqq"]
_CQ_SQL = f"SELECT n_nationkey AS query_id, {S.cycle(_CQ, 'n_nationkey')} || CASE WHEN n_nationkey % 3 = 0 THEN ' ' || n_name ELSE '' END AS query FROM nation"


def _catalog_queries(spark, sf):
    k = F.col("n_nationkey")
    return A.table(spark, sf, "nation").select(k.alias("query_id"), F.concat(A.cycle(_CQ, k), F.when(k % 3 == 0, F.concat(F.lit(" "), "n_name")).otherwise("")).alias("query"))


_SYN = "CASE t " + " ".join(f"WHEN {S.q(k)} THEN {S.array(list(dict.fromkeys(w for p in v for w in p.split())))}" for k, v in P.CATALOG_SYNONYMS.items()) + " ELSE []::VARCHAR[] END"
_ENDS = "list_filter([CASE WHEN t LIKE '%ing' AND len(t) > 5 THEN t[:-4] END, CASE WHEN t LIKE '%ers' AND len(t) > 5 THEN t[:-4] END, CASE WHEN t LIKE '%ed' AND len(t) > 4 THEN t[:-3] END, CASE WHEN t LIKE '%s' AND len(t) > 3 THEN t[:-2] END], lambda x: x IS NOT NULL)"
_EXP = [
    ("cq", _CQ_SQL), ("ct", "SELECT *, " + S.ordered_distinct(_CT.format("query").replace("list_distinct(", "", 1)[:-1]) + " AS toks FROM cq"),
    ("cx", f"SELECT *, flatten(list_transform(toks, lambda t: list_concat([t], {_SYN}, {_ENDS}))) AS wide, len(list_filter(toks, lambda t: len({_SYN}) > 0)) > 0 AS has_synonym, len(list_filter(toks, lambda t: len({_SYN}) = 0 AND len({_ENDS}) > 0)) > 0 AS has_morphology FROM ct"),
    ("ce", "SELECT *, " + S.ordered_distinct(f"list_filter(wide, lambda w: len(w) >= 2 AND NOT list_contains({S.array(P.CATALOG_STOP_WORDS)}, w))") + " AS expanded FROM cx"),
]


@register("qry_catalog_expand", S.with_(_EXP, "SELECT query_id, array_to_string(toks, '|') AS tokens, array_to_string(expanded, '|') AS expanded, has_synonym, has_morphology FROM ce"))
def qry_catalog_expand(spark, sf):
    from marginalia.operators.queries import expand_catalog_query

    d = expand_catalog_query(_catalog_queries(spark, sf))
    return d.select("query_id", bar("tokens").alias("tokens"), bar("expanded_tokens").alias("expanded"), "has_synonym", "has_morphology")


_ST = "list_filter(regexp_split_to_array(lower({0}), '[\\s!-/:-@\\[-`{{-~]+'), lambda t: t <> '')"
_SEARCH = [*_EXP, ("catalog", _CATALOG),
    ("fl", " UNION ALL ".join(f"SELECT id, '{f}' AS field, {_ST.format(e)} AS toks FROM catalog" for f, e in
                              (("id", "id"), ("display_name", "display_name"), ("description", "description"), ("tags", "tag"), ("triggers", "display_name")))),
    ("post", "SELECT id, field, term, any_value(len) AS len, count(*) AS tf FROM (SELECT id, field, len(toks) AS len, unnest(toks) AS term FROM fl) GROUP BY id, field, term"),
    ("avgs", "SELECT field, sum(tf) * 1.0 / (SELECT count(*) FROM catalog) AS avg_len FROM post GROUP BY field"),
    ("dfs", "SELECT field, term, count(*) AS df FROM post GROUP BY ALL"),
    ("qt", "SELECT DISTINCT query_id, unnest(" + _ST.format("CASE WHEN len(expanded) > 0 THEN array_to_string(expanded, ' ') ELSE lower(query) END") + ") AS q FROM ce"),
    ("mt", """SELECT q, term, CASE WHEN q = term THEN 1.0 WHEN starts_with(term, q) THEN 0.375 * len(term) / (len(term) + 0.3 * (len(term) - len(q)))
        ELSE 0.45 * len(term) / (len(term) + levenshtein(q, term)) END AS w
      FROM (SELECT DISTINCT q FROM qt), (SELECT DISTINCT term FROM post) WHERE q = term OR starts_with(term, q) OR levenshtein(q, term) <= least(6, round(len(q) * 0.2))"""),
    ("sc", f"""SELECT qt.query_id, p.id, qt.q, sum(mt.w * {S.case(P.CATALOG_SEARCH_BOOSTS, 'p.field')} * ln(1 + ((SELECT count(*) FROM catalog) - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * len / avg_len)))) AS s
      FROM qt JOIN mt USING (q) JOIN post p USING (term) JOIN avgs USING (field) JOIN dfs USING (field, term) GROUP BY ALL"""),
    ("tot", "SELECT query_id, id, round(sum(s) * count(*), 6) AS evidence FROM sc GROUP BY ALL"),
    ("nm", "SELECT t.*, c.tier, c.tr, contains(id, lower(trim(query))) OR contains(lower(display_name), lower(trim(query))) AS name_match, has_synonym, has_morphology FROM tot t JOIN catalog c USING (id) JOIN ce USING (query_id)"),
]


@register("cat_search", S.with_(_SEARCH, """
SELECT query_id, id, round(evidence, 4) AS evidence, name_match, row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC,
  CASE WHEN tier = 'quiet' AND NOT name_match THEN 1 ELSE 0 END, tr, id) AS rank,
  concat_ws('|', CASE WHEN name_match THEN 'name' END, 'minisearch', CASE WHEN has_synonym THEN 'synonym' END, CASE WHEN has_morphology THEN 'query expansion' END) AS reasons
FROM nm WHERE tier <> 'explicit' OR name_match"""))
def cat_search(spark, sf):
    d = C.catalog_search(_catalog_queries(spark, sf), A.catalog(spark, sf))
    return d.select("query_id", "id", F.round("evidence", 4).alias("evidence"), "name_match", F.col("rank").cast("long").alias("rank"), bar("reasons").alias("reasons"))


@register("flt_list_catalog", S.with_([("catalog", _CATALOG)], "SELECT 'default' AS mode, id FROM catalog WHERE tier = 'daily' UNION ALL SELECT 'group', id FROM catalog WHERE \"group\" = 'support' UNION ALL SELECT 'all', id FROM catalog"))
def flt_list_catalog(spark, sf):
    c = A.catalog(spark, sf)
    pick = lambda mode, df: df.select(F.lit(mode).alias("mode"), "id")
    return pick("default", C.list_catalog(c)).unionByName(pick("group", C.list_catalog(c, group="support"))).unionByName(pick("all", C.list_catalog(c, include_all=True)))


@register("flt_read_catalog", S.with_([("catalog", _CATALOG)], """
SELECT name, min(c.id) AS id FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN ' PART-' || s_suppkey WHEN 1 THEN 'Red Widget' ELSE s_name END AS name FROM supplier GROUP BY ALL) n
LEFT JOIN catalog c ON lower(c.id) = lower(trim(name)) OR lower(c.display_name) = lower(trim(name)) GROUP BY name"""))
def flt_read_catalog(spark, sf):
    k = F.col("s_suppkey")
    names = A.table(spark, sf, "supplier").select(F.when(k % 3 == 0, F.concat(F.lit(" PART-"), k)).when(k % 3 == 1, "Red Widget").otherwise(F.col("s_name")).alias("name")).distinct()
    found, unknown = C.read_catalog_entries(A.catalog(spark, sf), names)
    return found.select("name", "id").unionByName(unknown.select("name", F.lit(None).cast("string").alias("id")))


@register("flt_content_fallback", f"""
WITH qs AS (SELECT item_id AS query_id, substr(text, 1 + (item_id % 30)::INT, 14) AS query FROM benchmark)
SELECT query_id, 'doc-' || doc_id AS id FROM qs, documents WHERE query_id % 4 <> 0 AND lower({S.strip('query')}) <> '' AND contains(lower(text), lower({S.strip('query')}))""")
def flt_content_fallback(spark, sf):
    qs = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.substring(F.col("text"), (F.lit(1) + F.col("item_id") % 30).cast("int"), F.lit(14)).alias("query"))
    src = A.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.col("text").alias("contents"))
    return C.content_fallback(qs, qs.filter("query_id % 4 = 0"), src).select("query_id", "id")


def _sources(spark, sf):
    p, k = A.table(spark, sf, "part"), F.col("p_partkey")
    s = p.select(F.concat(F.lit("part-"), k).alias("id"), F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), F.concat(F.lit("About "), "p_type").alias("description"),
                 F.lit("d").alias("source_dir"), F.lit("p").alias("path"))
    m = p.filter(k % 29 != 0).select(F.concat(F.lit("part-"), k).alias("id"), F.array(F.col("p_brand"), F.lit(" "), F.col("p_brand")).alias("tags"), F.split("p_name", " ").alias("triggers"),
                                     strings([]).alias("anti_triggers"), A.cycle([*P.CATALOG_GROUPS, "odd"], k).alias("group"), F.when(k % 3 == 0, "quiet").alias("tier"))
    return s, m


@register("jon_catalog", f"""
SELECT id, CASE WHEN k % 29 = 0 THEN 'missing_metadata' WHEN k % 31 = 0 THEN 'missing_name' WHEN k % 5 = 4 THEN 'invalid_group' END AS error,
  CASE WHEN k % 29 <> 0 AND k % 31 <> 0 AND k % 5 <> 4 THEN p_name || '/' || p_brand || '/' || {S.cycle([*P.CATALOG_GROUPS, 'odd'], 'k')} || '/' || CASE WHEN k % 3 = 0 THEN 'quiet' ELSE 'normal' END END AS entry
FROM (SELECT *, p_partkey AS k, 'part-' || p_partkey AS id FROM part)""")
def jon_catalog(spark, sf):
    good, bad = C.join_catalog(*_sources(spark, sf))
    ok = good.select("id", F.lit(None).cast("string").alias("error"), F.concat_ws("/", "display_name", bar("tags"), "group", "tier").alias("entry"))
    return ok.unionByName(bad.select("id", "error", F.lit(None).cast("string").alias("entry")))


@register("cat_drift", "SELECT 'part-' || p_partkey AS id, unnest(['stale', 'missing']) AS side FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 5 <> 4 AND p_size > 40")
def cat_drift(spark, sf):
    built = C.build_catalog(*_sources(spark, sf))
    changed = A.table(spark, sf, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("id"), "p_size")
    old = built.join(changed, "id").withColumn("tier", F.when(F.col("p_size") > 40, "explicit").otherwise(F.col("tier"))).select(*built.columns)
    return C.catalog_drift(old, built).select("id", "side")


# --- board --------------------------------------------------------------------

_BOARD = """SELECT 'task-' || o_orderkey AS id, 'Order ' || o_orderkey || ' for ' || o_custkey AS title, 'P' || least(substr(o_orderpriority, 1, 1)::INT - 1, 3) AS priority,
  CASE WHEN o_orderkey % 4 = 3 THEN 'Ready' WHEN o_orderstatus = 'O' THEN 'Backlog' WHEN o_orderstatus = 'P' THEN 'In Progress' ELSE 'Done' END AS section,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Because status ' || o_orderstatus END AS why, CASE WHEN o_orderkey % 7 = 0 THEN 'Ship on ' || strftime(o_orderdate, '%Y-%m-%d') END AS outcome,
  CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority END AS source, 'tasks/task-' || o_orderkey || '.md' AS task_file, o_orderkey AS k FROM orders"""
_SHIP = "priority IN ('P0', 'P2') AND contains(lower(concat_ws(' ', title, why, outcome, source)), 'ship on 199')"


@register("flt_tasks", S.with_([("t", _BOARD)], f"SELECT id FROM t WHERE {_SHIP}"))
def flt_tasks(spark, sf):
    return B.filter_tasks(A.tasks(spark, sf), "Ship on 199", ["P0", "P2"]).select("id")


@register("flt_facets", "SELECT count(*) AS rows_shown, count(DISTINCT p_brand) AS groups_shown FROM part WHERE contains(lower(p_name), 'wid') OR contains(lower(p_type), 'wid') OR contains(lower(p_brand), 'wid')")
def flt_facets(spark, sf):
    return B.facet_filter(A.table(spark, sf, "part"), "WID", ["p_name", "p_type", "p_brand"], "p_brand")[1]


@register("agg_board_counts", S.with_([("t", _BOARD)], f"""SELECT p AS measure, (SELECT count(*) FROM t WHERE priority = p) AS n FROM (SELECT unnest(['P0', 'P1', 'P2', 'P3']) AS p)
UNION ALL SELECT 'completed', count(*) FROM t WHERE section = 'Done' UNION ALL SELECT 'visible', count(*) FROM t WHERE {_SHIP}"""))
def agg_board_counts(spark, sf):
    t = A.tasks(spark, sf)
    return B.board_counts(t, B.filter_tasks(t, "Ship on 199", ["P0", "P2"]))


@register("agg_board", S.with_([("t", f"SELECT * FROM ({_BOARD}) WHERE section <> 'Ready'")], """
SELECT section, section_pos, id, priority FROM t JOIN (SELECT unnest(['Backlog', 'Ready', 'In Progress', 'Done']) AS section, unnest([0, 1, 2, 3]) AS section_pos) USING (section)
UNION ALL SELECT 'Ready', 1, NULL, NULL"""))
def agg_board(spark, sf):
    return B.board(A.tasks(spark, sf).filter("section <> 'Ready'"), by="priority").select("section", F.col("section_pos").alias("section_pos"), "id", "priority")


@register("jon_sync_board", S.with_([("t", _BOARD)], """
SELECT task_file, CASE WHEN k % 3 = 0 THEN 'delete' ELSE 'write' END AS action FROM t WHERE k % 3 = 0 OR k % 5 <> 0
UNION SELECT 'tasks/order-' || k || '-for-' || substr(title, length('Order ' || k || ' for ') + 1) || '.md', 'write' FROM t WHERE k % 3 <> 0 AND k % 5 = 0
UNION SELECT task_file, 'delete' FROM t WHERE k % 3 <> 0 AND k % 5 = 0"""))
def jon_sync_board(spark, sf):
    t = A.tasks(spark, sf)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    posted = t.filter(k % 3 != 0).withColumn("task_file", F.when(k % 5 != 0, F.col("task_file")))
    return B.sync_board(t, posted).select("task_file", "action")


def _task_notes(spark, sf):
    t = A.tasks(spark, sf)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    current = B.render_task(t.withColumn("details", F.when(k % 6 == 0, F.lit("line one\n\n## Notes\n\nline two"))), "shop")
    old = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("Priority: `"), "priority", F.lit("`")), F.concat(F.lit("Status: `"), "section", F.lit("`")),
                      F.lit("AI Appetite: 120%"), F.lit("Source: desk"), F.lit(""), F.lit("## Why"), F.lit(""), F.lit("old reason"))
    return current.select("task_file", F.when(k % 9 == 0, old).when(k % 10 == 0, F.lit("nothing here")).otherwise(F.col("content")).alias("content"))


@register("dq_parse_tasks", S.with_([("t", _BOARD)], """
SELECT id, title, priority, section, coalesce(CASE WHEN k % 9 = 0 THEN 100 WHEN k % 3 = 0 THEN (k % 101)::INT END, -1) AS effort,
  CASE WHEN k % 9 = 0 THEN 'old reason' ELSE why END AS why, CASE WHEN k % 9 <> 0 THEN outcome END AS outcome, CASE WHEN k % 9 = 0 THEN 'desk' ELSE source END AS source,
  CASE WHEN k % 9 = 0 THEN 'Priority: `' || priority || '`' || chr(10) || 'Status: `' || section || '`' || chr(10) || 'AI Appetite: 120%' || chr(10) || 'Source: desk'
    WHEN k % 6 = 0 THEN 'line one' || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || 'line two' END AS details
FROM t WHERE k % 9 = 0 OR k % 10 <> 0"""))
def dq_parse_tasks(spark, sf):
    return B.parse_task_notes(_task_notes(spark, sf)).select("id", "title", "priority", "section", F.coalesce("effort", F.lit(-1)).alias("effort"), "why", "outcome", "source", "details")


@register("dq_normalise_tasks", S.with_([("t", _BOARD)], """
SELECT id, CASE WHEN k % 4 = 1 THEN 'Backlog' ELSE section END AS section, CASE priority WHEN 'P0' THEN 30 WHEN 'P1' THEN 50 WHEN 'P2' THEN 70 ELSE 85 END AS suggested_effort,
  CASE WHEN k % 13 = 0 THEN 'Task ' || title || ' has an invalid priority' END AS error FROM t WHERE k % 13 <> 0
UNION ALL SELECT id, CASE WHEN k % 4 = 1 THEN 'Backlog' ELSE section END, -1, 'Task ' || title || ' has an invalid priority' FROM t WHERE k % 13 = 0"""))
def dq_normalise_tasks(spark, sf):
    t = A.tasks(spark, sf)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    posted = t.withColumn("priority", F.when(k % 13 == 0, "P9").otherwise(F.col("priority"))).withColumn("section", F.when(k % 4 == 1, "Elsewhere").otherwise(F.col("section"))).withColumn("list_section", F.lit("Backlog"))
    return B.normalise_tasks(posted).select("id", "section", F.coalesce("suggested_effort", F.lit(-1)).alias("suggested_effort"), "error")


# --- lists, stories, changes --------------------------------------------------

_TODO = [
    ("ev", """SELECT user_id::VARCHAR AS list_id, event_id AS seq, json_extract_string(props, '$.k') AS item_id, CASE event_type WHEN 'signup' THEN 'added' WHEN 'click' THEN 'toggled' WHEN 'error' THEN 'deleted'
      WHEN 'purchase' THEN CASE WHEN value > 300 THEN 'cleared' END END AS kind FROM events"""),
    ("b", "SELECT e.* FROM ev e LEFT JOIN (SELECT list_id, max(seq) AS r FROM ev WHERE kind = 'cleared' GROUP BY 1) c USING (list_id) WHERE kind IN ('added', 'toggled', 'deleted') AND (r IS NULL OR seq > r)"),
    ("d", "SELECT *, max(seq) FILTER (kind = 'deleted') OVER (PARTITION BY list_id, item_id) AS gone FROM b"),
    ("l", "SELECT *, min(seq) FILTER (kind = 'added') OVER (PARTITION BY list_id, item_id) AS born FROM d WHERE gone IS NULL OR seq > gone"),
    ("state", "SELECT list_id, item_id, 'item ' || item_id AS title, count(*) FILTER (kind = 'toggled' AND seq > born) % 2 = 1 AS completed, any_value(born) AS added_seq FROM l WHERE born IS NOT NULL GROUP BY list_id, item_id"),
]


@register("str_todo_state", S.with_(_TODO, "SELECT * FROM state"))
def str_todo_state(spark, sf):
    return B.todo_state(A.todo_events(spark, sf))


@register("agg_todo_stats", S.with_(_TODO, "SELECT list_id, count(*) AS total, count(*) FILTER (completed) AS done, count(*) FILTER (NOT completed) AS remaining FROM state GROUP BY list_id"))
def agg_todo_stats(spark, sf):
    return B.todo_stats(B.todo_state(A.todo_events(spark, sf)))


_STORY = [("s", """SELECT 'run-' || o_custkey AS run_id, o_custkey AS run_index, o_orderkey AS position, 'S-' || (o_orderkey % 50) AS story_id, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE 'Story ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 13 = 0 THEN 'done' WHEN o_orderkey % 19 = 0 THEN 'weird' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'in_progress' WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'blocked' END AS state,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 3 ELSE 99 END AS p FROM orders"""),
    ("r", "SELECT *, CASE state WHEN 'in_progress' THEN 0 WHEN 'pending' THEN 1 WHEN 'blocked' THEN 2 WHEN 'done' THEN 3 ELSE 99 END AS so FROM s"),
    ("w", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY so, p, position) AS rn FROM r WHERE state <> 'done') WHERE rn = 1")]


@register("win_next_story", S.with_(_STORY, "SELECT run_id, story_id, position, state FROM w"))
def win_next_story(spark, sf):
    return B.next_story(A.stories(spark, sf)).select("run_id", "story_id", "position", "state")


@register("win_next_story_global", S.with_(_STORY, "SELECT run_id, story_id, position FROM w ORDER BY so, p, run_index LIMIT 1"))
def win_next_story_global(spark, sf):
    return B.next_story_global(B.next_story(A.stories(spark, sf))).select("run_id", "story_id", "position")


@register("dq_check_runs", S.with_(_STORY, """
SELECT 'run-' || c_custkey AS run_id, 'empty_title' AS code, -1::BIGINT AS position FROM customer WHERE c_custkey % 12 = 0
UNION ALL SELECT 'run-' || c_custkey, 'no_stories', -1 FROM customer WHERE c_custkey NOT IN (SELECT run_index FROM s)
UNION ALL SELECT run_id, 'empty_story_title', position FROM s WHERE trim(title) = '' UNION ALL SELECT run_id, 'invalid_status', position FROM s WHERE state = 'weird'
UNION ALL SELECT run_id, 'duplicate_story_id', position FROM (SELECT *, row_number() OVER (PARTITION BY run_id, story_id ORDER BY position) AS rn FROM s) WHERE rn > 1"""))
def dq_check_runs(spark, sf):
    k = F.col("c_custkey")
    runs = A.table(spark, sf, "customer").select(F.concat(F.lit("run-"), k).alias("run_id"), F.when(k % 12 == 0, " ").otherwise(F.col("c_name")).alias("title"))
    return B.check_runs(runs, A.stories(spark, sf)).withColumn("position", F.coalesce("position", F.lit(-1)))


def _audit(skip_memory):
    verdict = "CASE WHEN NOT large THEN 'pass' " + ("" if skip_memory else "WHEN m = 0 THEN 'needs-memory' ") + "WHEN d > 0 THEN 'pass' ELSE 'needs-docs' END"
    return f"""WITH c AS (SELECT l_orderkey AS change_id, count(*) AS files, count(*) FILTER (l_partkey % 6 IN (1, 2)) AS d, count(*) FILTER (l_partkey % 6 = 2) AS m,
  count(*) FILTER (l_partkey % 6 IN (0, 4)) AS rel, count(*) FILTER (l_partkey % 6 = 4) AS st, coalesce(sum(l_quantity::BIGINT + l_linenumber) FILTER (l_partkey % 6 IN (0, 4)), 0)::BIGINT AS lines FROM lineitem GROUP BY 1),
g AS (SELECT *, rel >= 4 OR lines >= 120 OR st > 0 AS large FROM c)
SELECT change_id, files, d AS doc_files, m AS memory_files, rel AS relevant_files, st AS structural_files, lines AS relevant_lines, large, {verdict} AS verdict FROM g"""


@register("agg_audit_changes", _audit(False))
def agg_audit_changes(spark, sf):
    return B.audit_changes(A.changes(spark, sf))


@register("agg_audit_changes_no_memory", _audit(True))
def agg_audit_changes_no_memory(spark, sf):
    return B.audit_changes(A.changes(spark, sf), skip_memory=True)


# --- site ---------------------------------------------------------------------


def _posts(spark, sf):
    k = F.col("doc_id")
    return A.notes(spark, sf).select(
        F.concat(F.lit("post-"), k).alias("slug"), "title", "summary", F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")), "yyyy-MM-dd").alias("date"),
        F.array("repo_slug").alias("tags"), (k % 3 != 0).alias("published"), F.col("id").alias("source"), k.alias("k"))


@register("flt_published_posts", "SELECT 'post-' || doc_id AS slug, strftime(DATE '2020-01-01' + doc_id::INT, '%Y-%m-%d') AS date FROM documents WHERE doc_id % 3 <> 0")
def flt_published_posts(spark, sf):
    return B.published_posts(_posts(spark, sf)).select("slug", "date")


@register("flt_featured_posts", "SELECT 'post-' || doc_id AS slug FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id DESC LIMIT 2")
def flt_featured_posts(spark, sf):
    return B.featured_posts(_posts(spark, sf)).select("slug")


@register("flt_post_by_slug", "SELECT 'post-' || doc_id AS slug FROM documents WHERE doc_id % 3 <> 0 AND doc_id IN (7, 9)")
def flt_post_by_slug(spark, sf):
    p = _posts(spark, sf)
    return B.post_by_slug(p, "post-7").select("slug").unionByName(B.post_by_slug(p, "post-9").select("slug"))


@register("src_posts", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Invalid writing frontmatter in doc-' || doc_id ELSE 'post-' || doc_id || '|' || source || '|' || (doc_id % 3 <> 0) END AS row FROM documents""")
def src_posts(spark, sf):
    from marginalia.operators.notes import parse_frontmatter, split_frontmatter

    p = _posts(spark, sf)
    flag = F.when(F.col("k") % 5 == 0, F.lit("maybe")).otherwise(F.col("published").cast("string"))
    text = F.concat(F.lit("---\nslug: "), "slug", F.lit("\ntitle: 'T'\nsummary: 'S'\ndate: "), F.col("date"), F.lit("\ntags: ["), F.element_at("tags", 1), F.lit("]\npublished: "), flag, F.lit("\n---\nx"))
    parsed = parse_frontmatter(split_frontmatter(p.select("source", text.alias("content"))))
    posts, rejected = files.read_posts(parsed)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long").alias("doc_id")
    return posts.select(number("slug"), F.concat_ws("|", "slug", bar("tags"), F.col("published").cast("string")).alias("row")).unionByName(
        rejected.select(number("source"), F.col("error").alias("row")))


@register("agg_inventory_totals", "SELECT count(*) AS items, count(*) FILTER (n_nationkey % 2 = 0) AS linked_items FROM nation")
def agg_inventory_totals(spark, sf):
    n = A.table(spark, sf, "nation")
    item = F.struct(F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("href"), F.lit(None).cast("string").alias("note"))
    return B.inventory_totals(n.groupBy(F.col("n_regionkey").cast("string").alias("title")).agg(F.collect_list(item).alias("items")))


@register("prj_playback", """
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN event_type = 'error' OR value > 60 THEN 'idle' ELSE 'track' END AS state,
  CASE WHEN event_type = 'error' OR value > 60 THEN NULL ELSE 'Song ' || k END AS track, CASE WHEN event_type = 'error' OR value > 60 THEN NULL ELSE 'A' || k || ', B' END AS artist,
  CASE WHEN event_type = 'error' OR value > 60 THEN NULL WHEN event_type = 'click' THEN 'http://song/' || k ELSE 'https://open.spotify.com/' END AS song_url,
  event_type IN ('view', 'click') AND value <= 60 AS is_playing FROM e""")
def prj_playback(spark, sf):
    e = A.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    kind = F.col("event_type")
    track = F.struct(
        F.concat(F.lit("Song "), "k").alias("name"),
        F.array(F.struct(F.concat(F.lit(" A"), "k").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.lit("B ").alias("name"))).alias("artists"),
        F.struct(F.when(F.col("value") <= 60, F.array(F.struct(F.lit(" ").alias("url")), F.struct(F.lit(" http://art ").alias("url")))).alias("images")).alias("album"),
        F.struct(F.when(kind == "click", F.concat(F.lit("http://song/"), "k")).alias("spotify")).alias("external_urls"))
    payload = F.when(kind == "error", F.lit('{"item": {"artists": []}}')).when(
        kind.isin("view", "click"), F.to_json(F.struct(F.lit(True).alias("is_playing"), track.alias("item")))
    ).otherwise(F.to_json(F.struct(F.array(F.struct(track.alias("track"))).alias("items"))))
    return B.normalize_playback(e.select("event_id", payload.alias("payload"))).select("event_id", "state", "track", "artist", "song_url", "is_playing")


# --- files and streams --------------------------------------------------------


def scratch(spark):
    """A fresh folder beside the checkpoints."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def _raw_stream(spark, sf, name="events"):
    """A table as a stream; it may be one file or a folder of parts, so the name is a pattern that fits either."""
    return spark.readStream.schema(A.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _in_batches(spark, sf, base, start, batches=3, shuffled=False):
    """Run a stream over the events as they arrive in several parts, in order of time or in any; it resumes from its progress."""
    events = A.table(spark, sf, "events")
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [k / batches for k in range(1, batches)]).alias("c")).first()["c"]
    part = F.pmod(F.xxhash64("event_id"), F.lit(batches)) if shuffled else F.size(F.filter(F.lit(cuts), lambda c: c < F.unix_micros(F.col("ts").cast("timestamp"))))
    for k in range(batches):
        events.filter(part == k).write.mode("append").parquet(f"{base}/in")
        start(spark.readStream.schema(events.schema).parquet(f"{base}/in")).awaitTermination()


@register("src_event_log", S.with_(_EV[:2], "SELECT event_id, event_type <> 'view' AS other, (SELECT count(*) FROM shown WHERE search_id = event_id) AS n_results FROM ev"))
def src_event_log(spark, sf):
    out = scratch(spark) + "/log"
    files.append_events(A.retrieval_events(spark, sf), out)
    e = files.read_events(spark, out)
    return e.select("event_id", (F.col("tool") != "memory_search").alias("other"), F.coalesce(F.size("results"), F.lit(0)).cast("long").alias("n_results")).withColumn(
        "n_results", F.greatest("n_results", F.lit(0).cast("long")))


@register("str_ingest_events", S.with_(_EV[:1], "SELECT event_id, k FROM ev"))
def str_ingest_events(spark, sf):
    base = scratch(spark)
    ST.ingest(A.to_retrieval_events(_raw_stream(spark, sf)), f"{base}/out", f"{base}/progress").awaitTermination()
    e = spark.read.parquet(f"{base}/out")
    joined = e.select("event_id").join(A.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "event_id")
    return joined.select("event_id", "k")


@register("str_use_signals", S.with_(_EV, "SELECT event_id, search_id, rank FROM sig"))
def str_use_signals(spark, sf):
    base = scratch(spark)
    _in_batches(spark, sf, base, lambda stream: ST.ingest(
        ST.stream_use_signals(A.to_retrieval_events(stream)), f"{base}/out", f"{base}/progress"), shuffled=True)
    return ST.latest(spark.read.parquet(f"{base}/out"))


@register("str_todo_stream", S.with_(_TODO, "SELECT * FROM state"))
def str_todo_stream(spark, sf):
    base = scratch(spark)
    _in_batches(spark, sf, base, lambda stream: ST.todo_state_stream(A.to_todo_events(stream), f"{base}/state", f"{base}/progress"))
    return ST.todo_snapshot(spark, f"{base}/state")


@register("str_changed_notes", """
SELECT doc_id FROM documents WHERE doc_id % 17 <> 0 AND (doc_id % 23 = 0 OR doc_id % 9 = 0)""")
def str_changed_notes(spark, sf):
    """Streamed note rows against the last manifest: only new or changed ones are kept."""
    base = scratch(spark)
    docs, k = A.table(spark, sf, "documents"), F.col("doc_id")
    stream = _raw_stream(spark, sf, "documents")
    rows = stream.filter(k % 17 != 0).select(k.cast("string").alias("path"), F.col("text").alias("content"), (F.col("n_chars") + F.when(k % 9 == 0, 1).otherwise(0)).cast("double").alias("mtime_ms"))
    previous = docs.filter(k % 23 != 0).select(k.cast("string").alias("path"), F.col("n_chars").cast("double").alias("mtime_ms"), F.lit(True).alias("reusable"))

    def on_batch(batch, batch_id):
        from marginalia.plans.index import incremental

        incremental(previous, batch)[0].write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    ST.stream_changes(rows, on_batch, f"{base}/progress").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("path").cast("long").alias("doc_id"))


@register("str_index_update", S.with_(S.LEXICAL, "SELECT query_id, rank, chunk_id, score FROM lex"))
def str_index_update(spark, sf):
    """An index of older texts takes two batches of changes; a search then equals one over a rebuilt index.

    At first every fifth file lacks, every third has an older text, and every
    seventh has a copy that later goes.  The first batch brings the files of even
    numbers, the second those of odd ones and, again, some that did not change.
    """
    from marginalia.functions.joins import materialise
    from marginalia.operators import lexical as X
    from marginalia.operators import queries as Q
    from marginalia.plans import segments as G

    base, k = scratch(spark), F.col("doc_id")
    docs = A.table(spark, sf, "documents")
    older = docs.filter(k % 5 != 0).withColumn("text", F.when(k % 3 == 0, F.concat(F.lit("Older heading\n"), F.reverse("text"), F.lit(" older words"))).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(k % 3 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars")))
    copies = docs.filter(k % 7 == 0).withColumn("doc_id", k + 10**9)

    def corpus_of(rows, name):
        rows.write.mode("overwrite").parquet(f"{base}/{name}/documents.parquet")
        A.table(spark, sf, "labels").write.mode("overwrite").parquet(f"{base}/{name}/labels.parquet")
        return A.corpus(spark, f"{base}/{name}")

    first = corpus_of(older.unionByName(copies), "v0")
    G.update(spark, f"{base}/index", 0, first)
    gone = first.filter(F.col("note_id").rlike("^doc-1[0-9]{9}")).select(F.col("source_file").alias("path"))
    G.update(spark, f"{base}/index", 1, corpus_of(docs.filter((k % 2 == 0) & ((k % 5 == 0) | (k % 3 == 0))), "v1"), gone)
    G.update(spark, f"{base}/index", 2, corpus_of(docs.filter(k % 2 != 0), "v2"))
    corpus, index = G.load(spark, f"{base}/index")
    plans = materialise(Q.plan_queries(A.queries(spark, sf)))
    d = X.lexical_search(plans, index, corpus, pool=15)
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


@register("src_written_index", S.with_(S.LEXICAL, "SELECT query_id, rank, chunk_id, score FROM lex"))
def src_written_index(spark, sf):
    """Write every index table, posting blocks included, load them again and search the blocks by their bounds."""
    from marginalia.operators import lexical as X
    from marginalia.operators import pruning as PR
    from marginalia.operators import queries as Q
    from marginalia.functions.joins import materialise
    from marginalia.plans.search import SearchIndex

    base = scratch(spark) + "/index"
    n = A.notes(spark, sf).withColumn("validation_issues", strings([])).drop("body", "doc_id")
    corpus = A.corpus(spark, sf)
    rows = X.postings(corpus)
    from marginalia.operators import links as L

    files.write_index({
        "corpus": corpus, "notes": n, "chunks": A.chunks(spark, sf), "edges": L.split_links(A.link_rows(spark, sf), A.notes(spark, sf))[0],
        "lexical_postings": rows, "lexical_stats": X.field_stats(corpus)}, base)
    stored = spark.read.parquet(f"{base}/lexical_postings")
    files.write_index({"term_df": stored.groupBy("term").agg(F.count("*").alias("df"))}, base)
    built = X.index_from_tables(stored, spark.read.parquet(f"{base}/term_df"), spark.read.parquet(f"{base}/lexical_stats"))
    files.write_index({"lexical_blocks": PR.posting_blocks(built, spark.read.parquet(f"{base}/corpus"), per_block=256)}, base)
    index: SearchIndex = files.load_index(spark, base)
    plans = materialise(Q.plan_queries(A.queries(spark, sf)))
    d = X.lexical_search(plans, index.lexical, index.corpus, pool=15)
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")
