"""Parsing, chunking, registry, governance and migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries import sql as S
from entries.retrieval import AS_OF, bar
from marginalia import policy as P
from marginalia.functions import text as T
from marginalia.functions.joins import spread
from marginalia.operators import governance as G
from marginalia.operators import links as L
from marginalia.operators import migration as M
from marginalia.operators import notes as N
from marginalia.operators import registry as R
from marginalia.plans import index as I
from marginalia.sources import adapters as A
from marginalia.sources import files

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- text expressions ---------------------------------------------------------


@register("prj_text_measures", f"""
SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens_estimated, len({S.tok('text')})::BIGINT AS n_tokens,
  sha256(array_to_string({S.tok('text')}, ' ')) AS token_hash, {S.SUBSTANTIVE} AS substantive, sha256({S.CONTENT}) AS content_hash FROM documents""")
def prj_text_measures(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", T.estimate_tokens("text").alias("tokens_estimated"), F.size(T.tokenize("text")).cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(T.tokenize("text"), " "), 256).alias("token_hash"), T.is_substantive("text").alias("substantive"),
                    F.sha2(T.content_only("text"), 256).alias("content_hash"))


_STOP = S.array(P.CATALOG_STOP_WORDS)
_CAT = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: len(w) >= 2 AND NOT list_contains(" + _STOP + ", w))"


@register("prj_catalog_tokens", "SELECT p_partkey, array_to_string(" + S.ordered_distinct(_CAT.format("p_name || ' for the ' || p_type || ' ' || p_name")) + ", '|') AS tokens FROM part")
def prj_catalog_tokens(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select("p_partkey", bar(T.catalog_tokens(F.concat("p_name", F.lit(" for the "), "p_type", F.lit(" "), "p_name"))).alias("tokens"))


_GOV_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_HEAD = "text"


@register("prj_slugs", f"""
SELECT doc_id, {_GOV_SLUG.format(_HEAD)} AS governance, substr({_GOV_SLUG.format(_HEAD)}, 1, 64) AS story,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_HEAD}), '[`''"“”‘’().,:/]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS board,
  lower({S.collapse("regexp_replace(" + _HEAD + ", '[—–-]', ' ', 'g')")}) AS comparable FROM documents""")
def prj_slugs(spark, sf):
    h = F.col("text")
    return A.table(spark, sf, "documents").select("doc_id", *[T.slugify(h, s).alias(s) for s in ("governance", "story", "board", "comparable")])


@register("chk_trigrams", f"""
SELECT gram, count(*) AS n FROM (SELECT unnest(CASE WHEN len(t) <= 3 THEN [t] ELSE list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3)) END) AS gram
  FROM (SELECT DISTINCT unnest({S.tok('text')}) AS t FROM documents)) GROUP BY gram""")
def chk_trigrams(spark, sf):
    words = A.table(spark, sf, "documents").select(F.explode(T.tokenize("text")).alias("t")).distinct()
    return words.select(F.explode(T.trigrams("t")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_X = S.collapse("text")
_QT = f"list_filter({S.tok('q')}, lambda t: len(t) > 2)"


@register("prj_excerpt", f"""
WITH d AS (SELECT doc_id, {_X} AS c, source || ' ' || substr(text, 300, 12) AS q FROM documents),
m AS (SELECT *, list_min(list_filter(list_transform({_QT}, lambda t: instr(lower(c), t)), lambda i: i > 0)) - 1 AS hit FROM d),
w AS (SELECT *, greatest(0, hit - 80) AS s, least(length(c), greatest(0, hit - 80) + 240) AS e FROM m)
SELECT doc_id, CASE WHEN length(c) <= 240 THEN c WHEN hit IS NULL THEN regexp_replace(substr(c, 1, 220), '\\s+$', '') || chr(10) || '...[truncated]'
  ELSE CASE WHEN s > 0 THEN '... ' ELSE '' END || trim(substr(c, s + 1, e - s)) || CASE WHEN e < length(c) THEN ' ...' ELSE '' END END AS excerpt FROM w""")
def prj_excerpt(spark, sf):
    d = A.table(spark, sf, "documents").withColumn("q", F.concat_ws(" ", "source", F.substring("text", 300, 12)))
    return d.select("doc_id", T.excerpt(F.col("text"), F.col("q")).alias("excerpt"))


@register("prj_search_normal_forms", f"""
SELECT o_orderkey, coalesce({S.case(P.TYPE_ALIASES, 't')}, t, 'reference') AS search_type,
  CASE WHEN v IS NULL THEN CASE WHEN coalesce({S.case(P.TYPE_ALIASES, 't')}, t) = 'architecture-record' THEN 'accepted' ELSE 'active' END
       WHEN v = 'active' AND coalesce({S.case(P.TYPE_ALIASES, 't')}, t) = 'architecture-record' THEN 'accepted' ELSE v END AS search_status
FROM (SELECT *, coalesce({S.case(P.STATUS_ALIASES, 'lower(s)')}, s) AS v FROM (SELECT o_orderkey,
    nullif({S.cycle([*P.TYPE_ALIASES, 'custom', ''], 'o_orderkey')}, '') AS t, nullif({S.cycle(['In Progress', 'READY', 'draft', 'odd', '', 'Completed', 'current'], 'o_custkey')}, '') AS s FROM orders))""")
def prj_search_normal_forms(spark, sf):
    from marginalia.operators.corpus import normalize_for_search

    o = A.table(spark, sf, "orders").select(
        "o_orderkey", A.cycle([*P.TYPE_ALIASES, "custom", ""], F.col("o_orderkey")).alias("type"),
        A.cycle(["In Progress", "READY", "draft", "odd", "", "Completed", "current"], F.col("o_custkey")).alias("status"))
    return normalize_for_search(o).select("o_orderkey", "search_type", "search_status")


# --- Markdown notes from conversations ----------------------------------------

_MD = f"""
SELECT conv_id, min(text) FILTER (turn = t0) AS first_text, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn, role, text) AS rest
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations) GROUP BY conv_id
"""
_FOLDER = S.cycle(["03 Sessions", "04 Tasks", "specs", "misc"], "conv_id")
_RAWTYPE = S.cycle(["repo-session", "task", "Repo-Spec", "unknown"], "conv_id")
_RAWSTATUS = S.cycle(["In Progress", "draft", "done"], "conv_id")
_TYPE = S.cycle(["session", "todo", "spec", "reference"], "conv_id")
_ALIAS = S.cycle(["active", "proposed", "done"], "conv_id")
_pairs = S.array([f"{t}|{s}" for t, g in P.REGISTRY_STATUSES.items() for s in g])
_STATUS = f"CASE WHEN list_contains({_pairs}, type || '|' || alias) THEN alias ELSE {S.case(P.DEFAULT_STATUS, 'type')} END"
_FRONT = (
    f"'---' || chr(10) || 'type: ' || {_RAWTYPE} || chr(10) || 'status: ' || {_RAWSTATUS} || CASE WHEN conv_id % 5 <> 0 THEN chr(10) || 'id: conv-' || conv_id ELSE '' END "
    "|| chr(10) || 'repo: talk' || chr(10) || 'tags: [chat, ''c' || (conv_id % 3) || ''']' || chr(10) || 'created: ' || created || chr(10) || '---' || chr(10)"
)
_NOTE_CTES = [
    ("md", _MD),
    ("n0", f"""SELECT *, {_FOLDER} || '/conv-' || conv_id || '.md' AS path, {_TYPE} AS type, {_ALIAS} AS alias, {_RAWSTATUS} AS raw_status, {_RAWTYPE} AS raw_type,
      strftime(DATE '2024-01-01' + (conv_id % 300)::INT, '%Y-%m-%d') AS created, '# conv ' || conv_id || chr(10) || chr(10) || rest AS body FROM md"""),
    ("n", f"""SELECT *, {_STATUS} AS status, {_FRONT} || body AS content,
      CASE WHEN conv_id % 5 <> 0 THEN 'conv-' || conv_id ELSE 'mem-' || substr(sha256(path), 1, 16) END AS id,
      coalesce(list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda b: {S.collapse("array_to_string(list_filter(string_split(b, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(trim(l), '#') AND NOT starts_with(trim(l), '- ')), ' ')")}), lambda p: p <> '')[1], '') AS summary FROM n0"""),
]


def _parsed(spark, sf):
    return N.parse_frontmatter(N.split_frontmatter(A.markdown_notes(spark, sf)))


@register("prj_split_frontmatter", S.with_(_NOTE_CTES, """
SELECT path, sha256(body) AS body_hash, length(content) - length(body) - 9 AS block_length FROM n"""))
def prj_split_frontmatter(spark, sf):
    d = N.split_frontmatter(A.markdown_notes(spark, sf))
    return d.select("path", F.sha2("body", 256).alias("body_hash"), F.length("block").cast("long").alias("block_length"))


@register("prj_index_notes", S.with_(_NOTE_CTES, """
SELECT id, 'vault/' || path AS path, type, status, 'talk' AS repo_slug, 'conv ' || conv_id AS title, summary, 'chat|c' || (conv_id % 3) AS tags, created, created AS updated,
  sha256(content) AS content_hash, conv_id % 5 = 0 AS synthetic_id, lower(raw_type) <> type AS type_normalized, lower(raw_status) <> status AS status_normalized FROM n"""))
def prj_index_notes(spark, sf):
    return N.index_notes(_parsed(spark, sf)).select(
        "id", "path", "type", "status", "repo_slug", "title", "summary", bar("tags").alias("tags"), "created", "updated", "content_hash",
        "synthetic_id", "type_normalized", "status_normalized")


_CHUNK_CTES = [*_NOTE_CTES, ("c", f"""
SELECT n.id AS note_id, n.type, n.status, row_number() OVER (PARTITION BY n.conv_id ORDER BY t.turn, t.role, t.text) - 1 AS idx, t.role || ' ' || t.turn AS heading, n.path,
  'Source: vault/' || n.path || chr(10) || 'Heading: ' || t.role || ' ' || t.turn || chr(10) || 'Type: ' || n.type || chr(10) || 'Repo: talk' || chr(10) || 'Status: ' || n.status
  || chr(10) || 'Tags: chat, c' || (n.conv_id % 3) || CASE WHEN n.summary <> '' THEN chr(10) || 'Summary: ' || n.summary ELSE '' END
  || chr(10) || chr(10) || {S.strip("'## ' || t.role || ' ' || t.turn || chr(10) || chr(10) || t.text")} AS text FROM n JOIN conversations t USING (conv_id)""")]
_CHUNK_ID = "'chunk:' || note_id || ':' || lpad(idx::VARCHAR, 4, '0') || ':' || substr(sha256(text), 1, 8)"


@register("chk_build_chunks", S.with_(_CHUNK_CTES, f"""
SELECT {_CHUNK_ID} AS chunk_id, note_id, 'vault/' || path || ' § ' || heading AS source_path, heading, 2 AS heading_level,
  greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens_estimated, sha256(text) AS content_hash, type, status FROM c"""))
def chk_build_chunks(spark, sf):
    return N.build_chunks(N.index_notes(_parsed(spark, sf))).select(
        "chunk_id", "note_id", "source_path", "heading", "heading_level", "tokens_estimated", "content_hash", "type", "status")


@register("src_index_build", S.with_(_CHUNK_CTES, f"""
SELECT n.id, n.path AS path, count(*) AS n_chunks, array_to_string(list({_CHUNK_ID} ORDER BY idx), '|') AS chunk_ids,
  CASE WHEN n.conv_id % 5 = 0 OR n.summary = '' OR lower(raw_type) <> n.type OR lower(raw_status) <> n.status THEN 'warning' ELSE 'ok' END AS validation_status
FROM n JOIN c ON c.note_id = n.id GROUP BY ALL"""))
def src_index_build(spark, sf):
    idx = I.build_index(A.markdown_notes(spark, sf))
    return idx.notes.select("id", F.substring("path", F.lit(7), F.length("path")).alias("path"), F.size("chunk_ids").cast("long").alias("n_chunks"), bar("chunk_ids").alias("chunk_ids"), "validation_status")


@register("src_index_manifest", S.with_(_CHUNK_CTES, "SELECT (SELECT count(*) FROM n) AS notes, (SELECT count(*) FROM c) AS chunks, 'talk' AS repo_slug"))
def src_index_manifest(spark, sf):
    idx = I.build_index(A.markdown_notes(spark, sf))
    m = files.index_manifest(idx.notes.select("id", "path", "repo_slug", "content_hash"), idx.chunks, idx.edges)
    return m.select("notes", "chunks", "repo_slug")


# Notes of one parse task: orders are compact, a split of them holds millions.
ROWS_PER_TASK = 50_000
# Frontmatter variants from orders: flow lists, nested maps, quotes, faults.
_YAML = ["id: o-{k}", "type: {t}", "repo_slug: shop", "title: '{k}'", "status: {s}", "created: {d}", "updated: {d}",
         "owner: {o}", "summary: sum {k}", "tags: [a, b, a]", "keywords: {w}", "links:\n  parents: [p{k}]\n  children: []\n  related: []\n  supersedes: []\n  superseded_by: []",
         "retention:\n  review_after: {r}\n  expires_after: null\n  keep: {q}"]
_T8 = [*P.NOTE_TYPES, "odd"]
_S6 = [*P.NOTE_STATUSES, ""]


def yaml_notes(spark, sf):
    o, k = spread(A.table(spark, sf, "orders"), ROWS_PER_TASK), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fills = {
        "k": k.cast("string"), "t": A.cycle(_T8, k), "s": A.cycle(_S6, F.col("o_custkey")),
        "d": F.when(k % 10 == 0, F.lit("soon")).otherwise(day), "o": A.cycle(["agent", "human", "nobody"], k),
        "w": A.cycle(["[x]", "word", "[]"], F.col("o_custkey")), "r": F.when(k % 4 == 0, day).otherwise("null"),
        "q": A.cycle(["true", "false", "maybe"], k)}
    text = F.lit("---\n" + "\n".join(_YAML) + "\n---\nbody\n")
    for name, c in fills.items():
        text = F.replace(text, F.lit("{" + name + "}"), c)
    return o.select(F.concat(F.lit("orders/"), k, F.lit(".md")).alias("path"), text.alias("content"), F.lit(0.0).alias("mtime_ms"), k.alias("k"))


_strict = S.array([f"{t}|{s}" for t, g in P.STRICT_STATUSES.items() for s in g])
_VALIDATE = f"""
WITH v AS (SELECT o_orderkey AS k, {S.cycle(_T8, 'o_orderkey')} AS t, {S.cycle(_S6, 'o_custkey')} AS s, {S.cycle(['agent', 'human', 'nobody'], 'o_orderkey')} AS o,
  o_custkey % 3 AS w, o_orderkey % 3 AS q, o_orderkey % 10 = 0 AS bad_date FROM orders)
SELECT k, concat_ws('|',
  CASE WHEN t = 'odd' THEN 'frontmatter.invalid_type' END, CASE WHEN s = '' THEN 'frontmatter.invalid_status' END,
  CASE WHEN s <> '' AND t <> 'odd' AND NOT list_contains({_strict}, t || '|' || s) THEN 'frontmatter.invalid_status_for_type' END,
  CASE WHEN o = 'nobody' THEN 'frontmatter.invalid_owner' END, CASE WHEN w = 1 THEN 'frontmatter.invalid_keywords' END,
  CASE WHEN q = 2 THEN 'frontmatter.invalid_retention' END,
  CASE WHEN bad_date THEN 'frontmatter.invalid_date|frontmatter.invalid_date' END) AS codes FROM v"""


@register("prj_validate_frontmatter", _VALIDATE)
def prj_validate_frontmatter(spark, sf):
    d = N.validate_frontmatter(N.parse_frontmatter(N.split_frontmatter(yaml_notes(spark, sf))))
    return d.select("k", F.array_join(F.transform("errors", lambda e: e["code"]), "|").alias("codes"))


@register("prj_strict_candidates", f"""
WITH v AS (SELECT o_orderkey AS k, {S.cycle(_T8, 'o_orderkey')} AS t, {S.cycle(_S6, 'o_custkey')} AS s, o_orderkey % 3 AS o, o_custkey % 3 AS w, o_orderkey % 10 = 0 AS bad FROM orders)
SELECT k, t <> 'odd' AND list_contains({_strict}, t || '|' || s) AND o <> 2 AND w <> 1 AND NOT bad AS ok,
  CASE WHEN t <> 'odd' AND list_contains({_strict}, t || '|' || s) AND o <> 2 AND w <> 1 AND NOT bad THEN 'a|b/p' || k END AS value FROM v""")
def prj_strict_candidates(spark, sf):
    d = N.validate_frontmatter(N.strict_candidates(N.parse_frontmatter(N.split_frontmatter(yaml_notes(spark, sf)))))
    return d.select("k", "ok", F.concat(bar("value.tags"), F.lit("/"), bar("value.links.parents")).alias("value"))


# --- registry -----------------------------------------------------------------


def bad_notes(spark, sf):
    n, k = A.notes(spark, sf), F.col("doc_id")
    return n.select(
        F.when(k % 7 == 0, F.concat(F.lit("doc-"), F.floor(k / 14) * 14)).otherwise(F.col("id")).alias("id"),
        "type", F.when(k % 11 == 0, "bogus").otherwise(A.cycle(P.NOTE_STATUSES, F.floor(k / 8))).alias("status"), "repo_slug",
        F.when(k % 17 == 0, F.concat(F.lit("elsewhere/"), "path")).when(k % 19 == 0, F.concat(F.lit("vault/90 Templates/"), k, F.lit(".md")))
        .otherwise(F.col("path")).alias("path"),
        F.concat(F.lit("Title "), k % 400).alias("title"), F.when(k % 5 == 0, "").otherwise(F.col("summary")).alias("summary"),
        "created", "updated", "tags", "keywords", "mtime_ms",
        F.when(k % 9 == 0, F.upper("type")).otherwise(F.col("type")).alias("legacy_type"), F.when(k % 6 == 2, "Ready").alias("legacy_status"),
        (k % 9 == 0).alias("synthetic_id"), (k % 4 == 1).alias("type_normalized"), (k % 6 == 2).alias("status_normalized"), "doc_id")


def registry(spark, sf):
    n = bad_notes(spark, sf)
    links = A.link_rows(spark, sf).filter("link_group <> 'related'")
    _, missing = L.split_links(links, n)
    chunks = A.chunks(spark, sf).select("chunk_id", "note_id", F.lit(0).alias("chunk_index"), "text")
    return R.build_registry(n, chunks, links, missing), missing, chunks


_BAD = f"""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'doc-' || ((doc_id // 14) * 14) ELSE id END AS id, type, CASE WHEN doc_id % 11 = 0 THEN 'bogus' ELSE {S.cycle(P.NOTE_STATUSES, '(doc_id // 8)')} END AS status,
  CASE WHEN doc_id % 17 = 0 THEN 'elsewhere/' || path WHEN doc_id % 19 = 0 THEN 'vault/90 Templates/' || doc_id || '.md' ELSE path END AS path,
  'Title ' || (doc_id % 400) AS title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE summary END AS summary, updated,
  CASE WHEN doc_id % 9 = 0 THEN upper(type) ELSE type END AS legacy_type, CASE WHEN doc_id % 6 = 2 THEN 'Ready' END AS legacy_status,
  date_diff('day', updated::DATE, DATE '2024-12-31') AS age FROM notes
"""
_REG = [
    ("notes", S.NOTES), ("links", f"SELECT * FROM ({S.LINKS}) WHERE link_group <> 'related'"), ("bad", _BAD), ("ids", "SELECT DISTINCT id FROM bad"),
    ("missing", "SELECT DISTINCT from_id, target FROM links WHERE target NOT IN (SELECT id FROM ids)"),
    ("chunks", "SELECT id AS note_id, 'chunk:' || id || ':0000:' || substr(sha256(text), 1, 8) AS chunk_id, text FROM notes"),
    ("reg", """
      SELECT b.*, list_filter([CASE WHEN doc_id % 9 = 0 THEN 'missing_frontmatter_id' END, CASE WHEN summary = '' THEN 'missing_summary' END,
          CASE WHEN doc_id % 4 = 1 THEN 'legacy_type_normalized' END, CASE WHEN doc_id % 6 = 2 THEN 'legacy_status_normalized' END,
          CASE WHEN id IN (SELECT from_id FROM missing) THEN 'unresolved_links' END], lambda x: x IS NOT NULL) AS issues,
        (SELECT count(DISTINCT target) FROM links l WHERE l.from_id = b.id) AS n_out,
        (SELECT count(DISTINCT from_id) FROM links l WHERE l.target = b.id) AS n_in,
        (SELECT string_agg(chunk_id, '|' ORDER BY chunk_id) FROM chunks c WHERE c.note_id = b.id) AS chunk_ids FROM bad b"""),
]


@register("agg_registry", S.with_(_REG, """
SELECT doc_id, id, array_to_string(issues, '|') AS issues, CASE WHEN len(issues) > 0 THEN 'warning' ELSE 'ok' END AS validation_status,
  n_out AS n_outbound, n_in AS n_inbound, coalesce(chunk_ids, '') AS chunk_ids FROM reg"""))
def agg_registry(spark, sf):
    reg = registry(spark, sf)[0]
    return reg.select("doc_id", "id", bar("validation_issues").alias("issues"), "validation_status", "n_outbound", "n_inbound", bar("chunk_ids").alias("chunk_ids"))


@register("agg_duplicate_ids", S.with_(_REG[:3], "SELECT id, count(*) AS n FROM bad GROUP BY id HAVING count(*) > 1"))
def agg_duplicate_ids(spark, sf):
    return R.duplicate_ids(bad_notes(spark, sf))


@register("agg_diagnostics", S.with_(_REG, """
SELECT 'notes' AS section, 'all' AS key, '' AS detail, count(*) AS n FROM reg
UNION ALL SELECT 'chunks', 'all', '', count(*) FROM reg JOIN chunks ON note_id = id
UNION ALL SELECT 'notes_by_type', type, '', count(*) FROM reg GROUP BY type
UNION ALL SELECT 'notes_by_status', status, '', count(*) FROM reg GROUP BY status
UNION ALL SELECT 'synthetic_ids', path, '', 1 FROM reg WHERE doc_id % 9 = 0
UNION ALL SELECT 'legacy_type_normalizations', path, legacy_type || ' -> ' || type, 1 FROM reg WHERE lower(legacy_type) <> type
UNION ALL SELECT 'status_normalizations', path, 'Ready -> ' || status, 1 FROM reg WHERE doc_id % 6 = 2
UNION ALL SELECT 'validation_warnings', path, path || ': missing frontmatter id; generated ' || id, 1 FROM reg WHERE doc_id % 9 = 0
UNION ALL SELECT 'validation_warnings', path, path || ': missing summary', 1 FROM reg WHERE summary = ''
UNION ALL SELECT 'unresolved_links', from_id, target, 1 FROM missing"""))
def agg_diagnostics(spark, sf):
    reg, missing, _ = registry(spark, sf)
    return R.diagnostics(reg, missing)


_MANIFEST = """
WITH d AS (SELECT coalesce(p.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'gone' WHEN p.path IS NOT NULL AND p.m = c.m THEN 'skipped' ELSE 'updated' END AS state, p.m AS pm
  FROM (SELECT doc_id AS path, n_chars AS m FROM documents WHERE doc_id % 23 <> 0) p
  FULL JOIN (SELECT doc_id AS path, n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS m FROM documents WHERE doc_id % 17 <> 0) c ON p.path = c.path)
"""


def _manifests(spark, sf):
    d, k = A.table(spark, sf, "documents"), F.col("doc_id")
    prev = d.filter(k % 23 != 0).select(k.alias("path"), F.col("n_chars").cast("double").alias("mtime_ms"), F.lit(True).alias("reusable"))
    cur = d.filter(k % 17 != 0).select(k.alias("path"), (F.col("n_chars") + F.when(k % 9 == 0, 1).otherwise(0)).cast("double").alias("mtime_ms"))
    return R.diff_manifest(prev, cur)


@register("jon_diff_manifest", _MANIFEST + "SELECT path, state FROM d")
def jon_diff_manifest(spark, sf):
    return _manifests(spark, sf).select("path", "state")


@register("jon_diff_summary", _MANIFEST + """SELECT count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'updated') AS updated,
  count(*) FILTER (state <> 'gone') AS files, greatest(0, count(pm) - count(*) FILTER (state <> 'gone')) AS deleted FROM d""")
def jon_diff_summary(spark, sf):
    return R.diff_summary(_manifests(spark, sf))


# --- governance ---------------------------------------------------------------

_DUPKEY = "sha256(lower(title) || '|' || lower(summary))"
_DUPS = f"SELECT {_DUPKEY} AS group_key, count(*) AS group_size FROM reg GROUP BY 1 HAVING count(*) > 1"


@register("gov_duplicate_notes", S.with_([*_REG, ("dups", _DUPS)], f"SELECT group_key, group_size, path, id AS note_id FROM reg JOIN dups ON {_DUPKEY} = group_key"))
def gov_duplicate_notes(spark, sf):
    return G.duplicate_notes(registry(spark, sf)[0])


_BUCKETS = {
    "stale_todos": ("type = 'todo' AND status = 'active' AND age > 30", "age"),
    "sessions_to_summarise": ("type = 'session' AND status = 'active' AND age > 14", "age"),
    "orphan_notes": ("type <> 'repo-home' AND status = 'active' AND age > 7 AND n_out = 0 AND n_in = 0", "0"),
    "archivable_specs": ("type = 'spec' AND status = 'done' AND age > 30", "age"),
    "superseded_decisions": ("type = 'architecture-record' AND status = 'superseded'", "0"),
}


def _bucket(name):
    fn = getattr(G, name)

    def run(spark, sf):
        reg = registry(spark, sf)[0].filter("doc_id IS NOT NULL")
        return fn(reg) if name == "superseded_decisions" else fn(reg, AS_OF)

    cond, days = _BUCKETS[name]
    register(f"gov_{name}", S.with_(_REG, f"SELECT id AS note_id, path, type, {days}::BIGINT AS days FROM reg WHERE {cond}"))(run)


for _name in _BUCKETS:
    _bucket(_name)

_SIZES = "SELECT note_id, greatest(1, ceil((sum(length(text)) + 2 * (count(*) - 1)) / 4.0))::BIGINT AS estimated_tokens FROM chunks GROUP BY note_id"


@register("gov_oversized_notes", S.with_([*_REG, ("sizes", _SIZES)], "SELECT note_id, path, estimated_tokens FROM reg JOIN sizes ON note_id = id WHERE estimated_tokens > 1200"))
def gov_oversized_notes(spark, sf):
    reg, _, chunks = registry(spark, sf)
    return G.oversized_notes(reg, chunks)


_INVALID = """
SELECT path, unnest(list_filter(issues, lambda i: i <> 'unresolved_links')) AS reason FROM reg
UNION SELECT path, path || ': missing frontmatter id; generated ' || id FROM reg WHERE doc_id % 9 = 0
UNION SELECT path, path || ': missing summary' FROM reg WHERE summary = ''"""


@register("gov_invalid_frontmatter", S.with_(_REG, _INVALID))
def gov_invalid_frontmatter(spark, sf):
    return G.invalid_frontmatter(registry(spark, sf)[0])


def _listing(spark, sf):
    """A file listing: index table names among source names."""
    return A.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, A.cycle(P.INDEX_TABLES, F.col("doc_id"))).otherwise(F.concat("source", F.lit(".tmp"))).alias("name")).distinct()


_LISTING = f"SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN {S.cycle(P.INDEX_TABLES, 'doc_id')} ELSE source || '.tmp' END AS name FROM documents"
_STALE = f"SELECT name FROM ({_LISTING}) WHERE NOT list_contains({S.array(P.INDEX_TABLES)}, name)"


@register("gov_stale_index_files", _STALE)
def gov_stale_index_files(spark, sf):
    return G.stale_index_files(_listing(spark, sf))


_CLEAN = " UNION ALL ".join(f"SELECT '{k}' AS bucket, id AS note_id, path, '' AS detail, {d}::BIGINT AS n FROM reg WHERE {c}" for k, (c, d) in _BUCKETS.items()) + f"""
UNION ALL SELECT 'duplicate_notes', id, path, substr(group_key, 1, 16), group_size FROM reg JOIN dups ON {_DUPKEY} = group_key
UNION ALL SELECT 'oversized_notes', note_id, path, '', estimated_tokens FROM reg JOIN sizes ON note_id = id WHERE estimated_tokens > 1200
UNION ALL SELECT 'invalid_frontmatter', '', path, reason, 0 FROM ({_INVALID})
UNION ALL SELECT 'generated_files_to_delete', '', name, '', 0 FROM ({_STALE})"""
_CLEAN_CTES = [*_REG, ("dups", _DUPS), ("sizes", _SIZES), ("clean", _CLEAN)]


@register("gov_cleanup_report", S.with_(_CLEAN_CTES, "SELECT * FROM clean"))
def gov_cleanup_report(spark, sf):
    reg, _, chunks = registry(spark, sf)
    return G.cleanup_report(reg, chunks, AS_OF, _listing(spark, sf))


_VERIFY = f"""
SELECT 'error' AS severity, 'invalid_status_for_type' AS code, type || ' -> ' || status || ' ' || path AS subject, 1::BIGINT AS n FROM reg WHERE NOT list_contains({_pairs}, type || '|' || status)
UNION ALL SELECT 'error', 'outside_vault', path, 1 FROM reg WHERE NOT starts_with(path, 'vault/')
UNION ALL SELECT 'error', 'template_indexed', path, 1 FROM reg WHERE regexp_matches(path, '/(90 Templates|91 Scripts)/')
UNION ALL SELECT 'error', 'duplicate_id', id, count(*) - 1 FROM reg GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'error', 'unresolved_links', '', count(*) FROM reg WHERE list_contains(issues, 'unresolved_links') HAVING count(*) > 0
UNION ALL SELECT 'warning', 'synthetic_ids', '', count(*) FROM reg WHERE doc_id % 9 = 0 HAVING count(*) > 0"""


@register("gov_verify_index", S.with_(_REG, _VERIFY))
def gov_verify_index(spark, sf):
    return G.verify_index(registry(spark, sf)[0])


@register("gov_verify_summary", S.with_(_REG, """
SELECT count(*) AS notes, (SELECT count(*) FROM reg JOIN chunks ON note_id = id) AS chunks, count(*) FILTER (list_contains(issues, 'unresolved_links')) AS unresolved_links,
  count(*) FILTER (doc_id % 9 = 0) AS synthetic_ids FROM reg"""))
def gov_verify_summary(spark, sf):
    return G.verify_summary(registry(spark, sf)[0])


@register("gov_doctor", S.with_([*_CLEAN_CTES, ("viol", _VERIFY), ("inv", _INVALID), ("rows", """
SELECT CASE WHEN severity = 'warning' THEN 'warnings' WHEN code = 'unresolved_links' THEN 'link_check' ELSE 'schema_check' END AS "check", code, sum(n)::BIGINT AS n FROM viol GROUP BY ALL
UNION ALL SELECT CASE WHEN reason LIKE '%missing frontmatter id%' OR reason = 'missing_frontmatter_id' OR reason LIKE '%missing summary%' THEN 'frontmatter_advisory' ELSE 'frontmatter_blocking' END,
  CASE WHEN reason LIKE '%missing frontmatter id%' OR reason = 'missing_frontmatter_id' THEN 'missing_frontmatter_id' WHEN reason LIKE '%missing summary%' THEN 'missing_summary' ELSE 'unknown' END, count(*) FROM inv GROUP BY ALL
UNION ALL SELECT 'cleanup_dry_run', bucket, count(*) FROM clean GROUP BY ALL""")], """
SELECT * FROM rows UNION ALL SELECT 'passed', '', CASE WHEN count(*) FILTER ("check" IN ('schema_check', 'link_check', 'frontmatter_blocking') OR code = 'generated_files_to_delete') = 0 THEN 1 ELSE 0 END FROM rows"""))
def gov_doctor(spark, sf):
    reg, _, chunks = registry(spark, sf)
    return G.doctor(reg, chunks, AS_OF, listing=_listing(spark, sf))


def _proposals(spark, sf):
    n, k = A.notes(spark, sf), F.col("doc_id")
    return n.select(
        "doc_id", A.cycle([*P.WRITE_CONFIG, "repo-home"], k).alias("type"), F.concat(F.lit("TITLE "), (k * 3) % 450).alias("title"),
        F.when(k % 6 == 0, " ").otherwise(F.col("summary")).alias("summary"), "repo_slug", F.when(k % 4 == 0, "human").otherwise("").alias("owner"))


_PROP = f"""SELECT doc_id, {S.cycle([*P.WRITE_CONFIG, 'repo-home'], 'doc_id')} AS type, 'TITLE ' || ((doc_id * 3) % 450) AS title,
  CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE summary END AS summary, repo_slug, CASE WHEN doc_id % 4 = 0 THEN 'human' ELSE '' END AS owner FROM notes"""
_LIVE = "SELECT *, lower(title) AS lt, lower(summary) AS ls FROM reg WHERE status NOT IN ('archived', 'superseded')"


@register("gov_find_duplicates", S.with_([*_REG, ("prop", _PROP), ("live", _LIVE), ("m", """
SELECT p.doc_id, p.type, count(l.id) FILTER (lt = lower(p.title) AND ls = lower(p.summary) AND ls <> '') AS n_exact, count(l.id) FILTER ((lt = lower(p.title)) <> (ls = lower(p.summary) AND ls <> '')) AS n_heuristic
FROM prop p LEFT JOIN live l ON l.type = p.type AND (lt = lower(p.title) OR (ls = lower(p.summary) AND ls <> '')) GROUP BY ALL""")],
    "SELECT doc_id, n_exact, n_heuristic, CASE WHEN n_exact > 0 THEN 'reject' WHEN n_heuristic > 0 THEN 'review' ELSE 'accept' END AS verdict FROM m"))
def gov_find_duplicates(spark, sf):
    return G.find_duplicates(_proposals(spark, sf), registry(spark, sf)[0]).select("doc_id", "n_exact", "n_heuristic", "verdict")


@register("gov_duplicate_candidates", S.with_([*_REG, ("prop", _PROP), ("live", _LIVE)], """
SELECT type, 'title' AS match_reason, lt AS key, id, path FROM live l WHERE lt <> '' AND EXISTS (SELECT 1 FROM prop p WHERE p.type = l.type AND lower(p.title) = lt)
UNION ALL SELECT type, 'summary', ls, id, path FROM live l WHERE ls <> '' AND EXISTS (SELECT 1 FROM prop p WHERE p.type = l.type AND lower(p.summary) = ls)"""))
def gov_duplicate_candidates(spark, sf):
    return G.duplicate_candidates(_proposals(spark, sf), registry(spark, sf)[0])


def _cfg(field, default="NULL"):
    return S.case({k: c[field] for k, c in P.WRITE_CONFIG.items() if c[field] is not None}, "type", default)


_SECTIONS = S.case({k: "§".join(c["sections"]) for k, c in P.WRITE_CONFIG.items()}, "type")
_due = lambda f: f"coalesce('\"' || strftime(DATE '2024-12-31' + ({_cfg(f)})::INT, '%Y-%m-%d') || '\"', 'null')"


@register("gov_propose_notes", S.with_([("notes", S.NOTES), ("prop", _PROP), ("e", f"""
SELECT *, CASE WHEN type = 'repo-home' THEN 'Unsupported note type: repo-home' WHEN trim(summary) = '' THEN '--summary is required' END AS error,
  'mem-20241231-' || {_GOV_SLUG.format('title')} AS nid FROM prop""")], f"""
SELECT doc_id, error, CASE WHEN error IS NULL THEN nid END AS note_id,
  CASE WHEN error IS NULL THEN '00 Repositories/' || repo_slug || '/' || {_cfg('folder')} || '/2024-12-31 ' || title || '.md' END AS path, CASE WHEN error IS NULL THEN {_cfg('status')} END AS status,
  CASE WHEN error IS NULL THEN sha256('---' || chr(10) || 'id: "' || nid || '"' || chr(10) || 'type: "' || type || '"' || chr(10) || 'repo_slug: "' || repo_slug || '"' || chr(10) || 'title: "' || title || '"'
   || chr(10) || 'status: "' || {_cfg('status')} || '"' || chr(10) || 'created: "2024-12-31"' || chr(10) || 'updated: "2024-12-31"' || chr(10) || 'owner: "' || CASE WHEN owner <> '' THEN owner ELSE {_cfg('owner')} END || '"'
   || chr(10) || 'summary: "' || summary || '"' || chr(10) || 'tags: []' || chr(10) || 'keywords: []' || chr(10) || 'links:' || chr(10) || '{"' || chr(10) || '".join(f"  {g}: []" for g in P.LINK_GROUPS)}' || chr(10) || 'retention:'
   || chr(10) || '  review_after: ' || {_due('review_days')} || chr(10) || '  expires_after: ' || {_due('expire_days')} || chr(10) || '  keep: ' || {S.case({k: str(c['keep']).lower() for k, c in P.WRITE_CONFIG.items()}, 'type')}
   || chr(10) || '---' || chr(10) || chr(10) || replace({_SECTIONS}, '§', chr(10) || chr(10)) || chr(10)) END AS content_hash FROM e"""))
def gov_propose_notes(spark, sf):
    return G.propose_notes(_proposals(spark, sf), AS_OF).select("doc_id", "error", "note_id", "path", "status", F.sha2("content", 256).alias("content_hash"))


# --- migration ----------------------------------------------------------------

_FIXES = [*_NOTE_CTES[:2], ("f", f"""
SELECT *, CASE WHEN list_contains({_pairs}, type || '|' || alias) THEN alias ELSE {S.case(P.DEFAULT_STATUS, 'type')} END AS status,
  list_contains({_pairs}, type || '|' || alias) AS explicit FROM n0"""), ("g", f"""
SELECT *, NOT explicit AND type IN ('todo', 'spec') AS suggested,
  CASE WHEN conv_id % 5 <> 0 THEN 'conv-' || conv_id ELSE 'mem-' || replace(created, '-', '') || '-conv-' || conv_id END AS note_id FROM f""")]


@register("mig_plan_fixes", S.with_(_FIXES, """
SELECT path, note_id, type, status, 'conv ' || conv_id AS title, created, CASE WHEN suggested THEN status END AS suggested_status,
  concat_ws('|', CASE WHEN conv_id % 5 = 0 THEN 'add_id' END, CASE WHEN raw_type <> type THEN 'normalize_type' END, 'add_title', CASE WHEN raw_status <> status THEN 'normalize_status' END,
    'set_updated', 'set_owner', 'add_summary', 'normalize_body', 'add_links', 'set_retention', 'drop_repo') AS changes FROM g"""))
def mig_plan_fixes(spark, sf):
    return M.plan_fixes(_parsed(spark, sf), "talk").select("path", "note_id", "type", "status", "title", "created", "suggested_status", bar("changes").alias("changes"))


_SRC_PATH = "'03 Sessions/' || id || '-' || doc_id || '.md'"


@register("mig_dedupe_ids", S.with_([("notes", S.NOTES), ("bad", _BAD), ("p", f"""SELECT id, {_SRC_PATH} AS path, count(*) OVER (PARTITION BY id) AS n FROM bad""")], """
SELECT path, CASE WHEN n > 1 THEN id || '-' || lpad(lower(hex(list_reduce(list_transform(string_split(path, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295, 0::BIGINT))), 8, '0') ELSE id END AS note_id,
  CASE WHEN n > 1 THEN 'add_links|dedupe_id' ELSE 'add_links' END AS changes FROM p"""))
def mig_dedupe_ids(spark, sf):
    b = bad_notes(spark, sf).select(
        F.concat(F.lit("03 Sessions/"), "id", F.lit("-"), "doc_id", F.lit(".md")).alias("path"), F.col("id").alias("note_id"),
        T.strings(["add_links"]).alias("changes"), F.lit(True).alias("changed"), F.concat(F.lit('---\nid: "'), "id", F.lit('"\n')).alias("content"))
    return M.dedupe_ids(b).select("path", "note_id", bar("changes").alias("changes"))


@register("mig_report", S.with_(_FIXES, """
SELECT 'total:scanned' AS measure, count(*) AS n FROM g UNION ALL SELECT 'total:changed', count(*) FROM g UNION ALL SELECT 'total:total_candidates', count(*) FROM g
UNION ALL SELECT 'total:applicable', count(*) FROM g UNION ALL SELECT 'total:blocked', 0 UNION ALL SELECT 'total:unchanged', 0
UNION ALL SELECT c, count(*) FROM (SELECT unnest(list_concat(['add_title', 'set_updated', 'set_owner', 'add_summary', 'normalize_body', 'add_links', 'set_retention', 'drop_repo'],
  list_filter([CASE WHEN conv_id % 5 = 0 THEN 'add_id' END, CASE WHEN raw_type <> type THEN 'normalize_type' END, CASE WHEN raw_status <> status THEN 'normalize_status' END], lambda x: x IS NOT NULL))) AS c FROM g) GROUP BY c"""))
def mig_report(spark, sf):
    totals, counts, _ = M.migration_report(M.plan_fixes(_parsed(spark, sf), "talk"))
    names = ["scanned", "changed", "total_candidates", "applicable", "blocked", "unchanged"]
    t = totals.select(F.explode(F.array(*[F.struct(F.lit(f"total:{n}").alias("measure"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")
    return t.unionByName(counts.select(F.col("change").alias("measure"), "n"))
