"""SQL building blocks for the DuckDB side of every check.

joins and plain scans are fine here, the tables being small.
"""

from __future__ import annotations

from marginalia import policy as P


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def case(mapping: dict, key: str, default: str = "NULL") -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else str(v)

    return "CASE " + key + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def cycle(values, key: str) -> str:
    return f"list_extract({array(values)}, ({key} % {len(values)})::INT + 1)"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9/._-]+')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def ordered_distinct(x: str) -> str:
    """List without repeats, first-seen order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def with_(ctes: dict[str, str] | list, final: str) -> str:
    items = ctes.items() if isinstance(ctes, dict) else ctes
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in items) + "\n" + final


NOTES = f"""
SELECT d.doc_id, 'doc-' || d.doc_id AS id,
  {cycle(P.NOTE_TYPES, 'd.doc_id')} AS type,
  {cycle(P.NOTE_STATUSES, 'd.doc_id')} AS status,
  d.source AS repo_slug,
  'vault/' || d.source || '/' || d.lang || '/' || d.doc_id || '.md' AS path,
  split_part(d.text, chr(10), 1) AS title,
  split_part(d.text, chr(10), 1) AS summary,
  d.lang AS tag, d.source AS keyword,
  strftime(DATE '2024-01-01' + (d.doc_id % 365)::INT, '%Y-%m-%d') AS updated,
  CASE WHEN l.quality = 0 THEN 'warning' ELSE 'ok' END AS validation_status,
  d.n_chars, d.text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

CORPUS = """
SELECT *, 'chunk:' || id || ':0000:' || substr(sha256(text), 1, 8) AS chunk_id, id AS note_id,
  path || ' § ' || title AS source_path, title AS heading, path AS source_file,
  CASE WHEN type = 'architecture-record' AND status = 'active' THEN 'accepted' ELSE status END AS sstatus
FROM notes
"""

QUERIES = f"SELECT item_id AS query_id, array_to_string({tok('text')}, ' ') AS query FROM benchmark"


def plans(source: str = "queries", keys: str = "query_id") -> list[tuple[str, str]]:
    def says(name):
        return f"regexp_matches(lower(query), {q(P.INTENT_PATTERNS[name])})"

    suffix = case(P.VARIANT_SUFFIX, "t")
    flags = f"""
    SELECT {keys}, query, lower(query) AS normalized, {ordered_distinct(tok('query'))} AS keywords,
      {says('overview')} AS f_over, {says('build')} AS f_build, {says('recent')} AS f_recent,
      {says('task')} AS f_task, {says('reference')} AS f_ref, {says('ownership')} AS f_own,
      {says('history')} AS f_hist FROM {source}"""
    intents = """
    SELECT *, CASE
        WHEN f_recent THEN 'session'
        WHEN f_task THEN 'task'
        WHEN f_build THEN 'implementation'
        WHEN f_ref THEN 'reference'
        WHEN f_own THEN 'architecture'
        ELSE 'general' END AS intent,
      list_distinct_in_order AS preferred_types
    FROM (SELECT *, list_filter(
            [CASE WHEN f_over THEN 'repo-home' END, CASE WHEN f_over THEN 'architecture-record' END,
             CASE WHEN f_build THEN 'spec' END, CASE WHEN f_build THEN 'todo' END,
             CASE WHEN f_recent THEN 'session' END,
             CASE WHEN f_task AND NOT f_build THEN 'todo' END,
             CASE WHEN f_ref THEN 'reference' END], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM flags)"""
    phrase = "array_to_string(keywords, ' ')"
    variants = f"""
    SELECT *, CASE WHEN f_hist THEN []::VARCHAR[] ELSE ['archived', 'superseded'] END AS excluded,
      list_filter(CASE WHEN {phrase} = '' THEN []::VARCHAR[] ELSE
        list_concat([{phrase}], list_transform(preferred_types, lambda t: {phrase} || ' ' || {suffix})) END,
        lambda v: v <> query AND v <> normalized) AS variants
    FROM intents"""
    final = f"""
    SELECT *, len(excluded) = 0 AS allow_archived, intent <> 'reference' AS use_graph,
      lower({strip('query')}) AS needle,
      {ordered_distinct("flatten(list_transform(list_concat([query, normalized], variants), lambda v: " + tok('v') + "))")} AS terms
    FROM variants_cte"""
    return [("flags", flags), ("intents", intents), ("variants_cte", variants), ("plans", final)]


def base(*extra: tuple[str, str]) -> list[tuple[str, str]]:
    return [("notes", NOTES), ("corpus", CORPUS), ("queries", QUERIES), *extra]


_FIELD_EXPR = {
    "text": "text", "title": "title", "path": "source_path",
    "summary": "summary", "tags": "tag", "keywords": "keyword",
}

TOK = " UNION ALL ".join(
    f"SELECT chunk_id, {q(f)} AS f, unnest({tok(e)}) AS term FROM corpus" for f, e in _FIELD_EXPR.items()
)
TF = "SELECT chunk_id, f, term, count(*) AS tf FROM toks GROUP BY ALL"
LENS = "SELECT chunk_id, f, count(*) AS len FROM toks GROUP BY ALL"
AVGS = "SELECT f, sum(len) * 1.0 / (SELECT count(*) FROM corpus) AS avg_len FROM lens GROUP BY f"
DF = "SELECT term, count(DISTINCT chunk_id) AS df FROM toks GROUP BY term"
LEXICAL_TABLES = [("toks", TOK), ("tf", TF), ("lens", LENS), ("avgs", AVGS), ("dfs", DF)]

BM25 = f"""
SELECT p.query_id, tf.chunk_id,
  sum({case(P.FIELD_WEIGHTS, 'tf.f')} * ln(1 + ((SELECT count(*) FROM corpus) - dfs.df + 0.5) / (dfs.df + 0.5))
      * (tf.tf * {P.BM25_K1 + 1}) / (tf.tf + {P.BM25_K1} * ({1 - P.BM25_B} + {P.BM25_B} * lens.len / avgs.avg_len))) AS bm25
FROM (SELECT query_id, unnest(terms) AS term FROM plans) p
JOIN tf ON tf.term = p.term JOIN dfs ON dfs.term = p.term
JOIN lens ON lens.chunk_id = tf.chunk_id AND lens.f = tf.f JOIN avgs ON avgs.f = tf.f
GROUP BY ALL
"""

BOOSTS = """
SELECT query_id, chunk_id, t_hit, h_hit, s_hit, id_hit, path_hit, title_hit,
  10.0 * t_hit::INT + 8.0 * h_hit::INT + 6.0 * s_hit::INT AS phrase,
  20.0 * id_hit::INT + 18.0 * path_hit::INT + 12.0 * title_hit::INT AS ident
FROM (SELECT p.query_id, c.chunk_id,
    contains(lower(c.source_path || chr(10) || c.text), p.needle) AS t_hit,
    contains(lower(c.heading), p.needle) AS h_hit,
    contains(lower(c.summary), p.needle) AS s_hit,
    c.note_id = p.needle AS id_hit,
    lower(c.source_file) = p.needle OR lower(c.source_path) = p.needle AS path_hit,
    lower(c.title) = p.needle AS title_hit
  FROM corpus c, plans p)
WHERE t_hit OR h_hit OR s_hit OR id_hit OR path_hit OR title_hit
"""

LEX_ALL = """
SELECT query_id, chunk_id, sum(s) AS score FROM (
  SELECT query_id, chunk_id, bm25 AS s FROM bm25
  UNION ALL SELECT query_id, chunk_id, phrase + ident FROM boosts) GROUP BY ALL
"""


def ranked(source: str, pool: int, score: str = "round(score, 3)") -> str:
    return f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, source_file, heading, chunk_id) AS rank
      FROM (SELECT s.query_id, s.chunk_id, c.note_id, c.source_file, c.heading, {score} AS score
        FROM {source} s JOIN corpus c USING (chunk_id) JOIN plans p USING (query_id)
        WHERE NOT list_contains(p.excluded, c.sstatus) AND s.score <> 0)) WHERE rank <= {pool}"""


LEXICAL = base(*plans(), *LEXICAL_TABLES, ("bm25", BM25), ("boosts", BOOSTS), ("lex_all", LEX_ALL),
               ("lex", ranked("lex_all", 15)))

LINKS = f"""
SELECT 'doc-' || doc_id AS from_id, {cycle(P.LINK_GROUPS, 'doc_id')} AS link_group,
  CASE WHEN doc_id % 13 = 0 THEN 'missing-' || (doc_id % 10)
       ELSE 'doc-' || ((doc_id * 7 + 3) % (SELECT max(doc_id) + 1 FROM documents)) END AS target
FROM documents
"""
EDGES = f"""
SELECT DISTINCT from_id, target AS to_id, {case(P.EDGE_TYPE_BY_GROUP, 'link_group')} AS type
FROM links WHERE target IN (SELECT id FROM notes)
"""
ADJ = """
SELECT DISTINCT a, b FROM (SELECT from_id AS a, to_id AS b FROM edges
  UNION ALL SELECT to_id, from_id FROM edges) WHERE a <> b
"""
TWO_HOP = """
SELECT seed, id, min(distance) AS distance FROM (
  SELECT a AS seed, b AS id, 1 AS distance FROM adj
  UNION ALL SELECT x.a, y.b, 2 FROM adj x JOIN adj y ON x.b = y.a WHERE x.a <> y.b) GROUP BY ALL
"""
GRAPH_TABLES = [("links", LINKS), ("edges", EDGES), ("adj", ADJ), ("two_hop", TWO_HOP)]
GRAPH_ALL = """
SELECT l.query_id, c.chunk_id, CASE t.distance WHEN 1 THEN 5.0 ELSE 2.0 END AS score
FROM lex l JOIN plans p USING (query_id) JOIN two_hop t ON t.seed = l.note_id JOIN corpus c ON c.note_id = t.id
WHERE l.rank = 1 AND p.use_graph
"""


# --- hashed vectors -----------------------------------------------------------


def hash32(x: str, seed: int) -> str:
    return (
        f"list_reduce(list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT), "
        f"lambda h, c: (xor(h, c) * {P.FNV_PRIME}) & 4294967295, {seed}::BIGINT)"
    )


def _stem(x: str) -> str:
    for pattern, put in (("(ing|edly|ed|tion|sion|ment|ness|able|ible)$", ""), ("ies$", "y"), ("(es|s)$", "")):
        x = f"regexp_replace({x}, '{pattern}', '{put}')"
    return x


_GROUPS = {t: g for g in P.CONCEPT_GROUPS for t in g}
CONCEPTS = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(t)}, {q(a)})" for t, g in _GROUPS.items() for a in g
) + ") v(member, alias)"


def vector_ctes(tokens: str) -> list[tuple[str, str]]:
    """From a CTE ``tokens(doc, token)`` to ``vec(doc, dim, v)`` in millionths."""
    w = P.FEATURE_WEIGHT_400
    hashed = ", ".join(f"{hash32('feature', s)} AS h_{k}" for k, s in P.HASH_SEEDS.items())
    return [
        ("concepts", CONCEPTS),
        ("dict", f"SELECT token, {_stem('token')} AS stem FROM (SELECT DISTINCT token FROM {tokens})"),
        ("features", f"""
          SELECT token, token AS feature, {w['token']} AS w400 FROM dict
          UNION ALL SELECT token, stem, {w['stem']} FROM dict WHERE stem <> '' AND stem <> token
          UNION ALL SELECT d.token, c.alias, {w['alias']} FROM dict d JOIN concepts c ON c.member =
            CASE WHEN d.token IN (SELECT member FROM concepts) THEN d.token ELSE d.stem END
            WHERE c.alias <> d.token
          UNION ALL SELECT token, 'tri:' || unnest(CASE WHEN len(token) <= 3 THEN [token] ELSE
            list_transform(range(1, len(token) - 1), lambda i: substr(token, i, 3)) END), {w['trigram']} FROM dict"""),
        ("hashes", f"SELECT feature, {hashed} FROM (SELECT DISTINCT feature FROM features)"),
        ("token_dims", f"""
          SELECT token, dim, sum(w)::BIGINT AS w400 FROM (
            SELECT f.token, (h_primary % {P.VECTOR_DIMS})::INT AS dim, w400 AS w FROM features f JOIN hashes USING (feature)
            UNION ALL SELECT f.token, (h_secondary % {P.VECTOR_DIMS})::INT,
              -(w400 // 2) * CASE WHEN h_sign % 2 = 0 THEN 1 ELSE -1 END FROM features f JOIN hashes USING (feature)
            UNION ALL SELECT f.token, (h_tertiary % {P.VECTOR_DIMS})::INT,
              (w400 // 4) * CASE WHEN h_sign % 2 = 0 THEN 1 ELSE -1 END FROM features f JOIN hashes USING (feature)
          ) GROUP BY ALL"""),
        ("doc_dims", f"""
          SELECT doc, dim, sum(n * w400)::BIGINT AS v FROM
            (SELECT doc, token, count(*) AS n FROM {tokens} GROUP BY ALL) JOIN token_dims USING (token) GROUP BY ALL"""),
        ("vec", """
          SELECT doc, dim, (floor(abs(v) / sqrt(sum(v * v) OVER (PARTITION BY doc)::DOUBLE) * 1e6 + 0.5) * sign(v))::BIGINT AS v
          FROM doc_dims WHERE v <> 0"""),
    ]


CHUNK_INPUT = "concat_ws(chr(10), nullif(title, ''), nullif(summary, ''), nullif(heading, ''), source_path, keyword, tag, nullif(text, ''))"
QUERY_INPUT = (
    "concat_ws(chr(10), nullif(query, ''), intent, nullif(array_to_string(preferred_types, ' '), ''), "
    "nullif(array_to_string(keywords, ' '), ''), nullif(array_to_string(variants, ' '), ''))"
)
VECTOR_TABLES = [
    ("vtokens", f"""
      SELECT 'c' || chunk_id AS doc, unnest({tok(CHUNK_INPUT)}) AS token FROM corpus
      UNION ALL SELECT 'q' || query_id, unnest({tok(QUERY_INPUT)}) FROM plans"""),
    *vector_ctes("vtokens"),
    ("sims", """
      SELECT p.query_id, c.chunk_id, c.source_file, c.heading, floor((s.dot + 500000) / 1e6)::BIGINT / 1e6 AS similarity
      FROM (SELECT a.doc AS qd, b.doc AS cd, sum(a.v * b.v)::BIGINT AS dot
            FROM vec a JOIN vec b ON a.dim = b.dim AND a.doc LIKE 'q%' AND b.doc LIKE 'c%' GROUP BY ALL) s
      JOIN plans p ON 'q' || p.query_id = s.qd JOIN corpus c ON 'c' || c.chunk_id = s.cd
      WHERE s.dot > 0 AND NOT list_contains(p.excluded, c.sstatus)"""),
    ("vlane", """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY similarity DESC, source_file, heading, chunk_id) AS rank
        FROM sims WHERE similarity >= 0.18) WHERE rank <= 15"""),
]

FUSION_TABLES = [
    ("graph_all", GRAPH_ALL),
    ("glane", ranked("graph_all", 15, "score")),
    ("llane", """SELECT *, round(score - 3.0 * (row_number() OVER (PARTITION BY query_id, note_id ORDER BY rank) - 1), 3) AS pscore
       FROM lex"""),
    ("lanes", """
      SELECT query_id, chunk_id, rank AS lr, NULL::BIGINT AS vr, NULL::BIGINT AS gr, pscore AS ls, NULL::DOUBLE AS sim, NULL::DOUBLE AS gs FROM llane
      UNION ALL SELECT query_id, chunk_id, NULL, rank, NULL, NULL, similarity, NULL FROM vlane
      UNION ALL SELECT query_id, chunk_id, NULL, NULL, rank, NULL, NULL, score FROM glane"""),
    ("merged", """
      SELECT *, coalesce(1.0 / (60 + lr)::DOUBLE, 0) + coalesce(1.0 / (60 + vr)::DOUBLE, 0) + coalesce(1.0 / (60 + gr)::DOUBLE, 0) AS raw
      FROM (SELECT query_id, chunk_id, max(lr) AS lr, max(vr) AS vr, max(gr) AS gr, coalesce(max(ls), 0) AS ls, max(sim) AS sim, max(gs) AS gs
            FROM lanes GROUP BY ALL)"""),
    ("fused", """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY fused_score DESC, coalesce(sim, 0) DESC, source_file, heading, chunk_id) AS frank
        FROM (SELECT m.*, round(raw * 1000 + ls, 3) AS fused_score, round(raw, 6) AS fused, c.source_file, c.heading, c.note_id,
                c.type, c.sstatus, c.updated, c.validation_status, c.text FROM merged m JOIN corpus c USING (chunk_id)))
      WHERE frank <= 5"""),
    ("reranked", f"""
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused DESC, coalesce(sim, 0) DESC,
          source_file, heading, chunk_id) AS rank
      FROM (SELECT f.*, p.query, round(fused_score
          + CASE WHEN list_contains(p.preferred_types, f.type) THEN tb + 8 WHEN len(p.preferred_types) > 0 THEN -4 ELSE tb END
          + {case(P.STATUS_BOOSTS, 'f.sstatus', '0')}
          + CASE WHEN lr IS NULL THEN 0
              WHEN list_contains(p.preferred_types, 'session') AND f.type <> 'session' THEN 0
              WHEN NOT list_contains(p.preferred_types, 'session') AND list_contains(p.preferred_types, 'todo') AND f.type <> 'todo' THEN 0
              WHEN len(p.preferred_types) > 0 AND NOT list_contains(p.preferred_types, 'session') AND NOT list_contains(p.preferred_types, 'todo') THEN 0
              WHEN f.type = 'session' AND age <= 7 THEN 6 WHEN f.type = 'session' AND age <= 30 THEN 3
              WHEN f.type = 'todo' AND age <= 30 THEN 4 ELSE 0 END
          + CASE WHEN f.type = 'session' AND sib >= 2 THEN {case(P.SESSION_HEADING_BOOSTS, 'lower(f.heading)', '0')} ELSE 0 END
          - CASE WHEN f.validation_status = 'warning' THEN 3 ELSE 0 END, 3) AS score
        FROM (SELECT *, {case(P.TYPE_BOOSTS, 'type', '0')} AS tb, count(*) OVER (PARTITION BY query_id, note_id) AS sib,
                date_diff('day', updated::DATE, DATE '2024-12-31') AS age FROM fused) f JOIN plans p USING (query_id))"""),
]
CONTENT = "CASE WHEN instr(text, chr(10) || chr(10)) = 0 THEN text ELSE " + strip("substr(text, instr(text, chr(10) || chr(10)) + 2)") + " END"
SUBSTANTIVE = "length(" + collapse(f"regexp_replace({CONTENT}, '(?m)^#+\\s+.+$', '', 'g')") + ") >= 40"
