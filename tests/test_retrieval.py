"""Ranking on a hand-made corpus, against plain Python where that is short."""

import math

import pytest
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.joins import materialise
from marginalia.operators import corpus as C
from marginalia.operators import fusion, lexical, vectors
from marginalia.operators import queries as Q
from marginalia.plans.search import SearchIndex, asked_limit, build_search_index, repo_context, repo_queries, search, vector_state

NOTES = [
    ("plan", "spec", "active", "Typed memory plan", "Build typed memory."),
    ("routing", "architecture-record", "accepted", "Shell routing", "Shell owns navigation."),
    ("old", "architecture-record", "superseded", "Old shell routing", "Superseded shell navigation."),
    ("log", "session", "done", "Session log", "What happened."),
    ("ref", "reference", "active", "Routing guide", "Routing guidance."),
]
FILL = " This paragraph only makes the text long enough to count as prose."


def tables(spark):
    notes = spark.createDataFrame(
        [(i, t, s, "home", f"vault/{i}.md", title, summary, ["tag"], ["key"], "2026-01-01", "ok" if i != "ref" else "warning", 0.0, [])
         for i, t, s, title, summary in NOTES],
        "id string, type string, status string, repo_slug string, path string, title string, summary string, tags array<string>, "
        "keywords array<string>, updated string, validation_status string, mtime_ms double, validation_issues array<string>")
    rows = []
    for i, t, s, title, summary in NOTES:
        for h in (("Goal", "Findings", "Next handoff") if t == "session" else ("Context",)):
            rows.append((f"{i}-{h}", i, f"vault/{i}.md § {h}", h, 0, f"Source\n\n{title} {summary} {h}{FILL}", summary, t, s))
    chunks = spark.createDataFrame(rows, "chunk_id string, note_id string, source_path string, heading string, heading_level int, "
                                         "text string, summary string, type string, status string")
    edges = spark.createDataFrame([("plan", "routing", "relates_to"), ("routing", "log", "relates_to")], "from_id string, to_id string, type string")
    return C.build_corpus(chunks, notes), edges


def ask(spark, text, **options):
    q = spark.createDataFrame([(1, text)], "query_id bigint, query string")
    corpus, edges = tables(spark)
    index = build_search_index(corpus, edges)
    return search(q, index, as_of="2026-01-05", **options).orderBy("rank").collect()


def test_bm25_equals_definition(spark):
    corpus, _ = tables(spark)
    rows = corpus.collect()
    tok = lambda s: [t for t in __import__("re").split(r"[^a-z0-9/._-]+", s.lower()) if t]
    fields = {r.chunk_id: {"text": tok(r.text), "title": tok(r.title), "path": tok(r.source_path), "summary": tok(r.chunk_summary),
                           "tags": tok(" ".join(r.tags)), "keywords": tok(" ".join(r.keywords))} for r in rows}
    n = len(rows)
    avg = {f: sum(len(d[f]) for d in fields.values()) / n for f in P.FIELD_WEIGHTS}
    plans = materialise(Q.plan_queries(spark.createDataFrame([(1, "shell navigation routing")], "query_id bigint, query string")))
    want = {}
    for cid, d in fields.items():
        score = 0.0
        for term in plans.first().terms:
            df = sum(any(term in x[f] for f in x) for x in fields.values())
            for f, w in P.FIELD_WEIGHTS.items():
                tf = d[f].count(term)
                if tf:
                    ratio = len(d[f]) / avg[f]
                    score += w * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ratio))
        if score:
            want[cid] = score
    got = {r.chunk_id: r.bm25 for r in lexical.bm25(plans, lexical.build_lexical_index(corpus)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_wanted_type_wins_and_superseded_is_left_out(spark):
    hits = ask(spark, "What should we build for typed memory?")
    assert hits[0].note_id == "plan" and "plan-type:spec" in hits[0].reasons
    hits = ask(spark, "shell navigation")
    assert hits[0].note_id == "routing" and all(h.note_id != "old" for h in hits)
    assert any(h.note_id == "old" for h in ask(spark, "archived shell navigation"))


def test_graph_lane_reaches_neighbours(spark):
    near = {h.note_id: h for h in ask(spark, "shell navigation", limit=10)}
    assert "graph:direct" in near["plan"].reasons or "graph:direct" in near["log"].reasons
    assert not any("route:graph" in h.reasons for h in ask(spark, "shell api", limit=10))


def test_session_roles_need_two_hits(spark):
    hits = [h for h in ask(spark, "recent session log", limit=10) if h.note_id == "log"]
    order = [h.heading for h in hits]
    assert order.index("Next handoff") < order.index("Findings") < order.index("Goal")
    assert "session-heading:next-handoff" in hits[0].reasons and "duplicate-note-penalty" in sum((h.reasons for h in hits), [])


def test_integrity_modes_and_filters(spark):
    base = {h.note_id: h.score for h in ask(spark, "routing guidance", limit=10)}
    more = {h.note_id: h.score for h in ask(spark, "routing guidance", limit=10, integrity_mode="prefer-warning")}
    assert more["ref"] == pytest.approx(base["ref"] + 6)
    assert all(h.note_id != "ref" for h in ask(spark, "routing guidance", integrity_mode="exclude-warning"))
    assert {h.type for h in ask(spark, "routing guidance", note_type="reference")} == {"reference"}
    assert ask(spark, "routing guidance", repo_slug="none") == []


def test_vector_states_and_limits():
    assert vector_state("off", "ready") == ("disabled", "disabled_by_request")
    assert vector_state("auto", "missing") == ("missing", "vector_index_missing")
    assert vector_state("auto", "ready") == ("ready", None)
    assert [asked_limit(x) for x in (None, 1, 7, 99)] == [5, 1, 7, 99]
    with pytest.raises(ValueError):
        asked_limit(0)
    assert (lexical.pool_size(5), lexical.pool_size(1, "quality")) == (15, 5)


def test_legacy_corpus_uses_the_heuristic(spark):
    legacy = C.from_legacy_chunks(spark.createDataFrame([
        ("decision-1", None, None, "a/d.md § Decision", "Decision", "repo-decision", "active", None, ["remote"], ["live"], None, "Keep the sole live remote." + FILL, None),
        ("todo-1", None, None, "a/t.md § Task", "Task", "task", "backlog", None, [], [], None, "Something else entirely." + FILL, None)],
        "id string, note_id string, source_file string, source_path string, heading string, note_type string, status string, repo_slug string, "
        "tags array<string>, keywords array<string>, summary string, text string, mtime_ms double"))
    q = spark.createDataFrame([(1, "sole live remote decision?")], "query_id bigint, query string")
    edges = spark.createDataFrame([], "from_id string, to_id string, type string")
    hits = search(q, SearchIndex(legacy, edges, None, "legacy"), as_of="2026-01-05").orderBy("rank").collect()
    assert hits[0].chunk_id == "decision-1" and hits[0].vector_reason == "legacy_corpus_has_no_vector_index"


def test_embedding_does_not_depend_on_partitioning(spark):
    corpus, _ = tables(spark)
    runs = [{r.chunk_id: r.values for r in vectors.embed_chunks(corpus.repartition(n)).select("chunk_id", F.col("values").alias("values")).collect()} for n in (1, 5)]
    runs = [{k: list(v) for k, v in r.items()} for r in runs]
    assert runs[0] == runs[1]
    assert all(abs(sum(x * x for x in v) - 1e12) < 1e8 for v in runs[0].values())


def test_vector_search_in_blocks_equals_one_block(spark):
    corpus, _ = tables(spark)
    docs = vectors.embed_chunks(corpus)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["shell routing", "typed memory plan", "session log", "guide"])], "query_id bigint, query string")
    queries = vectors.embed_queries(Q.plan_queries(q))
    run = lambda block: sorted(map(tuple, vectors.similarity_top(
        docs, queries, id_col="chunk_id", pool=3, keys=["source_file", "heading", "chunk_id"], block=block).collect()))
    assert run(1) == run(100) and run(100)


@pytest.mark.parametrize("least", [-1.0, 0.2, 0.9])
def test_clustered_lists_equal_an_exact_scan(spark, monkeypatch, least):
    """Clusters, copies, other lengths, nulls and excluded states; far lists are not scored."""
    import numpy as np

    monkeypatch.setattr(vectors, "LIST_ROWS", 16)
    monkeypatch.setattr(vectors, "HEADS", 5)
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 24))
    unit = lambda v: [int(x) for x in np.rint(v / np.linalg.norm(v) * 1e6)]
    rows = [(i, unit(centers[i % 12] + rng.standard_normal(24) * 0.15), ("ok", "old")[i % 5 == 0]) for i in range(300)]
    rows += [(1000 + i, rows[7][1], "ok") for i in range(40)] + [(2000, None, "ok"), (2001, [1, 2, 3], "ok"), (2002, [0] * 24, "ok"), (2003, [], "ok")]
    asked = [(i, unit(centers[i] + rng.standard_normal(24) * 0.1), ["old"] if i % 2 else []) for i in range(9)] + [(50, [1, 0, 0], []), (51, None, [])]
    v = spark.createDataFrame(rows, "vec_id bigint, values array<bigint>, status string")
    q = spark.createDataFrame(asked, "query_id bigint, query_vector array<bigint>, excluded_statuses array<string>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.similarity) for r in vectors.similarity_top(v, q, id_col="vec_id", pool=6, keys=["vec_id"], min_similarity=least, block=4).collect())
    want = []
    for i, x, banned in asked:
        dots = [(j, sum(a * b for a, b in zip(x, y))) for j, y, s in rows if x and y and len(x) == len(y) and s not in banned]
        scored = [(-((abs(d) + 500_000) // 10**6) * (1 if d > 0 else -1 if d < 0 else 0), j) for j, d in dots]
        scored = sorted((m, j) for m, j in scored if -m >= round(least * 1e6))
        want += [(i, n, j, -m / 1e6) for n, (m, j) in enumerate(scored[:6], 1)]
    assert got == sorted(want)
    if least == 0.9:
        lists = materialise(vectors._lists(vectors._signed(v.select("vec_id", "status", "values")).withColumn("near", F.shiftright("sig", 10)).repartitionByRange("dims", "near").sortWithinPartitions("dims", "near"), ["vec_id", "status"]))
        blocks = materialise(vectors._query_blocks(q, 1))
        assert vectors._reached(lists, blocks, 900_000).count() < 0.7 * lists.count() * blocks.count()


def test_token_vector_matches_column_expansion(spark):
    words = ["routing", "building", "layouts", "ab", "why", "a/b.c_d-e", "classes", "ing"]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    dims = {}
    for r in vectors.feature_dims(vectors.expand_tokens(df)).collect():
        dims.setdefault(r.token, {})[r.dim] = r.w400
    store = vectors._TokenVectors(P.VECTOR_DIMS)
    for w in words:
        row = store.matrix[store.row(w)]
        assert {i: int(x) for i, x in enumerate(row) if x} == {d: v for d, v in dims[w].items() if v}


def test_context_skips_and_never_exceeds_the_budget(spark):
    rows = [(1, i, f"c{i}", f"n{i}", "x" * n) for i, n in enumerate([40, 4000, 40, 200], 1)]
    df = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, note_id string, text string")
    for budget in (20, 70, 5, 2000):
        r = fusion.assemble_context(df, budget).first()
        assert r.estimated_tokens <= budget
    r = fusion.assemble_context(df, 20).first()
    assert [x.chunk_id for x in r["items"]] == ["c1", "c3"] and [(x.chunk_id, x.note_id, x.reason) for x in r.omitted] == [("c2", "n2", "token_budget"), ("c4", "n4", "token_budget")]
    assert r.truncated and [x.note_id for x in r.references] == ["n1", "n3"] and [x.estimated_tokens for x in r["items"]] == [10, 10] and r["items"][0].text == "x" * 40
    r = fusion.assemble_context(df, 2000, max_items=1).first()
    assert [x.chunk_id for x in r["items"]] == ["c1"] and not r.truncated and r.candidate_count == 4


def test_context_items_carry_the_hit(spark):
    rows = [(1, 1, "c1", "n1", "f", "f § h", "h", "spec", "active", "warning", ["w"], 2.5, ["source:lexical"], "text")]
    df = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, note_id string, source_file string, source_path string, heading string, type string, status string, "
                                     "validation_status string, validation_issues array<string>, score double, reasons array<string>, text string")
    r = fusion.assemble_context(df).first()
    assert r.references[0].asDict() == {"note_id": "n1", "source_file": "f", "source_path": "f § h", "heading": "h", "type": "spec", "status": "active", "validation_status": "warning",
                                        "validation_issues": ["w"], "score": 2.5}
    assert r["items"][0].asDict() == r.references[0].asDict() | {"chunk_id": "c1", "reasons": ["source:lexical"], "text": "text", "estimated_tokens": 1}


def test_a_repository_without_home_is_searched(spark):
    """Hits equal those of a search that is restricted to the repository."""
    corpus, edges = tables(spark)
    away = corpus.withColumns({"repo_slug": F.lit("away"), "chunk_id": F.concat(F.lit("away-"), "chunk_id"), "note_id": F.concat(F.lit("away-"), "note_id")})
    home = corpus.limit(1).withColumns({"repo_slug": F.lit("homed"), "chunk_id": F.lit("home"), "type": F.lit("repo-home"), "heading": F.lit(P.REPO_CONTEXT_HEADINGS[1]),
                                        "source_file": F.lit(f"vault/{P.REPOSITORY_ROOT}/homed/{P.REPO_HOME_FILE}")})
    index = build_search_index(materialise(corpus.unionByName(away).unionByName(home)), edges)
    slugs = spark.createDataFrame([("home",), ("away",), ("homed",), ("unknown",), (None,), ("home",)], "repo_slug string")
    got = {}
    for r in repo_context(slugs, index, as_of="2026-01-05").collect():
        got.setdefault((r.repo_slug, r.origin), []).append((r.position, r.chunk_id))
    assert got.pop(("homed", "home")) == [(2, "home")]
    for slug in ("home", "away"):
        q = spark.createDataFrame([(1, f"architecture spec plan memory {slug}")], "query_id bigint, query string")
        want = [(r["rank"], r.chunk_id) for r in search(q, index, as_of="2026-01-05", repo_slug=slug, limit=5).collect()]
        assert sorted(got.pop((slug, "search"))) == sorted(want) != []
    assert got == {}


def test_repository_context_needs_postings_of_its_questions_only(spark):
    corpus, edges = tables(spark)
    slugs = spark.createDataFrame([("home",), (None,), ("unknown",)], "repo_slug string")
    small, full = build_search_index(corpus, edges, repo_queries(slugs)), build_search_index(corpus, edges)
    got = [sorted(map(tuple, repo_context(slugs, index, as_of="2026-01-05").collect())) for index in (small, full)]
    assert got[0] == got[1] != []
    assert {r.term for r in small.lexical.term_df.collect()} <= set("architecture spec plan memory home unknown".split())


def test_repeated_note_ids_do_not_multiply_chunks(spark):
    notes = spark.createDataFrame(
        [("n", "spec", "active", "home", f"vault/{i}.md", f"T{i}", "s", ["t"], ["k"], "2026-01-01", "ok", 0.0, []) for i in range(5)],
        "id string, type string, status string, repo_slug string, path string, title string, summary string, tags array<string>, "
        "keywords array<string>, updated string, validation_status string, mtime_ms double, validation_issues array<string>")
    chunks = spark.createDataFrame([(f"c{i}", "n", f"vault/{i}.md § H", "H", 0, "text", "s", "spec", "active") for i in range(5)],
                                   "chunk_id string, note_id string, source_path string, heading string, heading_level int, text string, summary string, type string, status string")
    rows = C.build_corpus(chunks, notes).collect()
    assert len(rows) == 5 and {r.note_title for r in rows} == {"T4"}


def test_chunks_of_a_hot_title_are_dealt_to_slices(spark, monkeypatch):
    """Equal boosts whether a hot key is cut or not, and no task makes most of its pairs."""
    corpus, _ = tables(spark)
    one = corpus.filter("note_id = 'plan'")
    many = materialise(one.crossJoin(spark.range(200).toDF("k")).withColumn("chunk_id", F.concat("chunk_id", F.lit("-"), "k")).drop("k").unionByName(corpus.filter("note_id <> 'plan'")))
    queries = spark.range(60).select(F.col("id").alias("query_id"), F.when(F.col("id") < 58, "typed memory PLAN ").when(F.col("id") == 58, "vault/log.md").otherwise("old").alias("query"))
    plans = materialise(Q.plan_queries(queries))
    whole = sorted((r.query_id, r.chunk_id, r.boost, tuple(r.reasons)) for r in lexical.identity_boosts(plans, many).collect())
    assert len(whole) == 58 * 200 + 3 + 1 and (59, "old-Context", 20.0, ("exact:id",)) in whole and (58, "log-Goal", 18.0, ("exact:path",)) in whole
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 1)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = lexical.identity_boosts(plans, many, pairs_per_task=300)
        assert sorted((r.query_id, r.chunk_id, r.boost, tuple(r.reasons)) for r in cut.collect()) == whole
        made = [r[1] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
        assert max(made) < 0.7 * sum(made)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_phrases_are_verified_where_their_anchor_is_found(spark):
    """Marks, parts of words, repeated needles and absent headings, against plain search; no text is joined again."""
    rows = [("c1", "p/a.md", "Red apple pie. Red\nand (blue)", "Apple", "pie"), ("c2", "p/b.md", "pineapple, snapple apples", None, "x"),
            ("c3", "p/c.md", "nothing here", "Red apple", None), ("c4", "p/d.md", "", "", "")]
    needles = ["apple", "red apple", ".\n", ". red", "e (b", "ppl", "apple", "(", "", "zzz", ", s", "p/c", "and (blue)"]
    corpus = spark.createDataFrame(rows, "chunk_id string, source_path string, text string, heading string, summary string")
    plans = spark.createDataFrame(list(enumerate(needles)), "query_id int, needle string")
    boosts = lexical.phrase_boosts(plans, corpus)
    got = {(r.query_id, r.chunk_id): r.boost for r in boosts.collect()}
    want = {}
    for i, needle in enumerate(needles):
        for c, path, text, heading, summary in rows:
            low = [f"{path}\n{text}".lower(), (heading or "").lower(), (summary or "").lower()]
            if needle and (b := sum(v for v, x in zip((10.0, 8.0, 6.0), low) if needle in x)):
                want[i, c] = b
    assert got == want and boosts.count() == len(want)
    joins = [x for x in boosts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and not any("chunk_id" in x for x in joins)


def test_heuristic_parts_are_dealt_by_chunk(spark):
    """Tokens, topics, phrases and names add up, and no pair of query and chunk is shuffled to be summed."""
    corpus, _ = tables(spark)
    q = spark.createDataFrame([(1, "session decision"), (2, "routing guide"), (3, "")], "query_id bigint, query string")
    plans = materialise(Q.plan_queries(q))
    hits = lexical.heuristic_lexical(plans, corpus, pool=20)
    got = {(r.query_id, r.chunk_id): r.score for r in hits.collect()}
    weights = {"text": 2.0, "path": 3.0, "keyword": 4.0, "tag": 2.0, "title": 3.0}
    tok = lambda s: set(__import__("re").findall(r"[a-z0-9/._-]+", s.lower()))
    for p in plans.collect():
        for r in corpus.collect():
            fields = {"text": tok(r.source_path + " " + r.text), "path": tok(r.source_path), "keyword": tok(" ".join(r.keywords)), "tag": tok(" ".join(r.tags)), "title": tok(r.title)}
            score = sum(weights[k] * (t in f) for k, f in fields.items() for t in p.terms)
            score += sum(b for word, t, b in P.TOPIC_BOOSTS if word in p.needle and t == r.type)
            if p.needle:
                texts = {"text": f"{r.source_path}\n{r.text}".lower(), "heading": r.heading.lower(), "summary": (r.summary or "").lower()}
                score += sum(P.PHRASE_BOOSTS[k] for k, x in texts.items() if p.needle in x) + 12.0 * (r.title.lower() == p.needle)
                score += sum(v for k, v in P.VARIANT_BOOSTS.items() if any(x.lower() in texts[k] for x in p.variants))
            if (p.query_id, r.chunk_id) in got or (score and r.status not in p.excluded_statuses):
                assert got[p.query_id, r.chunk_id] == score
    assert got and "RepartitionByExpression [chunk_id" in hits._jdf.queryExecution().optimizedPlan().toString()
