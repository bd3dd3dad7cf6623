import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.joins import contains_pairs, rank_rows, short_contains_pairs, spread
from marginalia.operators import board as B
from marginalia.operators import catalog as C
from marginalia.operators import governance as G
from marginalia.operators import usage as U
from marginalia.sources import files
from marginalia.streaming import events as ST

EVENTS = (
    "event_id bigint, timestamp timestamp, tool string, query string, results array<struct<rank:bigint,chunk_id:string,source_path:string,"
    "retrieval_sources:array<string>>>, target struct<chunk_id:string,source_path:string>")


def at(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=40 * n)


def log(spark):
    r = lambda rank, c, *s: (rank, c, f"v/{c}.md", list(s))
    return spark.createDataFrame([
        (1, at(1), "memory_search", "weak", [r(1, "a", "vector"), r(2, "b", "lexical")], None),
        (2, at(2), "memory_search", "used", [r(1, "c", "vector"), r(2, "d", "lexical", "vector")], None),
        (3, at(5), "memory_context", None, None, None),
        (4, at(9), "memory_unfold", None, None, ("d", None)),
        (5, at(10), "memory_search", "later", [r(1, "d", "lexical")], None),
        (6, at(10), "memory_unfold", None, None, (None, "v/nothing.md")),
    ], EVENTS)


def test_use_signals_look_back_across_ranges(spark):
    got = [tuple(r) for r in U.use_signals(log(spark)).collect()]
    assert got == [(4, 2, 2, "d", "v/d.md")]
    assert [tuple(r) for r in U.use_signals(log(spark), rows_per_range=3).collect()] == got


def test_report_buckets(spark):
    e = log(spark)
    got = {r.measure: r.n for r in U.usage_report(e).collect()}
    assert got == {"total_events": 6, "search_events": 3, "context_events": 1, "unfold_events": 2, "queries": 3,
                   "only_weak_use_queries": 2, "strong_use_from_lower_rank": 1, "semantic_only_false_positives": 2}
    fp = {(r.query, r.rank, r.reason) for r in U.semantic_false_positives(U.use_signals(e), e).collect()}
    assert fp == {("used", 1, "top_rank_but_lower_rank_won"), ("weak", 1, "only_weak_use_query")}


def test_event_log_roundtrip_and_missing_log(spark, tmp_path):
    assert files.read_events(spark, str(tmp_path / "none")).count() == 0
    files.append_events(log(spark), str(tmp_path / "log"))
    files.append_events(log(spark), str(tmp_path / "log"))
    assert files.read_events(spark, str(tmp_path / "log")).count() == 12


def todo(spark, rows):
    return spark.createDataFrame(rows, "list_id string, seq bigint, kind string, item_id string, title string, items array<struct<id:string,title:string,completed:boolean>>")


def test_todo_state_rules(spark):
    rows = [
        ("l", 1, "added", "a", " one ", None), ("l", 2, "added", "b", "  ", None), ("l", 3, "toggled", "a", None, None),
        ("l", 4, "toggled", "zz", None, None), ("l", 5, "added", "c", "three", None), ("l", 6, "deleted", "c", None, None),
        ("l", 7, "deleted", "zz", None, None), ("m", 1, "added", "x", "gone", None),
        ("m", 2, "replaced", None, None, [("p", " P ", True), ("q", " ", False), ("r", "R", False)]),
        ("m", 3, "toggled", "p", None, None), ("m", 4, "toggled", "x", None, None), ("n", 1, "added", "a", "t", None), ("n", 2, "cleared", None, None, None),
    ]
    got = {(r.list_id, r.item_id, r.title, r.completed) for r in B.todo_state(todo(spark, rows)).collect()}
    assert got == {("l", "a", "one", True), ("m", "p", "P", False), ("m", "r", "R", False)}
    stats = {r.list_id: (r.total, r.done, r.remaining) for r in B.todo_stats(B.todo_state(todo(spark, rows))).collect()}
    assert stats == {"l": (1, 1, 0), "m": (2, 0, 2)}


def test_todo_stream_equals_batch(spark, tmp_path):
    schema = "list_id string, seq bigint, kind string, item_id string, title string"
    batches = [[("l", 1, "added", "a", "A"), ("l", 2, "toggled", "a", None)],
               [("l", 3, "toggled", "a", None), ("l", 4, "added", "b", "B"), ("l", 5, "deleted", "a", None)],
               [("l", 6, "cleared", None, None), ("l", 7, "added", "a", "A2"), ("l", 8, "toggled", "a", None)]]
    src, out = str(tmp_path / "src"), str(tmp_path / "state")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = ST.todo_state_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "progress"))
        q.awaitTermination()
    got = [tuple(r) for r in ST.todo_snapshot(spark, out).collect()]
    want = [tuple(r) for r in B.todo_state(spark.createDataFrame(sum(batches, []), schema)).collect()]
    assert got == want == [("l", "a", "A2", True, 7)]


def test_task_notes(spark):
    new = "---\ntype: repo-task\npriority: P1\nstatus: In Progress\nai_appetite: 40\nsource: \"desk\"\n---\n\n# Title here\n\n## Why\n\nbecause\n\n## Extra\n\nkept\n\n## Outcome\n\ndone\n"
    old = "# Old one\n\nPriority: `P2`\nStatus: `Ready`\nAI Appetite: 250%\nSource: mail\n\n## Why\n\nx\n"
    df = spark.createDataFrame([("tasks/a.md", new), ("tasks/b.md", old), ("tasks/c.md", "# No priority")], "task_file string, content string")
    rows = {r.id: r for r in B.parse_task_notes(df).collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a.title, a.priority, a.section, a.effort, a.source, a.why, a.outcome) == ("Title here", "P1", "In Progress", 40, "desk", "because", "done")
    assert a.details == "## Extra\n\nkept"
    assert (b.priority, b.section, b.effort, b.source, b.why) == ("P2", "Ready", 100, "mail", "x")


def test_next_story(spark):
    rows = [("r1", 1, 0, "A", "t", "low", "pending", False), ("r1", 1, 1, "B", "t", "high", "pending", False), ("r1", 1, 2, "C", "t", "low", "blocked", False),
            ("r2", 2, 0, "D", "t", "2", "in_progress", False), ("r2", 2, 1, "E", "t", "1", "in_progress", True), ("r3", 3, 0, "F", "t", None, "complete", False)]
    s = spark.createDataFrame(rows, "run_id string, run_index int, position int, story_id string, title string, priority string, status string, passes boolean")
    got = {r.run_id: r.story_id for r in B.next_story(s).collect()}
    assert got == {"r1": "B", "r2": "D"}
    assert B.next_story_global(B.next_story(s)).first().story_id == "D"
    assert {r.story_id for r in B.next_story(s, story_id="C").collect()} == {"C"}
    skip = spark.createDataFrame([("r1", "B")], "run_id string, story_id string")
    assert {r.run_id: r.story_id for r in B.next_story(s, skip).collect()}["r1"] == "A"


def test_change_gate(spark):
    rows = [(1, "src/a.ts", 100, 30), (2, "src/a.ts", 3, 0), (3, "package.json", 1, 0), (3, "docs/x.md", 1, 1), (4, "package.json", 1, 0), (4, "vault/00 Repositories/h/n.md", 9, 0)]
    c = spark.createDataFrame(rows, "change_id int, path string, additions bigint, deletions bigint")
    assert {r.change_id: r.verdict for r in B.audit_changes(c).collect()} == {1: "needs-memory", 2: "pass", 3: "needs-memory", 4: "pass"}
    assert {r.change_id: r.verdict for r in B.audit_changes(c, skip_memory=True).collect()} == {1: "needs-docs", 2: "pass", 3: "pass", 4: "pass"}


def test_playback(spark):
    df = spark.createDataFrame([
        ('{"is_playing": true, "item": {"name": "S", "artists": [{"name": " A "}, {"name": ""}, {"name": "B"}], "album": {"images": [{"url": " "}, {"url": "u"}]}}}',),
        ('{"items": [{"track": {"name": "R", "artists": [{"name": "A"}], "album": {"images": [{"url": "u"}]}, "external_urls": {"spotify": "l"}}}]}',),
        ('{"item": {"name": "S", "artists": [], "album": {"images": [{"url": "u"}]}}}',), ("{}",)], "payload string")
    got = [(r.state, r.is_playing, r.artist, r.song_url) for r in B.normalize_playback(df).collect()]
    assert got == [("track", True, "A, B", "https://open.spotify.com/"), ("track", False, "A", "l"), ("idle", False, None, None), ("idle", False, None, None)]


CATALOG = [
    ("engineering-workflow", "Engineering workflow", "General work", ["general"], ["implement feature"], [], "workflow", "daily"),
    ("frontend-design", "Frontend design", "Layout and components", ["ui"], ["design a page"], ["database"], "specialist", "normal"),
    ("secret-tool", "Secret tool", "Page design helper", ["ui"], ["design"], [], "imported", "explicit"),
    ("quiet-one", "Quiet one", "Quiet page", [], ["page"], [], "support", "quiet"),
]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "id string, display_name string, description string, tags array<string>, triggers array<string>, "
                                          "anti_triggers array<string>, group string, tier string")


def test_routes(spark):
    tasks = spark.createDataFrame([(1, "design a page"), (2, "zzz"), (3, "database"), (4, "update agents.md hook")], "task_id int, task string")
    routes, second = C.route_tasks(tasks, catalog(spark))
    got = {r.task_id: r for r in routes.collect()}
    assert got[1].primary == "frontend-design" and got[1].confidence == "high" and got[1].extra_rules == ["frontend"]
    assert got[2].primary == "engineering-workflow" and got[2].evidence == 0.5 and got[2].confidence == "low"
    assert got[3].primary == "engineering-workflow"
    assert "agent-infrastructure" in got[4].extra_rules
    order = [r.id for r in second.filter("task_id = 1").orderBy("position").collect()]
    assert order[0] == "engineering-workflow" and set(order[1:]) == {"secret-tool", "quiet-one"}


def test_catalog_search_prefix_fuzzy_and_gates(spark):
    q = spark.createDataFrame([(1, "desig"), (2, "frontent"), (3, "secret"), (4, "qqqq")], "query_id int, query string")
    rows = C.catalog_search(q, catalog(spark)).collect()
    ids = lambda n: [r.id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == n]
    assert ids(1)[0] == "frontend-design" and "secret-tool" not in ids(2)
    assert ids(2) == ["frontend-design"] and ids(3) == ["secret-tool"] and ids(4) == []


def test_term_matches_find_every_close_word(spark):
    words = ["reading", "red", "rad", "bred", "engine", "engines", "ngine", "workflow", "wrokflow", "work", "abcdefghijkl", "abXdefgYijkl"]
    q = spark.createDataFrame([(w,) for w in words], "q string")
    v = spark.createDataFrame([(w,) for w in words], "term string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b) for a in words for b in words if b.startswith(a) or lev(a, b) <= round(len(a) * 0.2)}
    assert {(r.q, r.term) for r in C.term_matches(q, v).collect()} == want


def test_write_duplicates(spark):
    reg = spark.createDataFrame([("1", "todo", "active", "p1", "Fix It", "Now"), ("2", "todo", "active", "p2", "Fix it", "other"),
                                 ("3", "todo", "archived", "p3", "fix it", "now"), ("4", "spec", "active", "p4", "fix it", "now")],
                                "id string, type string, status string, path string, title string, summary string")
    p = spark.createDataFrame([(1, "todo", "FIX IT", "NOW"), (2, "todo", "new", "other"), (3, "todo", "new", "")], "k int, type string, title string, summary string")
    got = {r.k: (r.n_exact, r.n_heuristic, r.verdict) for r in G.find_duplicates(p, reg).collect()}
    assert got == {1: (1, 1, "reject"), 2: (0, 1, "review"), 3: (0, 0, "accept")}


def test_use_signals_with_one_hot_key_equal_brute_force(spark):
    """A third of all events concern one chunk; results stay whole and exact."""
    import random

    rnd = random.Random(7)
    rows, plain = [], []
    for i in range(600):
        t = at(i * 0.37)
        key = "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(40)}"
        if rnd.random() < 0.5:
            shown = [key, f"k{rnd.randrange(40)}", key]
            rows.append((i, t, "memory_search", f"q{i}", [(n + 1, c, f"v/{c}", ["lexical"]) for n, c in enumerate(shown)], None))
            plain.append((i, t, shown, None))
        else:
            rows.append((i, t, "memory_unfold", None, None, (key, None)))
            plain.append((i, t, None, key))
    want = {}
    for i, t, _, key in plain:
        if key is not None:
            for j, u, shown, _ in reversed(plain[:i]):
                if shown and key in shown:
                    want[i] = (j, shown.index(key) + 1)
                    break
    df = spark.createDataFrame(rows, EVENTS).repartition(7)
    for rows_per_range in (60, 100_000):
        got = {r.event_id: (r.search_id, r["rank"]) for r in U.use_signals(df, rows_per_range).collect()}
        assert got == want


def test_a_missing_state_version_is_an_error(spark, tmp_path):
    import shutil

    import pytest
    from pyspark.errors import StreamingQueryException

    schema = "list_id string, seq bigint, kind string, item_id string, title string"
    src, out = str(tmp_path / "src"), str(tmp_path / "state")
    for n in range(2):
        spark.createDataFrame([("l", n, "added", f"i{n}", "T")], schema).write.mode("append").parquet(src)
        run = lambda: ST.todo_state_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "progress")).awaitTermination()
        if n == 0:
            run()
            shutil.rmtree(f"{out}/items/version=0")
        else:
            with pytest.raises(StreamingQueryException):
                run()


def test_streamed_signals_have_no_time_bound(spark, tmp_path):
    r = lambda c: [(1, c, f"v/{c}.md", ["lexical"])]
    target = lambda c: (c, f"v/{c}.md")
    parts = [[(1, at(0), "memory_search", "q", r("a"), None), (2, at(1), "memory_unfold", None, None, target("a"))],
             [(3, at(5000), "memory_unfold", None, None, target("a")), (4, at(5001), "memory_search", "q", r("a"), None)],
             [(n, at(n), "memory_unfold", None, None, target("a")) for n in range(6000, 6040)]]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in parts:
        frame = spark.createDataFrame(rows, EVENTS)
        frame.write.mode("append").parquet(src)
        ST.ingest(ST.stream_use_signals(spark.readStream.schema(frame.schema).parquet(src)), out, str(tmp_path / "progress")).awaitTermination()
    written = spark.read.parquet(out)
    got = {x.event_id: x.search_id for x in ST.latest(written).collect()}
    assert got == {2: 1, 3: 1, **{n: 4 for n in range(6000, 6040)}}
    assert written.filter("kind <> 'end'").count() == 2 * len(got)  # one row per key of the target


@pytest.mark.parametrize("slice_seconds", [6 * 3600, 40 * 86400])
def test_streamed_signals_in_any_order_equal_the_batch(spark, tmp_path, slice_seconds):
    """Batches in random order, a third of the events on one key: late searches and late unfolds count."""
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        key = "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(25)}"
        t = at((i // 2 * 2) * 2.7)  # ties in time
        if rnd.random() < 0.4:
            rows.append((i, t, "memory_search", f"q{i}", [(n + 1, c, f"v/{c}", ["lexical"]) for n, c in enumerate([key, f"k{rnd.randrange(25)}", key])], None))
        else:
            rows.append((i, t, "memory_unfold", None, None, (key, f"v/{key}" if i % 3 else None)))
    want = {r.event_id: (r.search_id, r["rank"]) for r in U.use_signals(spark.createDataFrame(rows, EVENTS), 50).collect()}
    rnd.shuffle(rows)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame(rows[k * 100:(k + 1) * 100], EVENTS).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).parquet(src)
        ST.ingest(ST.stream_use_signals(stream, slice_seconds), out, str(tmp_path / "progress")).awaitTermination()
    written = spark.read.parquet(out)
    assert {x.event_id: (x.search_id, x["rank"]) for x in ST.latest(written).collect()} == want
    assert written.filter("key = 'chunk:hot'").select("slice").distinct().count() >= (8 if slice_seconds < 86400 else 1)


def test_todo_stream_writes_changes_only_and_compacts(spark, tmp_path, monkeypatch):
    """Random list events in seven batches: resets, items put again, a base after four; equal to the fold of all."""
    monkeypatch.setattr(ST, "COMPACT_EVERY", 4)
    rnd = random.Random(2)
    schema = "list_id string, seq bigint, kind string, item_id string, title string, items array<struct<id:string,title:string,completed:boolean>>"
    src, out = str(tmp_path / "src"), str(tmp_path / "state")
    every, seq = [], 0
    for k in range(7):
        rows = []
        for _ in range(30 if k else 120):
            seq += 1
            kind = rnd.choices(["added", "toggled", "deleted", "cleared", "replaced"], [8, 6, 3, 0.3, 0.4])[0]
            lst = rnd.choice(["hot"] * 3 + ["a", "b"])
            put = [(f"i{rnd.randrange(20)}", rnd.choice(["T", " "]), rnd.random() < 0.5)] if kind == "replaced" else None
            rows.append((lst, seq, kind, None if kind in ("cleared", "replaced") else f"i{rnd.randrange(20)}", f"t{seq}" if kind == "added" else None, put))
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ST.todo_state_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "progress")).awaitTermination()
        if k in (0, 3, 4, 6):
            got = sorted(tuple(r) for r in ST.todo_snapshot(spark, out).collect())
            assert got == sorted(tuple(r) for r in B.todo_state(spark.createDataFrame(every, schema)).collect())
    written = spark.read.parquet(f"{out}/items")
    assert written.filter("version = 6").count() <= 31 and spark.read.parquet(f"{out}/base").select("version").distinct().count() == 1


def test_long_terms_match_within_six_edits(spark):
    words = ["".join(chr(97 + (7 * i + n) % 26) for i in range(n)) for n in (30, 36, 41, 60)]
    changed = ["".join("#" if i % (len(w) // 6) == 0 and i // (len(w) // 6) < 6 else c for i, c in enumerate(w)) for w in words]
    found = C.term_matches(spark.createDataFrame([(c,) for c in changed], "q string"), spark.createDataFrame([(w,) for w in words], "term string"))
    assert {(x.q, x.term) for x in found.collect()} == set(zip(changed, words))



def test_changed_notes_of_a_table_in_parts(spark, tmp_path):
    from entries import activity

    docs = spark.createDataFrame([(i, f"text {i}", 10 + i) for i in range(1, 60)], "doc_id long, text string, n_chars int")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r[0] for r in activity.QUERIES["str_changed_notes"](spark, str(tmp_path)).collect())
    assert got == [i for i in range(1, 60) if i % 17 and (i % 23 == 0 or i % 9 == 0)]


def test_ranks_of_a_hot_key_are_made_in_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(-1).alias("k"), (F.col("id") * 7919 % 3001).alias("x"), "id")
    whole, cut = (rank_rows(rows, "k", F.desc("x"), F.col("id"), rows_per_task=n) for n in (10**6, 100))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    sizes = cut.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 1000 < whole.filter("k = -1").count()


def test_entries_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(C, "ENTRIES_PER_TASK", 1)
    few = catalog(spark)
    n = few.count()
    tasks = spark.createDataFrame([("t", "plan the work")], "task_id string, task string")
    evidence = C.route_evidence(tasks, few.coalesce(1))
    assert C._parts(spread(few.coalesce(1), 1)) >= n
    assert sorted(map(str, evidence.collect())) == sorted(map(str, C.route_evidence(tasks, few).collect()))


def test_short_haystacks_match_without_a_shuffle_of_texts(spark):
    hay = spark.createDataFrame([(i, t) for i, t in enumerate(["blue ring", "a blueish ring.", "ringing, ring", "", "x.y", "cold plate ring"])], "h long, hay string")
    needles = spark.createDataFrame([(i, t) for i, t in enumerate(["ring", "blue ring", "e r", ".", " ring", "ring,", "zz", "", "lueish rin", "ring "])], "n long, needle string")
    want = sorted(map(tuple, contains_pairs(hay, needles, "h", "n").select("h", "n").collect()))
    assert sorted(map(tuple, short_contains_pairs(hay, needles, "h", "n", 3).select("h", "n").collect())) == want != []


def test_a_slice_is_matched_row_by_row():
    class Held(list):
        get, appendList = (lambda self: iter(list(self))), list.extend

    matcher, row = ST.SliceMatcher(), lambda *x: dict(zip(("search", "time", "id", "rank"), x))
    matcher._searches, matcher._unfolds = Held(), Held()
    first = matcher.handleInputRows(("k", 0), iter([row(True, 5, 1, 3), row(True, 5, 1, 2), row(False, 7, 9, 0), row(False, 4, 8, 0)]), None)
    assert [(r.kind, r.event_id, r.search_id, r["rank"]) for r in first] == [("match", 9, 1, 2), ("ask", 8, None, None), ("end", None, 1, 2)]
    later = matcher.handleInputRows(("k", 0), iter([row(True, 6, 2, 1)]), None)
    assert [(r.kind, r.event_id, r.search_id, r["rank"]) for r in later] == [("match", 9, 2, 1), ("end", None, 2, 1)]
