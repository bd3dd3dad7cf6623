import random

import pytest

from marginalia.functions import frontmatter
from marginalia.functions.joins import spread
from marginalia.operators import links as L
from marginalia.operators import migration as M
from marginalia.operators import notes as N
from marginalia.plans.index import build_index, incremental
from marginalia.plans.search import search
from marginalia.sources import files

STRICT = """---
id: "mem-1"
type: spec
repo_slug: home
title: Shell plan
status: active
created: 2026-01-01
updated: 2026-01-02
owner: agent
summary: A plan.
tags: [a, " b ", a]
keywords: []
links:
  parents: [mem-2]
  children: []
  related: []
  supersedes: []
  superseded_by: []
retention:
  review_after: null
  expires_after: 2026-05-05
  keep: false
---
Intro line.

# First
one
## Second
two
### deeper
three
# Third
"""


def raw(spark, *rows):
    return spark.createDataFrame([(p, c, 1767225600000.0) for p, c in rows], "path string, content string, mtime_ms double")


def parsed(spark, *rows):
    return N.parse_frontmatter(N.split_frontmatter(raw(spark, *rows)))


def test_valid_note_and_values(spark):
    r = N.validate_frontmatter(parsed(spark, ("a.md", STRICT))).first()
    assert r.ok and r.value.tags == ["a", "b"] and r.value.links.parents == ["mem-2"] and r.value.retention.keep is False


@pytest.mark.parametrize("old,new,code", [
    ("type: spec", "type: poem", "frontmatter.invalid_type"),
    ("status: active", "status: accepted", "frontmatter.invalid_status_for_type"),
    ('id: "mem-1"', 'id: ""', "frontmatter.missing_id"),
    ("owner: agent", "owner: bob", "frontmatter.invalid_owner"),
    ("tags: [a", "tags: [1", "frontmatter.invalid_tags"),
    ("created: 2026-01-01", "created: yesterday", "frontmatter.invalid_date"),
    ("keep: false", "keep: 3", "frontmatter.invalid_retention"),
    ("children: []", "children: x", "frontmatter.invalid_links"),
])
def test_error_codes(spark, old, new, code):
    r = N.validate_frontmatter(parsed(spark, ("a.md", STRICT.replace(old, new)))).first()
    assert code in [e.code for e in r.errors]


def test_date_check_is_shape_only(spark):
    r = N.validate_frontmatter(parsed(spark, ("a.md", STRICT.replace("created: 2026-01-01", "created: 2026-99-99")))).first()
    assert r.ok


def test_missing_and_broken_blocks(spark):
    rows = {r.path: r for r in parsed(spark, ("a.md", "no block"), ("b.md", "---\na: [x\n---\nbody"), ("c.md", "---\n- x\n---\n")).collect()}
    assert rows["a.md"].parse_error == "frontmatter.missing_block" and rows["a.md"].body == "no block"
    assert rows["b.md"].parse_error == rows["c.md"].parse_error == "frontmatter.invalid_yaml"


def test_sections_at_sibling_headings(spark):
    notes = N.index_notes(parsed(spark, ("specs/a.md", STRICT)))
    got = [(c.heading, c.heading_level, c.text.split("\n\n", 1)[1]) for c in N.build_chunks(notes).orderBy("chunk_index").collect()]
    assert got == [
        ("Shell plan", 0, "Intro line."), ("First", 0, "one"), ("Second", 2, "## Second\ntwo\n### deeper\nthree")]


def test_body_without_sections_is_one_chunk(spark):
    notes = N.index_notes(parsed(spark, ("specs/a.md", "# Only a title\n\n")))
    rows = N.build_chunks(notes).collect()
    assert len(rows) == 1 and rows[0].heading == "Only a title"


def test_types_and_statuses(spark):
    rows = {r.path: r for r in N.index_notes(parsed(
        spark,
        ("02 Decisions/2026-02-03 x.md", "---\nstatus: Ready\n---\nText here."),
        ("04 Tasks/a-b_c.md", "---\ntype: repo-decision\nstatus: zap\n---\n- list\n\nProse  line\nmore"),
        ("00 Repo Home.md", "hello"),
    )).collect()}
    d = rows["vault/02 Decisions/2026-02-03 x.md"]
    assert (d.type, d.status, d.created, d.type_normalized) == ("architecture-record", "accepted", "2026-01-01", True)
    t = rows["vault/04 Tasks/a-b_c.md"]
    assert (t.type, t.status, t.title, t.summary) == ("architecture-record", "accepted", "a b c", "Prose line more")
    assert rows["vault/00 Repo Home.md"].type == "repo-home" and rows["vault/00 Repo Home.md"].id.startswith("mem-")


def test_link_resolution(spark):
    notes = spark.createDataFrame(
        [("n1", "vault/a/one.md", "One", "[x](two.md) [y](../b/three.md#z) [w](https://e.org) [[Four|alias]] [[n2#s]] [v](mailto:a@b)"),
         ("n2", "vault/a/two.md", "Two", ""), ("n3", "vault/b/three.md", "Three", ""), ("n4", "vault/c/x4.md", "Four", ""),
         ("n5", "vault/d/same.md", "Same", "[[same]]"), ("n6", "vault/e/same.md", "Same", "")],
        "id string, path string, title string, body string")
    got = {(r.from_id, r.target): r.resolved for r in L.resolve_links(L.extract_links(notes), notes).collect()}
    assert got == {
        ("n1", "two.md"): "n2", ("n1", "../b/three.md#z"): "n3", ("n1", "https://e.org"): None,
        ("n1", "Four|alias"): "n4", ("n1", "n2#s"): "n2", ("n1", "mailto:a@b"): None, ("n5", "same"): None}


def test_two_hop_is_shortest_and_undirected(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "from_id string, to_id string")
    seeds = spark.createDataFrame([("a",), ("d",)], "seed string")
    got = {(r.seed, r.id): r.distance for r in L.two_hop(e, seeds).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("d", "c"): 1, ("d", "b"): 2, ("d", "a"): 2}


def test_strict_build_raises_on_missing_targets(spark):
    idx = build_index(raw(spark, ("a.md", STRICT)), strict=True)
    with pytest.raises(Exception, match="links.target_missing"):
        idx.notes.collect()


def test_rejected_rows(spark):
    idx = build_index(raw(spark, ("a.md", STRICT.replace("owner: agent", "owner: bob")), ("b.md", "---\n: [\n---\n")))
    assert {(r.path, r.code) for r in idx.rejected.collect()} == {
        ("a.md", "frontmatter.invalid_owner"), ("b.md", "frontmatter.invalid_yaml")}


def test_index_roundtrip_and_search(spark, tmp_path):
    for name, text in (("specs/plan.md", STRICT.replace("parents: [mem-2]", "parents: []")),
                       ("notes/routing decision.md", "---\ntype: repo-decision\ntitle: Routing decision\n---\n"
                        "The shell navigation uses a single router for every route in the host application.\n"),
                       (".trash/x.md", "gone"), ("90 Templates/t.md", "gone"), ("c+d é.txt", "no")):
        p = tmp_path / "vault" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    notes = files.read_notes(spark, str(tmp_path / "vault"))
    assert {r.path for r in notes.collect()} == {"specs/plan.md", "notes/routing decision.md"}
    idx = build_index(notes)
    files.write_index(idx.tables(), str(tmp_path / "index"))
    index = files.load_index(spark, str(tmp_path / "index"))
    assert index.vector_status == "ready" and index.lexical is not None
    q = spark.createDataFrame([(1, "shell navigation router")], "query_id bigint, query string")
    hit = search(q, index, as_of="2026-01-03").orderBy("rank").first()
    assert hit.heading == "Routing decision" and "source:hybrid" in hit.reasons
    changed, diff = incremental(notes.limit(1).select("path", "mtime_ms").selectExpr("*", "true AS reusable"), notes)
    assert changed.count() == 1 and diff.filter("state = 'skipped'").count() == 1


def test_migration_plan(spark):
    note = "---\nrepo: home\nnote_type: repo-task\ndate: 2025-03-04\npriority: P1\nnest: {a: [1, x], b: true}\n---\n\n# My Task\n\n\n\nDo it now.\n"
    r = M.plan_fixes(parsed(spark, ("04 Tasks/my-task.md", note)), "home").first()
    assert r.note_id == "mem-20250304-my-task" and r.blocking_issues == ["status_review_required"]
    assert r.changes == ["add_id", "normalize_type", "add_title", "suggest_status", "set_updated", "set_owner", "add_summary",
                         "normalize_body", "add_links", "set_retention", "drop_date", "drop_note_type", "drop_repo"]
    assert 'nest:\n  a:\n    - 1\n    - "x"\n  b: true\npriority: "P1"\n---\n\nDo it now.\n' in r.content
    assert 'review_after: "2025-04-03"' in r.content
    twice = M.plan_fixes(parsed(spark, ("a/x.md", "---\nid: s\n---\nb"), ("b/x.md", "---\nid: s\n---\nb")), "home")
    ids = [p.note_id for p in M.dedupe_ids(twice).collect()]
    assert len(set(ids)) == 2 and all(i.startswith("s-") and len(i) == 10 for i in ids)
    # A canonical note needs no change.
    clean = r.content.replace("nest:\n  a:\n    - 1\n    - \"x\"\n  b: true\npriority: \"P1\"\n", "")
    again = M.plan_fixes(parsed(spark, ("04 Tasks/my-task.md", clean)), "home").first()
    assert again.changes == [] and again.content == clean


def test_simple_blocks_read_as_the_yaml_parser_reads_them(monkeypatch):
    values = ["a", "1", "1.5", "true", "null", "", "a b", "'x y'", "''", "'it''s'", '"q"', "[a, 1]", "[]", "[a,b]", "[a, ]", "x # c", "x: y", "2024-01-01", "5.", "&a x", "|", "a "]
    rng, blocks = random.Random(5), ["id: o\ntags: [a, b]\nlinks:\n  parents: [p1]\n  children: []\nkeep: true"]
    for _ in range(3000):
        lines = [rng.choice(["", "", "  "]) + rng.choice(["a", "b", "links", "x_1", "9z"]) + rng.choice([":", ": ", ": "]) + rng.choice(values) for _ in range(rng.randint(1, 4))]
        blocks.append("\n".join(lines) + rng.choice(["", "\n", "\n  - x"]))
    got = [frontmatter._read(b) for b in blocks]
    simple = [frontmatter._simple(b) is not None for b in blocks]
    monkeypatch.setattr(frontmatter, "_simple", lambda _: None)
    assert got == [frontmatter._read(b) for b in blocks] and simple[0] and sum(simple) > 100


def test_costly_rows_get_partitions_by_their_number(spark):
    assert spread(spark.range(1000, numPartitions=1), 20).rdd.getNumPartitions() == 50
    assert spread(spark.range(1000, numPartitions=60), 20).rdd.getNumPartitions() == 60
