"""The filter audit against a plain simulation of every order."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from marginalia.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def simulate(docs, labels):
    """Apply every order of the five filters to the rows, one after the other."""
    import re

    rows = [(i, t or "", s or "") for i, t, s in docs]
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        return {x for x, bad in tests.items() if bad}

    judged = [(i, p, fails(i, t)) for i, t, p in rows]
    out, removals = {}, {}
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                failing = sum(x in f for _, f in mine)
                left = [(i, f) for i, f in left if x not in f]
                removals[part, x] = removals.get((part, x), 0) + len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in mine),
                                                   sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return sorted((p, o, s, *v, removals[p, o[s - 1]]) for (p, o, s), v in out.items())


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, s, "x") for i, t, s in docs], "doc_id long, text string, source string, n string").withColumn("mask", F.lit("y"))
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in audit.audit(d, m).select(COLUMNS).collect())


def test_every_order_equals_a_plain_simulation(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [(1, long, "a"), (2, long, "b"), (2, long, "b"), (3, long, "a"), (4, "SHOUT " * 250, "a"), (5, "x # y", None), (6, None, None), (7, "", "a"),
            (8, "", None), (None, long, "a"), (None, "", None), (None, "only here", "c"), (9, long + " | A B", "b"), (9, "same id, other text", "b"),
            (0, long + "\x0bw1" * 900, "c"), (10, "\x85  " * 300, "c"), (2, long, "c"), (1, long, "b")]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 0), (4, 0, 1), (6, 1, 1), (None, 1, 1), (77, 1, 1), (7, None, None), (2, 1, 0)]
    assert run(spark, docs, labels) == simulate(docs, labels)


def test_a_hot_text_and_zeros(spark):
    docs = [(i, "same", "hot") for i in range(400)] + [(1000, " ".join(f"v{i}" for i in range(200)), "clean")]
    got = run(spark, docs, [])
    assert got == simulate(docs, [])
    assert all(r[3] == 1 and r[4:] == (0,) * 6 for r in got if r[0] == "clean")


def test_empty_tables_and_other_filters(spark):
    assert run(spark, [], []) == []
    d = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s"), (3, "b", "s")], "doc_id long, text string, source string")
    m = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit(d, m, lambda t, w: {"x": t.contains("a"), "y": t.contains("b")}).collect()
    assert {(r.filter_order, r.step): (r.removed, r.redundant, r.kept, r.shapley) for r in got} == {
        ("xy", 1): (2, 0, 1, 3), ("xy", 2): (1, 1, 0, 3), ("yx", 1): (2, 0, 1, 3), ("yx", 2): (1, 1, 0, 3)}
    with pytest.raises(ValueError):
        audit.lattice(spark, list("abcdefgh"))


def test_paths_through_the_lattice(spark):
    edges, steps = (x.collect() for x in audit.lattice(spark, list("ABCDE")))
    assert len(edges) == 80 and len(steps) == 600
    crossed = {}
    for r in steps:
        crossed[r.state, r.letter] = crossed.get((r.state, r.letter), 0) + 1
    assert crossed == {(r.state, r.letter): r.weight for r in edges}
