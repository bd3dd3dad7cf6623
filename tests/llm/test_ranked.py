"""Ranked search on K2-treaps against plain scoring."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import ranked

TERM = re.compile(ranked.TERM)


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items, k):
    """Score every document for every item."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in asked.items():
        scored = []
        for i, t in held:
            m = 10 + 90 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in want if x in df)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mé", "Ñu", "9x", "zz") for b in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(0, 60)))) for i in range(n)]
    return docs, [(i, " ".join(rng.choices(vocab, weights, k=12))) for i in range(20)]


def run(spark, docs, items, k):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tile", F.lit("x")).withColumn("id", F.lit(3)).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    return sorted((tuple(r) for r in ranked.rank(frame, asked, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_plain_scoring(spark):
    docs, items = corpus(400, 1)
    docs += [(1000, None), (1001, ""), (1002, " ?! "), (None, "ka1 ka2 KA3"), (-5, "ka1 ka2 KA3"), (1003, "ka1 ka2 KA3"), (1003, "ka1 ka2 KA3"), (2**61, "zz5 zz6"), (1004, " zz6ÀÉ zz5"), (1005, "zz6\x0bzz5 É")]
    items += [(100, "KA1 ka2-ka3"), (101, None), (102, "nothing known"), (103, "zz5"), (103, "zz6 zz6"), (None, "ka9 É")]
    assert run(spark, docs, items, 10) == plain(docs, items, 10)
    assert run(spark, docs, items, 1) == plain(docs, items, 1)


def test_many_small_tiles_share_lower_bounds(spark, monkeypatch):
    docs, items = corpus(300, 2)
    tiles = ranked.build_tiles(spark.createDataFrame(docs, "doc_id long, text string").repartition(40), *ranked.statistics(spark.createDataFrame(docs, "doc_id long, text string")))
    frame = spark.createDataFrame(items, "item_id long, text string")
    floors = ranked.weighted_items(tiles, ranked.item_terms(frame), 295, 3).select("item_id", "floor").distinct().collect()
    assert sum(r.floor > 0 for r in floors) >= 15
    want = {i: s for i, r, _, s in plain(docs, items, 3) if r == 3}
    assert all(r.floor <= want.get(r.item_id, math.inf) for r in floors)
    monkeypatch.setattr(ranked, "PACK", 3)
    assert run(spark, docs, items, 3) == plain(docs, items, 3)


def test_tables_without_rows(spark):
    docs, items = corpus(20, 3)
    assert run(spark, [], items, 5) == [] and run(spark, docs, [], 5) == [] and run(spark, [(1, None)], items, 5) == []


def test_long_texts_are_read_whole(monkeypatch):
    text = "Alpha beta-" * 3000 + "é" * 500 + " END"
    whole = ranked.postings([text, None, "alpha"])
    monkeypatch.setattr(ranked, "CHUNK", 100)
    cut = ranked.postings([text, None, "alpha"])
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert whole[3].tolist() == [6002, 0, 1] and sorted(whole[2].tolist()) == [1, 1, 1, 3000, 3000]
    assert len(np.unique(whole[1])) == 4


@pytest.mark.parametrize(("n_rows", "n_cols", "n"), [(1, 1, 1), (7, 3, 9), (900, 2000, 30_000), (5, 8192, 4000), (30_000, 70, 50_000), (1, 400, 300)])
def test_treap_is_exact_and_skips_ranges(n_rows, n_cols, n):
    rng = np.random.default_rng(n)
    at = np.unique(rng.integers(0, n_rows * n_cols, n))
    row, column = at // n_cols, at % n_cols
    tf, m = rng.integers(1, 9, len(at)), rng.integers(10, 4000, n_cols)
    impact = ranked.impact_of(tf, m[column])
    tree = ranked.Treap.build(row, column, tf, m, n_rows)
    back = ranked.Treap.unpack(n_rows, n_cols, tree.pack())
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(tree.cells, back.cells, strict=True))
    assert all((getattr(tree, x) == getattr(back, x)).all() for x in ("path", "column", "tf", "m", "impact"))
    for level in range(tree.start, tree.shape.depth + 1):
        r, c = rng.integers(0, n_rows), rng.integers(0, n_cols)
        rs, cs = tree.shape.row_shift[level], tree.shape.col_shift[level]
        inside = (row >> rs == r >> rs) & (column >> cs == c >> cs)
        bound = back.maxima(level, back.shape.row_path(np.array([r])), np.array([(c >> cs) << cs]))[0, 0]
        assert 0 <= bound - impact[inside].max(initial=0) < ranked.STEP
    ids = rng.permutation(n_cols) * 3
    ranges = total = 0
    for _ in range(20):
        rows = np.unique(rng.integers(0, n_rows, 6))
        weight = rng.integers(0, 5, len(rows))
        score = np.zeros(n_cols, np.int64)
        for r, w in zip(rows, weight):
            np.add.at(score, column[row == r], w * impact[row == r])
        want = sorted(((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if s > 0))[:4]
        got_id, got, scored = back.search(rows, weight, ids, 4, 0)
        assert [(-s, i) for s, i in zip(got.tolist(), got_id.tolist())] == want
        if want:
            floor = -want[-1][0]
            assert back.search(rows, weight, ids, 4, floor)[1].tolist() == [-s for s, _ in want]
        ranges, total = ranges + scored, total + -(-n_cols // 64)
    if n_rows == 900:
        assert ranges < 0.8 * total
