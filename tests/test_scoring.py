"""Chunks scored in place equal scores by rows; nothing but the pool leaves a task."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions.joins import materialise
from marginalia.operators import lexical as X
from marginalia.operators import queries as Q
from marginalia.operators import scoring
from tests.test_index import corpus, hits, rows_of

ODD = ["", "K2 İx. a/b-c", "K K.-K Straße ÀÉ é1", "LOR1\tlor1\nLor1 mem2", "ﬁn _x_ ..", "日本lor1日本"]


def odd_rows():
    rows = rows_of([f"n{i}" for i in range(60)], 3)
    return [r[:13] + (ODD[i % 6] + (r[13] if i % 2 else " lor1 mem2"),) + r[14:] for i, r in enumerate(rows)]


def asked(spark):
    return materialise(Q.plan_queries(spark.createDataFrame(
        [(1, "lor1 mem2"), (2, "vault"), (3, "archived lor1 lor2"), (4, "nothing at all here"), (5, "T n3"), (6, "  ")], "query_id bigint, query string")))


@pytest.mark.parametrize("text", [*ODD, None, "a" * 70000])
def test_tokens_cut_in_a_task_are_those_of_the_columns(spark, text):
    from marginalia.functions.text import tokenize, words

    import pyarrow as pa

    want = spark.createDataFrame([(text,)], "t string").select(tokenize("t"), words("t")).first()
    for table, tokens in ((scoring.TOKEN_BYTES, want[0]), (scoring.WORD_BYTES, want[1])):
        row, got = scoring.cut(pa.array(["skipped", text, "x"]).slice(1), table)
        assert got.to_pylist() == [*(tokens or []), "x"] and row.tolist() == [0] * len(tokens or []) + [1]


def test_postings_of_known_terms_are_counted_without_a_shuffle(spark):
    docs = materialise(corpus(spark, odd_rows()))
    terms = spark.createDataFrame([("lor1",), ("k2",), ("k",), ("k.-k",), ("mem2",), ("vault",), ("nowhere",)], "term string")
    want = sorted(map(tuple, X.postings(docs).join(terms, "term", "left_semi").collect()))
    kept = X.postings(docs, terms)
    assert sorted(map(tuple, kept.collect())) == want != []
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    index = X.build_lexical_index(docs, terms)
    assert sorted(map(tuple, index.postings.collect())) == want
    assert tuple(X.field_stats(index.packed).first()) == tuple(X.field_stats(docs).first())


@pytest.mark.parametrize("scope", [{}, {"repo_slug": "home"}, {"note_type": "spec", "integrity_mode": "exclude-warning"}])
def test_scores_in_place_equal_scores_by_rows(spark, monkeypatch, scope):
    """Ties, boosts, excluded states; postings packed by chunk and postings as rows; batches of a few rows."""
    docs, plans = materialise(corpus(spark, odd_rows())), asked(spark)
    terms = X.query_terms(plans).select("term").distinct()
    packed, rows = X.build_lexical_index(docs, terms), X.build_lexical_index(docs)
    assert packed.packed is not None and rows.packed is None
    for pool in (1, 4, 30):
        monkeypatch.setattr(scoring, "QUERIES", 0)
        want = hits(X.lexical_search(plans, rows, docs, pool=pool, **scope))
        monkeypatch.undo()
        monkeypatch.setattr(scoring, "CELLS", 200)
        got = [hits(X.lexical_search(plans, i, docs, pool=pool, **scope)) for i in (packed, rows)]
        monkeypatch.undo()
        assert [[(q, r, c) for q, r, c, _ in g] for g in got] == [[(q, r, c) for q, r, c, _ in want]] * 2
        assert all(abs(a[3] - b[3]) < 1e-9 for g in got for a, b in zip(g, want))
    assert want


def test_only_the_pool_leaves_the_tasks(spark):
    """Ranked rows have no pair of every query and chunk behind them; a corpus other than the index's is obeyed."""
    docs, plans = materialise(corpus(spark, rows_of([f"n{i}" for i in range(300)], 7))), asked(spark)
    index = X.build_lexical_index(docs, X.query_terms(plans).select("term").distinct())
    found = X.pooled_scores(plans, index, docs, 3)
    scores = X.lexical_scores(plans, index, docs).groupBy("query_id").count().collect()
    assert max(r["count"] for r in scores) > 100
    ties = {r.query_id: r.n for r in found.groupBy("query_id").agg(F.countDistinct(F.round("score", 3)).alias("n")).collect()}
    assert ties and max(ties.values()) <= 3
    half = materialise(docs.filter(F.xxhash64("chunk_id") % 2 == 0))
    kept = {r.chunk_id for r in half.collect()}
    assert {h[2] for h in hits(X.lexical_search(plans, index, half, pool=5))} <= kept


def test_texts_are_embedded_where_they_are_read(spark):
    """Vectors made at once equal those of the tokens one by one: short, long, inflected and alias tokens, empty texts."""
    import numpy as np

    from marginalia import policy as P
    from marginalia.functions.text import tokenize
    from marginalia.operators import vectors

    texts = ["routing layouts ab a why a/b.c_d-e Classes ing ies building", "", None, "a a a b", "x" * 5000 + " architecture designs adr", "décision İx K2", "ab"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    tokens = {r.i: r.k or [] for r in df.select("i", tokenize("t").alias("k")).collect()}
    store, embedded = vectors._TokenVectors(P.VECTOR_DIMS), vectors.hash_embed(df, "t")
    for r in embedded.collect():
        total = sum((store.matrix[store.row(t)] for t in tokens[r.i]), np.zeros(P.VECTOR_DIMS, np.int64))
        norm = np.sqrt(float((total.astype(np.float64) ** 2).sum())) or 1.0
        assert list(r["values"]) == (np.floor(np.abs(total) / norm * 1e6 + 0.5) * np.sign(total)).astype(int).tolist()
    assert "regexp_extract_all" not in embedded._jdf.queryExecution().optimizedPlan().toString()


def test_stored_blocks_are_made_and_scored_without_a_row_per_posting(spark, monkeypatch):
    """Packs of a few postings give the same blocks; a search over them equals the one by rows, repositories of queries included."""
    from marginalia.operators import pruning as PR

    docs, plans = materialise(corpus(spark, odd_rows())), asked(spark)
    index = X.build_lexical_index(docs)
    monkeypatch.setattr(PR, "PACK_ROWS", 50)
    made = PR.posting_blocks(index, docs, per_block=8)
    assert "CoGroupsInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    index.blocks = materialise(made)
    held = index.blocks.filter("chunks IS NOT NULL").select("block", F.explode("chunks").alias("c")).select("block", "c.number", "c.chunk_id")
    lists = index.blocks.filter("numbers IS NOT NULL")
    got = lists.select("term", "block", F.explode(F.arrays_zip("numbers", "impacts")).alias("p")).select("term", "block", F.col("p.numbers").alias("number"), "p.impacts").join(held, ["block", "number"])
    want = index.postings.select("term", "chunk_id", X.bm25_impact(index.avg_len).alias("impacts"))
    assert sorted(map(tuple, got.select("term", "chunk_id", "impacts").collect())) == sorted(map(tuple, want.collect()))
    assert lists.filter("top <> array_max(impacts) OR n <> size(numbers)").count() == 0 and lists.groupBy("term", "block").count().filter("count > 1").count() == 0
    for scope, asking in (({}, plans), ({"note_type": "spec"}, plans), ({}, materialise(plans.withColumn("scope_repo", F.when(F.col("query_id") % 2 == 1, "home"))))):
        found = hits(X.lexical_search(asking, index, docs, pool=4, **scope))
        monkeypatch.setattr(scoring, "QUERIES", 0)
        assert [h[:3] for h in hits(X.lexical_search(asking, index, docs, pool=4, **scope))] == [h[:3] for h in found] != []
        monkeypatch.undo()


def test_similarity_takes_texts_as_query_ids_and_keeps_names_out(spark):
    """Query ids are texts, as the repositories are; many lists meet several queries and long names are joined to the pool only."""
    import numpy as np

    from marginalia.operators import vectors

    rng = np.random.default_rng(2)
    unit = [[int(v) for v in np.rint(x / np.linalg.norm(x) * 1e6)] for x in rng.standard_normal((3000, 8))]
    v = spark.createDataFrame([(i, x, "ok", "n" * 50 + str(i % 7)) for i, x in enumerate(unit)], "vec_id bigint, values array<bigint>, status string, heading string")
    q = spark.createDataFrame([(f"src{i}", unit[i], ["no"]) for i in range(9)], "query_id string, query_vector array<bigint>, excluded_statuses array<string>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.similarity_top(v, q, id_col="vec_id", pool=5, keys=["heading", "vec_id"], block=4).collect()}
    assert len(got) == 45 and all(got[f"src{i}", 1] == i for i in range(9))
    x = np.array(unit, np.int64)
    for i in range(9):
        micro = (x @ x[i] + 500_000) // 10**6
        best = sorted(range(3000), key=lambda j: (-micro[j], f"{j % 7}", j))[:5]
        assert [got[f"src{i}", k + 1] for k in range(5)] == best
