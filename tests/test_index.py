"""Stored indexes: layout, posting blocks with bounds, segments that follow changes."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.joins import materialise
from marginalia.operators import lexical as X
from marginalia.operators import pruning as PR
from marginalia.operators import queries as Q
from marginalia.plans import segments as G
from marginalia.plans.index import build_index
from marginalia.sources import files

COLUMNS = ("chunk_id string, note_id string, source_file string, source_path string, heading string, type string, status string, repo_slug string, tags array<string>, "
           "keywords array<string>, summary string, chunk_summary string, title string, text string, validation_status string, mtime_ms double")
VOCAB = [f"{a}{b}" for a in ("lor", "mem", "shell", "rout", "plan") for b in range(25)]


def rows_of(names, seed, mtime=1.0, chunks=2):
    rng = random.Random(seed)
    rows = []
    for n in names:
        for c in range(chunks):
            words = " ".join(rng.choices(VOCAB, [1 / (i + 1) for i in range(len(VOCAB))], k=rng.randrange(1, 50)))
            rows.append((f"{n}-{c}", n, f"vault/{n}.md", f"vault/{n}.md § h{c}", f"h{c}", rng.choice(["spec", "session"]), rng.choice(["active", "superseded", "done"]),
                         rng.choice(["home", "away"]), [rng.choice(VOCAB)], [], None, None, f"Title {n}", words, rng.choice(["ok", "warning"]), mtime))
    return rows


def corpus(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def plans(spark, n=12):
    rng = random.Random(9)
    q = [(i, " ".join(rng.choices(VOCAB, k=rng.randrange(1, 6)))) for i in range(n)] + [(98, "title n7"), (99, "zzz"), (97, "lor0")]
    return materialise(Q.plan_queries(spark.createDataFrame(q, "query_id bigint, query string")))


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


def test_postings_are_read_by_folder_and_keep_bloom_filters(spark, tmp_path):
    path = str(tmp_path / "postings")
    rows = X.postings(corpus(spark, rows_of([f"n{i}" for i in range(30)], 1)))
    files.write_postings(rows, path)
    stored = spark.read.parquet(path)
    assert sorted(map(tuple, stored.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    cut = X.prune_parts(stored, spark.createDataFrame([("lor0",), ("mem3",)], "term string"))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(cut.inputFiles()) < len(stored.inputFiles()) or len({f for f in cut.select(F.input_file_name()).distinct().collect()}) <= 2


@pytest.mark.parametrize("scope", [{}, {"repo_slug": "home"}, {"note_type": "spec", "integrity_mode": "exclude-warning"}])
def test_pruned_search_equals_the_full_score(spark, tmp_path, scope):
    docs = materialise(corpus(spark, rows_of([f"n{i}" for i in range(120)], 2)))
    full = X.build_lexical_index(docs)
    PR.write_blocks(PR.posting_blocks(full, docs, per_block=8), str(tmp_path / "blocks"))
    stored = X.LexicalIndex(full.postings, full.term_df, full.n_docs, full.avg_len, spark.read.parquet(str(tmp_path / "blocks")))
    asked = plans(spark)
    for pool in (1, 5):
        assert hits(X.lexical_search(asked, stored, docs, pool=pool, **scope)) == hits(X.lexical_search(asked, full, docs, pool=pool, **scope))


def test_blocks_below_the_bound_are_skipped(spark):
    """One block holds the best chunks of a rare term; most other blocks cannot reach them."""
    rows = rows_of([f"n{i}" for i in range(200)], 3)
    rows = [r[:13] + (r[13] + (" rare rare rare" if i % 40 == 0 else ""),) + r[14:] for i, r in enumerate(rows)]
    docs = materialise(corpus(spark, rows))
    index = X.build_lexical_index(docs)
    index.blocks = materialise(PR.posting_blocks(index, docs, per_block=10))
    asked = materialise(Q.plan_queries(spark.createDataFrame([(1, "rare lor0 lor1")], "query_id bigint, query string")))
    bounds, reached = PR.candidate_blocks(asked, index, 1)
    assert reached.count() < 0.6 * bounds.count() and reached.join(bounds, ["query_id", "block"], "left_anti").count() == 0


def test_a_written_index_holds_corpus_and_cleanup_report(spark, tmp_path):
    text = "---\nid: {i}\ntype: spec\nstatus: active\ntitle: T {i}\nsummary: about {i}\n---\n\n# T {i}\n\nSome words about lor{i} and mem.\n"
    raw = spark.createDataFrame([(f"vault/n{i}.md", text.format(i=i), float(i)) for i in range(5)], "path string, content string, mtime_ms double")
    index = build_index(raw)
    files.write_index(index.tables(as_of="2026-01-05"), str(tmp_path))
    assert {r.note_id for r in spark.read.parquet(f"{tmp_path}/corpus").collect()} == {r.id for r in index.notes.collect()}
    assert "bucket" in spark.read.parquet(f"{tmp_path}/cleanup_report").columns
    loaded = files.load_index(spark, str(tmp_path))
    assert loaded.lexical.blocks is not None and loaded.vector_status == "ready" and "values" in loaded.corpus.columns
    asked = materialise(Q.plan_queries(spark.createDataFrame([(1, "lor3 words")], "query_id bigint, query string")))
    assert hits(X.lexical_search(asked, loaded.lexical, loaded.corpus, pool=3)) == hits(X.lexical_search(asked, X.build_lexical_index(loaded.corpus), loaded.corpus, pool=3)) != []


def state_of(spark, folder):
    n = G.segments(spark, folder)
    lexicon = {r.term: r.df for r in G.term_df(spark, folder, n).collect()}
    return lexicon, tuple(G.stats(spark, folder, n).first()), sorted(r.chunk_id for r in G.live(spark, folder, "corpus", n).collect())


def rebuilt(spark, rows):
    index = X.build_lexical_index(corpus(spark, rows))
    return ({r.term: r.df for r in index.term_df.collect()}, tuple(X.field_stats(corpus(spark, rows)).first()), sorted(r[0] for r in rows))


def test_segments_equal_a_rebuild_after_every_batch(spark, tmp_path):
    folder = str(tmp_path / "index")
    have = {n: rows_of([n], n) for n in (f"n{i}" for i in range(20))}
    G.update(spark, folder, 0, corpus(spark, sum(have.values(), [])))
    assert state_of(spark, folder) == rebuilt(spark, sum(have.values(), []))
    # Changed files lose or gain chunks, some come new, some go; one is listed unchanged, one comes twice.
    second = {"n1": rows_of(["n1"], "b", 2.0, 3), "n2": rows_of(["n2"], "c", 2.0, 1), "new": rows_of(["new"], "d", 1.0)}
    older = rows_of(["n2"], "zz", 1.5, 4)
    same = [r[:13] + ("other text that does not count",) + r[14:] for r in have["n5"]]
    gone = spark.createDataFrame([("vault/n3.md",), ("vault/n4.md",), ("vault/never.md",)], "path string")
    G.update(spark, folder, 1, corpus(spark, sum(second.values(), []) + older + same), gone)
    have = {k: v for k, v in (have | second).items() if k not in ("n3", "n4")}
    assert state_of(spark, folder) == rebuilt(spark, sum(have.values(), []))
    # A file that went comes back, a changed one changes again; the batch is run twice.
    third = {"n3": rows_of(["n3"], "e", 1.0), "n1": rows_of(["n1"], "f", 3.0, 2)}
    for _ in range(2):
        G.update(spark, folder, 2, corpus(spark, sum(third.values(), [])))
    have |= third
    every = sum(have.values(), [])
    assert state_of(spark, folder) == rebuilt(spark, every)
    docs, index = G.load(spark, folder)
    want = hits(X.lexical_search(plans(spark), X.build_lexical_index(corpus(spark, every)), corpus(spark, every), pool=5))
    assert hits(X.lexical_search(plans(spark), index, docs, pool=5)) == want
    G.compact(spark, folder, str(tmp_path / "small"))
    assert state_of(spark, str(tmp_path / "small")) == rebuilt(spark, every)
    assert {tuple(r) for r in G.manifest(spark, str(tmp_path / "small"), 1).collect()} == {(r[2], r[15]) for r in every}


def test_a_stream_of_changes_keeps_the_index_in_step(spark, tmp_path):
    schema = "path string, content string, mtime_ms double, gone boolean"
    src, folder = str(tmp_path / "src"), str(tmp_path / "index")

    def to_corpus(batch):
        return batch.select(
            F.concat("path", F.lit("-0")).alias("chunk_id"), F.col("path").alias("note_id"), F.col("path").alias("source_file"), F.col("path").alias("source_path"), F.lit("h").alias("heading"),
            F.lit("spec").alias("type"), F.lit("active").alias("status"), F.lit("home").alias("repo_slug"), F.array(F.lit("t")).alias("tags"), F.array(F.lit("k")).alias("keywords"),
            F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("chunk_summary"), F.lit("T").alias("title"), F.col("content").alias("text"), F.lit("ok").alias("validation_status"), "mtime_ms")

    batches = [[("a", "one two", 1.0, None), ("b", "two three", 1.0, False)], [("a", "four", 2.0, None), ("b", None, None, True), ("c", "one", 1.0, None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        G.follow(spark.readStream.schema(schema).parquet(src), to_corpus, folder, str(tmp_path / "progress")).awaitTermination()
    assert G.segments(spark, folder) == 2
    lexicon = state_of(spark, folder)[0]
    assert lexicon["four"] == lexicon["one"] == 1 and "two" not in lexicon and "three" not in lexicon


def test_known_terms_are_kept_before_any_sort(spark):
    """Postings of given terms equal those of the whole index, by either way, and other tokens are never sorted."""
    docs = materialise(corpus(spark, rows_of([f"n{i}" for i in range(40)], 5)))
    terms = spark.createDataFrame([("lor1",), ("mem2",), ("lor1",), ("nowhere",), ("vault",)], "term string")
    want = sorted(map(tuple, X.postings(docs).filter(F.col("term").isin("lor1", "mem2", "vault")).collect()))
    kept = X.postings(docs, terms)
    assert sorted(map(tuple, kept.collect())) == want != []
    assert "array_sort" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.columns == X.postings(docs).columns


def test_blocks_hold_each_chunk_once(spark):
    """Postings are numbers; ids and states are in one directory row per block."""
    docs = materialise(corpus(spark, rows_of([f"n{i}" for i in range(40)], 5)))
    index = X.build_lexical_index(docs)
    blocks = materialise(PR.posting_blocks(index, docs, per_block=8))
    held = blocks.filter("chunks IS NOT NULL").select("block", F.explode("chunks").alias("c")).select("block", "c.number", "c.chunk_id")
    assert sorted(r.chunk_id for r in held.collect()) == sorted(r.chunk_id for r in docs.collect())
    postings = blocks.filter("numbers IS NOT NULL").select("term", "block", F.explode("numbers").alias("number"))
    got = sorted(map(tuple, postings.join(held, ["block", "number"]).select("term", "chunk_id").collect()))
    assert got == sorted(map(tuple, index.postings.select("term", "chunk_id").collect()))


def test_tombstones_meet_only_postings_of_the_queries(spark, tmp_path):
    """Dead postings do not score, and terms of no query are dropped before tombstones are joined."""
    folder = str(tmp_path / "index")
    G.update(spark, folder, 0, corpus(spark, rows_of(["n1", "n2", "n3"], "a")))
    G.update(spark, folder, 1, corpus(spark, rows_of(["n2"], "b", 2.0, 1)), spark.createDataFrame([("vault/n3.md",)], "path string"))
    _, index = G.load(spark, folder)
    scored = X.bm25(plans(spark), index)
    alone = X.LexicalIndex(index.postings, index.term_df, index.n_docs, index.avg_len)
    got, want = ({(r.query_id, r.chunk_id): round(r.bm25, 9) for r in X.bm25(plans(spark), i).collect()} for i in (index, alone))
    assert got == want and got
    joins = [x.split("Join ")[1].split(",")[0] for x in scored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins.index("LeftSemi") > joins.index("LeftOuter")  # the deeper one comes first
