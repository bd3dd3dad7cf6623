"""FUS6: hybrid search for a whole table of queries in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.joins import materialise, small
from marginalia.functions.text import is_substantive
from marginalia.operators import evals, fusion, lexical, links, vectors
from marginalia.operators.queries import plan_queries


@dataclass
class SearchIndex:
    """What a search reads: corpus (with ``values`` when vectors exist), edges, postings.

    ``lexical`` is ``None`` for corpora without an index of the current schema
    version; the heuristic score is then used.
    """

    corpus: DataFrame
    edges: DataFrame
    lexical: lexical.LexicalIndex | None = None
    vector_status: str = "missing"


def vector_state(vector_mode: str, status: str) -> tuple[str, str | None]:
    """Status and reason of the vector lane."""
    if vector_mode == "off":
        return "disabled", "disabled_by_request"
    reasons = {
        "ready": None,
        "missing": "vector_index_missing",
        "legacy": "legacy_corpus_has_no_vector_index",
    }
    return status, reasons.get(status, "vector_index_not_ready")


def asked_limit(limit: int | None) -> int:
    """The limit asked for, 5 without one; below 1 is an error."""
    if limit is not None and int(limit) < 1:
        raise ValueError(f"limit must be 1 or more: {limit}")
    return 5 if limit is None else int(limit)


def search(
    queries: DataFrame, index: SearchIndex, *, as_of: str, limit: int | None = None,
    repo_slug: str | None = None, note_type: str | None = None,
    integrity_mode: str = "prefer-healthy", vector_mode: str = "auto",
    retrieval_mode: str = "default", keep_thin: bool = False,
) -> DataFrame:
    """Ranked hits per query: ``query_id, rank, chunk_id, ..., score, reasons``.

    Thin hits are removed after ranking, so a query may return fewer than
    ``limit`` rows.
    """
    limit = asked_limit(limit)
    pool = lexical.pool_size(limit, retrieval_mode)
    scope = dict(repo_slug=repo_slug, note_type=note_type, integrity_mode=integrity_mode)
    plans = materialise(plan_queries(queries.filter(F.trim("query") != "")))

    if index.lexical is None:
        ranked = lexical.heuristic_lexical(plans, index.corpus, pool=pool, **scope)
    else:
        ranked = lexical.lexical_search(plans, index.lexical, index.corpus, pool=pool, **scope)
    # Used by the graph lane and by fusion: queries x pool rows.
    ranked = materialise(ranked)
    graph = links.graph_search(ranked, plans, index.edges, index.corpus, pool=pool, **scope)
    status, reason = vector_state(vector_mode, index.vector_status)
    if status == "ready":
        vector = vectors.vector_search(plans, index.corpus, pool=pool, **scope)
    else:
        vector = ranked.limit(0).withColumn("similarity", F.lit(0.0))

    fused = materialise(fusion.fuse(lexical.duplicate_penalty(ranked), vector, graph, limit))
    hits = index.corpus.drop("values").join(small(fused.drop("source_file", "heading")), "chunk_id")
    out = fusion.policy_rerank(hits, plans, as_of, integrity_mode)
    if not keep_thin:
        w = Window.partitionBy("query_id").orderBy("rank")
        out = out.filter(is_substantive("text")).withColumn("rank", F.row_number().over(w))
    return out.withColumn("vector_status", F.lit(status)).withColumn(
        "vector_reason", F.lit(reason).cast("string")
    )


def repo_queries(slugs: DataFrame) -> DataFrame:
    """The architecture question of each repository, asked within it."""
    return slugs.select("repo_slug").filter(F.col("repo_slug").isNotNull()).distinct().select(
        F.col("repo_slug").alias("query_id"), F.concat(F.lit(P.REPO_FALLBACK_QUERY), "repo_slug").alias("query"), F.col("repo_slug").alias("scope_repo"))


def repo_context(slugs: DataFrame, index: SearchIndex, *, as_of: str) -> DataFrame:
    """FLT3: context of each repository: ``repo_slug, position, chunk_id, origin``.

    The chunks of its home note, or, where there is none, the hits of a search for
    its architecture within the repository.  An index built for ``repo_queries`` of
    these slugs has all that the search reads.
    """
    asked = materialise(repo_queries(slugs))
    home = materialise(evals.repo_context(index.corpus, asked.select("scope_repo").withColumnRenamed("scope_repo", "repo_slug")))
    queries = asked.join(home.select(F.col("repo_slug").alias("scope_repo")), "scope_repo", "left_anti")
    found = search(queries, index, as_of=as_of, limit=P.REPO_FALLBACK_LIMIT)
    return home.select("repo_slug", F.col("position").cast("int").alias("position"), "chunk_id", F.lit("home").alias("origin")).unionByName(
        found.select(F.col("query_id").alias("repo_slug"), F.col("rank").alias("position"), "chunk_id", F.lit("search").alias("origin")))


def lexical_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of the planned queries, to build restricted postings."""
    return plan_queries(queries).select(F.explode("terms").alias("term")).distinct()


def build_search_index(
    corpus: DataFrame, edges: DataFrame, queries: DataFrame | None = None, with_vectors: bool = True,
) -> SearchIndex:
    """Index straight from a corpus.

    The corpus, with its vectors, is written once in columns: a search reads it
    several times and mostly without the texts.  Given the queries, only
    postings of their terms are made.
    """
    docs = materialise(vectors.embed_chunks(corpus) if with_vectors else corpus)
    terms = materialise(lexical_terms(queries)) if queries is not None else None
    return SearchIndex(docs, edges, lexical.build_lexical_index(docs, terms), "ready" if with_vectors else "missing")
