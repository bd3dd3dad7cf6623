"""Judged retrieval (EVL1-EVL3) and keyed lookups (FLT2, FLT3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.joins import small
from marginalia.functions.text import strings
from marginalia.operators.fusion import assemble_context


def evaluate_retrieval(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """EVL1: per ``(query_id, mode)`` whether the expected chunk came first.

    ``results`` has ``query_id, mode, rank, chunk_id``; ``judgements`` has
    ``query_id, mode, expected_chunk_id``.
    """
    top = results.filter(F.col("rank") == 1).select("query_id", "mode", F.col("chunk_id").alias("actual_chunk_id"))
    return judgements.join(top, ["query_id", "mode"], "left").withColumn(
        "passed", F.coalesce(F.col("actual_chunk_id") == F.col("expected_chunk_id"), F.lit(False)))


def evaluation_summary(judged: DataFrame) -> DataFrame:
    """Pass and fail counts by mode."""
    return judged.groupBy("mode").agg(
        F.count("*").alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"),
        F.sum((~F.col("passed")).cast("long")).alias("failed"))


def evaluate_hits_at_k(results: DataFrame, judgements: DataFrame, k: int = 3) -> DataFrame:
    """EVL2: expected file (and heading, when given) among the first ``k`` hits."""
    close = results.filter(F.col("rank") <= k).select("query_id", "source_file", "heading")
    joined = judgements.join(close, "query_id", "left")
    hit = F.endswith("source_file", F.col("expected_path")) & (
        F.col("expected_heading").isNull() | (F.col("heading") == F.col("expected_heading")))
    return joined.groupBy(*judgements.columns).agg(
        F.coalesce(F.max(hit), F.lit(False)).alias("passed"))


def golden_checks(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """EVL2: the hit check of every judgement with the small context its query would get.

    ``results`` are hits with text; of the first hits the context takes
    ``GOLDEN_ITEMS`` at most, within ``GOLDEN_TOKENS``.
    """
    close = results.filter(F.col("rank") <= P.GOLDEN_HITS)
    context = assemble_context(close, P.GOLDEN_TOKENS, max_items=P.GOLDEN_ITEMS)
    return evaluate_hits_at_k(close, judgements, P.GOLDEN_HITS).join(
        context.select("query_id", "selected_count", F.col("estimated_tokens").alias("context_tokens"), "references"), "query_id", "left")


def evaluate_catalog(ranked: DataFrame, judgements: DataFrame) -> DataFrame:
    """EVL3: first entry, membership in the first three, and no forbidden entry.

    ``ranked`` has ``query_id, rank, id``; at most three rows per query are
    gathered.
    """
    firsts = ranked.filter(F.col("rank") <= 3).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("got"))
    banned = judgements.select("query_id", F.explode("forbidden").alias("id")).join(
        ranked.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_forbidden"))
    got = F.coalesce("got", strings([]))
    return judgements.join(firsts, "query_id", "left").join(banned, "query_id", "left").select(
        "query_id",
        F.coalesce(F.try_element_at(got, F.lit(1)) == F.col("expected_top_1"), F.lit(False)).alias("top_1_ok"),
        (F.size(F.array_except("expected_top_3", got)) == 0).alias("top_3_ok"),
        F.col("n_forbidden").isNull().alias("forbidden_ok"),
    )


def find_chunk(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """FLT2: for each key row the first chunk by source path, or by file and heading.

    ``keys`` has ``key_id, source_path, source_file, heading``; a given source
    path is used alone.
    """
    first = F.min(F.struct("chunk_id", "note_id", "source_path", "heading")).alias("c")
    named = F.coalesce("source_path", F.lit("")) != ""
    by_path = keys.filter(named).select("key_id", "source_path")
    by_file = keys.filter(~named).select("key_id", "source_file", "heading")
    a = corpus.join(small(by_path, like=keys), "source_path").groupBy("key_id").agg(first)
    b = corpus.join(small(by_file, like=keys), ["source_file", "heading"]).groupBy("key_id").agg(first)
    found = a.unionByName(b).select("key_id", "c.*")
    return keys.select("key_id").join(found, "key_id", "left")


def repo_context(corpus: DataFrame, slugs: DataFrame, headings: list[str] = P.REPO_CONTEXT_HEADINGS) -> DataFrame:
    """FLT3: the repo-home chunks of each slug under the given headings, in list order.

    The heading list is a literal, so the filter reaches the scan.
    """
    position = F.coalesce(*[F.when(F.col("heading") == h, F.lit(i + 1)) for i, h in enumerate(headings)])
    home = corpus.filter((F.col("type") == "repo-home") & F.col("heading").isin(headings)).filter(
        F.endswith("source_file", F.concat(F.lit(f"{P.REPOSITORY_ROOT}/"), "repo_slug", F.lit(f"/{P.REPO_HOME_FILE}"))))
    return (
        home.join(slugs.select("repo_slug").distinct(), "repo_slug", "left_semi")
        .withColumn("position", position)
        .groupBy("repo_slug", "position")
        .agg(F.min(F.struct("chunk_id", "heading", "source_path", "text")).alias("c"))
        .select("repo_slug", "position", "c.*")
    )
