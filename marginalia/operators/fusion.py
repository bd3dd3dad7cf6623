"""Lane fusion, policy rerank and context assembly (FUS1-FUS5, CTX1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.joins import small
from marginalia.functions.text import estimate_tokens, lookup, pick, strings
from marginalia.operators.lexical import lexical_reasons, top_pool

LANES = ["lexical", "vector", "graph"]


def fuse(lexical: DataFrame, vector: DataFrame, graph: DataFrame, limit: int) -> DataFrame:
    """FUS1, FUS2: reciprocal-rank fusion, ordered and cut to ``limit`` per query.

    The three inputs are already cut to their pools; everything here is
    ``queries x pool`` rows.
    """
    def lane(df: DataFrame, name: str, extra: dict[str, Column]) -> DataFrame:
        empty = {
            "lexical_rank": F.lit(None).cast("int"), "vector_rank": F.lit(None).cast("int"),
            "graph_rank": F.lit(None).cast("int"), "lexical_score": F.lit(None).cast("double"),
            "similarity": F.lit(None).cast("double"), "graph_score": F.lit(None).cast("double"),
            "earlier": F.lit(None).cast("int"),
        }
        cols = {**empty, f"{name}_rank": F.col("rank").cast("int"), **extra}
        return df.select("query_id", "chunk_id", "source_file", "heading", *[c.alias(k) for k, c in cols.items()])

    rows = (
        lane(lexical, "lexical", {"lexical_score": F.col("score"), "earlier": F.col("earlier").cast("int")})
        .unionByName(lane(vector, "vector", {"similarity": F.col("similarity")}))
        .unionByName(lane(graph, "graph", {"graph_score": F.col("score")}))
    )
    merged = rows.groupBy("query_id", "chunk_id").agg(*[
        F.max(c).alias(c) for c in (
            "source_file", "heading", "lexical_rank", "vector_rank", "graph_rank",
            "lexical_score", "similarity", "graph_score", "earlier")
    ])
    raw = sum(
        (F.coalesce(F.lit(1.0) / (P.RRF_K + F.col(f"{n}_rank")), F.lit(0.0)) for n in LANES), F.lit(0.0)
    )
    sources = pick(*[(F.col(f"{n}_rank").isNotNull(), n) for n in LANES])
    scored = (
        merged.withColumn("raw", raw)
        .withColumn("lexical_score", F.coalesce("lexical_score", F.lit(0.0)))
        .withColumn("fused_score", F.round(F.col("raw") * 1000 + F.col("lexical_score"), 3))
        .withColumn("fused", F.round("raw", 6))
        .withColumn("sources", sources)
        .withColumn("source_label", F.when(F.size("sources") > 1, "hybrid").otherwise(F.element_at("sources", 1)))
        .drop("raw")
    )
    return top_pool(
        scored, limit, F.desc("fused_score"), F.desc(F.coalesce("similarity", F.lit(0.0))),
        "source_file", "heading", "chunk_id",
    ).withColumnRenamed("rank", "fused_rank")


def recency_boost(as_of: str) -> Column:
    """FUS4: freshness of sessions and todos; lexical hits only carry a date."""
    age = (
        F.unix_timestamp(F.lit(as_of).cast("timestamp"))
        - F.unix_timestamp(F.try_to_timestamp(F.when(F.col("lexical_rank").isNotNull(), F.col("updated"))))
    ) / 86400.0
    kind, wanted = F.col("type"), F.col("preferred_types")
    applies = (
        F.when(F.array_contains(wanted, "session"), kind == "session")
        .when(F.array_contains(wanted, "todo"), kind == "todo")
        .otherwise(F.size(wanted) == 0)
    )
    boost = (
        F.when((kind == "session") & (age <= 7), 6.0)
        .when((kind == "session") & (age <= 30), 3.0)
        .when((kind == "todo") & (age <= 30), 4.0)
        .otherwise(0.0)
    )
    return F.when(applies, boost).otherwise(0.0)


def policy_rerank(fused: DataFrame, plans: DataFrame, as_of: str, integrity_mode: str = "prefer-healthy") -> DataFrame:
    """FUS3-FUS5: policy boosts over fused candidates that carry corpus columns."""
    kind, status = F.col("type"), F.col("status")
    preferred = F.col("preferred_types")
    type_boost = F.coalesce(lookup(P.TYPE_BOOSTS, kind), F.lit(0.0))
    is_wanted = F.array_contains(preferred, kind)
    has_wish = F.size(preferred) > 0
    status_boost = F.coalesce(lookup(P.STATUS_BOOSTS, status), F.lit(0.0))
    siblings = F.count("*").over(Window.partitionBy("query_id", "note_id"))
    role = F.lower("heading")
    role_boost = F.when(
        (kind == "session") & (F.col("siblings") >= 2),
        F.coalesce(lookup(P.SESSION_HEADING_BOOSTS, role), F.lit(0.0)),
    ).otherwise(0.0)
    warned = F.col("validation_status") == "warning"
    integrity = {"prefer-healthy": -P.INTEGRITY_DELTA, "prefer-warning": P.INTEGRITY_DELTA}.get(integrity_mode, 0.0)

    ready = (
        fused.join(small(plans.select("query_id", "query", "preferred_types", "allow_archived", "needle", "terms"), like=plans), "query_id")
        .withColumn("siblings", siblings)
        .withColumn("recency", recency_boost(as_of))
    )
    plan_delta = (
        F.when(is_wanted, type_boost + P.PREFERRED_TYPE_BONUS)
        .when(has_wish, -P.TYPE_MISMATCH_PENALTY)
        .otherwise(type_boost)
    )
    score = F.round(
        F.col("fused_score") + plan_delta + status_boost + F.col("recency") + role_boost
        + F.when(warned, integrity).otherwise(0.0),
        3,
    )
    in_lexical, in_vector, in_graph = (F.col(f"{n}_rank").isNotNull() for n in LANES)
    reasons = F.array_distinct(F.concat(
        F.when(in_lexical, lexical_reasons()).otherwise(strings([])),
        pick((F.coalesce(F.col("earlier") > 0, F.lit(False)), "duplicate-note-penalty")),
        F.when(in_vector, F.array(
            F.lit("source:vector"),
            F.lit(f"vector-engine:{P.VECTOR_ENGINE}"),
            F.concat(F.lit("vector-cosine:"), F.format_string("%.3f", F.coalesce("similarity", F.lit(0.0)))),
        )).otherwise(strings([])),
        F.when(in_graph, F.array(
            F.lit("route:graph"),
            F.when(F.col("graph_score") == P.GRAPH_SCORES[1], "graph:direct").otherwise("graph:distance-2"),
            F.lit("source:graph"),
        )).otherwise(strings([])),
        F.array(F.concat(F.lit("source:"), F.col("source_label"))),
        F.array_compact(F.array(
            F.when(is_wanted, F.concat(F.lit("plan-type:"), kind))
            .when(has_wish, F.lit("plan-type:mismatch"))
            .when(type_boost != 0, F.concat(F.lit("note-type:"), kind)),
            F.when(status_boost != 0, F.concat(F.lit("status:"), status)),
            F.when(F.col("recency") > 0, F.concat(F.lit("recency:"), kind)),
            F.when(role_boost != 0, F.concat(F.lit("session-heading:"), F.regexp_replace(role, r"\s+", "-"))),
            F.when(warned & F.lit(integrity < 0), F.lit("integrity:warning")),
            F.when(warned & F.lit(integrity > 0), F.lit("integrity:prefer-warning")),
            F.when(F.col("allow_archived") & status.isin(*P.EXCLUDED_STATUSES), F.lit("route:archive")),
        )),
    ))
    w = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.desc("fused"), F.desc(F.coalesce("similarity", F.lit(0.0))),
        "source_file", "heading", "chunk_id",
    )
    return (
        ready.withColumn("reasons", reasons)
        .withColumn("score", score)
        .withColumn("rank", F.row_number().over(w))
    )


# What a reference says about a chunk; an item adds score reasons, text and size.
REFERENCE = ["note_id", "source_file", "source_path", "heading", "type", "status", "validation_status", "validation_issues", "score"]


def assemble_context(
    ranked: DataFrame, budget: int = P.DEFAULT_TOKEN_BUDGET, max_items: int | None = None,
) -> DataFrame:
    """CTX1: one bundle per query from hits ``query_id, rank, chunk_id, note_id, text`` and more.

    ``items`` and ``references`` are structs of the taken hits, as far as the hits
    have their columns; ``omitted`` names the hits that would exceed the budget, with
    the reason.  A hit that does not fit is skipped and later ones may still fit, so
    this is a fold and not a running sum.  The folded list has at most the result
    limit of rows per query.
    """
    hits = ranked if max_items is None else ranked.filter(F.col("rank") <= max_items)
    named = [c for c in REFERENCE if c in hits.columns and c != "note_id"]
    reasons = [c for c in ("reasons",) if c in hits.columns]
    item = F.struct("rank", "chunk_id", "note_id", *named, *reasons, "text", estimate_tokens("text").alias("tokens"))
    totals = ranked.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item), lambda x, y: x["rank"] - y["rank"]).alias("hits"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(acc, hit):
        fits = acc["used"] + hit["tokens"] <= budget
        return F.struct((acc["used"] + F.when(fits, hit["tokens"]).otherwise(0)).alias("used"), F.concat(acc["fits"], F.array(fits)).alias("fits"))

    folded = lists.withColumn("f", F.aggregate("hits", start, step)).withColumns({
        "taken": F.filter("hits", lambda h, i: F.get(F.col("f.fits"), i)), "left": F.filter("hits", lambda h, i: ~F.get(F.col("f.fits"), i))})
    return folded.join(totals, "query_id").select(
        "query_id",
        F.transform("taken", lambda h: F.struct(*[h[c].alias(c) for c in ("note_id", "chunk_id", *named, *reasons, "text")], h["tokens"].alias("estimated_tokens"))).alias("items"),
        F.transform("taken", lambda h: F.struct(*[h[c].alias(c) for c in ("note_id", *named)])).alias("references"),
        F.transform("left", lambda h: F.struct(h["note_id"].alias("note_id"), h["chunk_id"].alias("chunk_id"), F.lit("token_budget").alias("reason"))).alias("omitted"),
        "candidate_count",
        F.size("taken").cast("long").alias("selected_count"),
        F.col("f.used").alias("estimated_tokens"),
        F.lit(budget).cast("long").alias("token_budget"),
        ((F.size("left") > 0) | (F.size("taken") < F.size("hits"))).alias("truncated"),
    )
