"""Use signals over retrieval events (CHK8, JON5, JON6, RPT1-RPT3).

Events have ``event_id, timestamp, tool, query, results array<struct<rank,
chunk_id, source_path, retrieval_sources>>, target struct<chunk_id,
source_path>``; their order is ``(timestamp, event_id)``.

Scale notes
-----------
Matching an unfold to the latest earlier search is an as-of join by volume: all
rows are ranged by (key, time) into parts of about ``ROWS_PER_RANGE`` rows, so that
a key that holds a third of all events is cut into as many ranges as it needs.
Inside a range a window looks back; across ranges only one row per key and range
is carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.joins import materialise

ROWS_PER_RANGE = 1_000_000
TARGET = "struct<chunk_id:string,note_id:string,source_path:string,source_file:string,heading:string,strong_use:boolean>"
RESULTS = ("array<struct<rank:bigint,chunk_id:string,note_id:string,source_path:string,source_file:string,heading:string,score:double,"
           "weak_use:boolean,strong_use:boolean,retrieval_sources:array<string>>>")


def explode_results(events: DataFrame) -> DataFrame:
    """CHK8: one row per shown result; events without results keep one row."""
    return events.select(
        "event_id", "timestamp", "tool", "query", F.posexplode_outer("results").alias("position", "r")
    ).select("event_id", "timestamp", "tool", "query", "position", "r.*")


def _shown(hits: DataFrame) -> Column:
    """A hit as the event log keeps it: shown is weak use, opened would be strong use."""
    of = lambda c, kind: (F.col(c) if c in hits.columns else F.lit(None)).cast(kind).alias(c)
    if "retrieval_sources" in hits.columns:
        sources = F.col("retrieval_sources")
    elif "reasons" in hits.columns:
        sources = F.transform(F.filter("reasons", lambda r: r.isin("source:lexical", "source:vector", "source:graph")), lambda r: F.substring_index(r, ":", -1))
    else:
        sources = F.array().cast("array<string>")
    return F.struct(
        F.col("rank").cast("long").alias("rank"), *[of(c, "string") for c in ("chunk_id", "note_id", "source_path", "source_file", "heading")],
        of("score", "double"), F.lit(True).alias("weak_use"), F.lit(False).alias("strong_use"), sources.alias("retrieval_sources"))


def shown_events(asked: DataFrame, hits: DataFrame, tool: str = "memory_search") -> DataFrame:
    """SRC7: one event per row of ``asked`` (``query_id, event_id, timestamp, query``) with its hits in order.

    A question without hits gives an event with an empty list.  ``tool`` is
    ``memory_search``, or ``memory_context`` for hits of a repository's context.
    A list has at most the result limit of entries.
    """
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(_shown(hits)), lambda x, y: (x["rank"] - y["rank"]).cast("int")).alias("results"))
    empty = F.array().cast(lists.schema["results"].dataType)
    return asked.select("query_id", "event_id", "timestamp", "query").join(lists, "query_id", "left").select(
        "timestamp", "event_id", F.lit(tool).alias("tool"), "query", F.coalesce("results", empty).alias("results"), F.lit(None).cast(TARGET).alias("target"))


def unfold_events(opened: DataFrame) -> DataFrame:
    """SRC7: one event per opened chunk (``event_id, timestamp`` and the chunk's columns), a strong use."""
    target = F.struct(*[F.col(c).cast("string").alias(c) for c in ("chunk_id", "note_id", "source_path", "source_file", "heading")], F.lit(True).alias("strong_use"))
    return opened.select("timestamp", "event_id", F.lit("memory_unfold").alias("tool"), F.lit(None).cast("string").alias("query"),
                         F.lit(None).cast(RESULTS).alias("results"), target.alias("target"))


def searches(events: DataFrame) -> DataFrame:
    return events.filter((F.col("tool") == "memory_search") & (F.coalesce("query", F.lit("")) != ""))


def unfolds(events: DataFrame) -> DataFrame:
    return events.filter((F.col("tool") == "memory_unfold") & F.col("target").isNotNull())


def is_vector_only(sources: Column) -> Column:
    return F.array_contains(sources, "vector") & ~F.array_contains(sources, "lexical")


def _keys(chunk_id: Column, source_path: Column) -> Column:
    """The non-empty match keys of a result or target: chunk id and path."""
    def key(kind: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(kind + ":"), c))

    return F.array_compact(F.array(key("chunk", chunk_id), key("path", source_path)))


def use_signals(events: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """JON6: per unfold the latest earlier search that showed its target.

    Returns ``event_id`` (the unfold), ``search_id`` and the matched result's
    ``rank, chunk_id, source_path`` (the first matching result of the search).
    """
    spot = F.struct("timestamp", "event_id")
    shown = (
        searches(events)
        .select(spot.alias("at"), F.posexplode("results").alias("position", "r"))
        .select(
            "at",
            F.struct("at", "position", "r.rank", "r.chunk_id", "r.source_path").alias("hit"),
            F.explode(_keys(F.col("r.chunk_id"), F.col("r.source_path"))).alias("key"),
        )
        # The same key twice in one search: its first result counts.
        .groupBy("key", "at").agg(F.min("hit").alias("hit"))
    )
    asked = unfolds(events).select(
        spot.alias("at"), F.explode(_keys(F.col("target.chunk_id"), F.col("target.source_path"))).alias("key"))
    rows = shown.select("key", "at", "hit", F.lit(False).alias("is_unfold")).unionByName(
        asked.withColumn("hit", F.lit(None).cast(shown.schema["hit"].dataType)).withColumn("is_unfold", F.lit(True)))
    most = int(events.agg(F.sum(2 * F.coalesce(F.array_size("results"), F.lit(0)) + 2)).first()[0] or 1)
    parts = -(-most // rows_per_range)
    # Ranges are numbered in the order of (key, at); they are written, as the numbers come from the running tasks.
    rows = materialise(rows.repartitionByRange(parts, "key", "at").withColumn("bucket", F.spark_partition_id()))
    shown, asked = rows.filter("NOT is_unfold"), rows.filter("is_unfold")
    # Level one: the latest search of the same range.
    back = Window.partitionBy("key", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("hit", ignorenulls=True).over(back)).filter("is_unfold")
    # Level two: the last search of each earlier range, one row per key and range.
    ends = shown.groupBy("key", "bucket").agg(F.max_by("hit", "at").alias("end"))
    asked_ranges = asked.select("key", "bucket").distinct().withColumn("end", F.lit(None).cast(shown.schema["hit"].dataType))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.unionByName(asked_ranges).groupBy("key", "bucket").agg(F.max("end").alias("end"))
        .withColumn("carried", F.last("end", ignorenulls=True).over(earlier))
        .select("key", "bucket", "carried")
    )
    matched = near.join(carried, ["key", "bucket"], "left").withColumn("best", F.coalesce("near", "carried"))
    # Chunk and path keys may find different searches: keep the later one, and
    # inside one search the earlier result.
    later = F.struct(F.col("best.at").alias("at"), (-F.col("best.position")).alias("first"))
    return (
        matched.filter(F.col("best").isNotNull())
        .groupBy(F.col("at.event_id").alias("event_id"))
        .agg(F.max_by("best", later).alias("b"))
        .select(
            "event_id", F.col("b.at.event_id").alias("search_id"), "b.rank", "b.chunk_id", "b.source_path",
        )
    )


def _with_top(signals: DataFrame, events: DataFrame) -> DataFrame:
    top = searches(events).select(
        F.col("event_id").alias("search_id"), "query", F.try_element_at("results", F.lit(1)).alias("top"))
    return signals.join(top, "search_id")


def lower_rank_wins(signals: DataFrame, events: DataFrame) -> DataFrame:
    """RPT2: uses of a result below the first rank, with the first one."""
    return _with_top(signals.filter(F.col("rank") > 1), events).select(
        "event_id", "query", F.col("rank").alias("selected_rank"), F.col("chunk_id").alias("selected_chunk_id"),
        F.col("source_path").alias("selected_source_path"), F.col("top.chunk_id").alias("top_chunk_id"),
        F.col("top.source_path").alias("top_source_path"),
    )


def weak_only(signals: DataFrame, events: DataFrame) -> DataFrame:
    """RPT1: searches none of whose results was used."""
    used = signals.select(F.col("search_id").alias("event_id")).distinct()
    top = F.try_element_at("results", F.lit(1))
    results = F.coalesce("results", F.array().cast(events.schema["results"].dataType))
    return searches(events).join(used, "event_id", "left_anti").select(
        "event_id", "query", F.size(results).cast("long").alias("result_count"),
        top["rank"].alias("top_rank"), top["chunk_id"].alias("top_chunk_id"), top["source_path"].alias("top_source_path"),
        F.transform(F.filter(results, lambda r: is_vector_only(r["retrieval_sources"])), lambda r: r["rank"]).alias("vector_only_ranks"),
        results.alias("results"),
    )


def semantic_false_positives(signals: DataFrame, events: DataFrame) -> DataFrame:
    """RPT3: vector-only top hits beaten by a lower rank, and all vector-only hits of weak-only searches."""
    beaten = _with_top(signals, events).filter(
        F.col("top").isNotNull() & (F.col("top.rank") != F.col("rank")) & is_vector_only(F.col("top.retrieval_sources"))
    ).select("event_id", "query", "top.rank", "top.chunk_id", "top.source_path",
             F.lit("top_rank_but_lower_rank_won").alias("reason"))
    weak = weak_only(signals, events).select("event_id", "query", F.explode("results").alias("r")).filter(
        is_vector_only(F.col("r.retrieval_sources"))
    ).select("event_id", "query", "r.rank", "r.chunk_id", "r.source_path", F.lit("only_weak_use_query").alias("reason"))
    return beaten.unionByName(weak)


def usage_report(events: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """RPT1 totals: ``measure, n``."""
    signals = use_signals(events) if signals is None else signals

    def row(name: str, cond: Column) -> Column:
        return F.struct(F.lit(name).alias("measure"), F.coalesce(F.sum(cond.cast("long")), F.lit(0)).alias("n"))

    is_search = (F.col("tool") == "memory_search") & (F.coalesce("query", F.lit("")) != "")
    totals = events.agg(F.array(
        row("total_events", F.lit(True)),
        row("search_events", is_search),
        row("context_events", F.col("tool") == "memory_context"),
        row("unfold_events", (F.col("tool") == "memory_unfold") & F.col("target").isNotNull()),
        row("queries", is_search),
    ).alias("x")).select(F.explode("x").alias("x")).select("x.*")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")

    return (
        totals.unionByName(count(weak_only(signals, events), "only_weak_use_queries"))
        .unionByName(count(signals.filter(F.col("rank") > 1), "strong_use_from_lower_rank"))
        .unionByName(count(semantic_false_positives(signals, events), "semantic_only_false_positives"))
    )
