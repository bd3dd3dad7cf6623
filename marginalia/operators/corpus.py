"""Retrieval corpus assembly: chunk, note and vector rows into one search view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.text import blank_to_null, lookup

# Search-side status aliases are the same words; types unknown to the alias
# table are kept as they are.
SEARCH_TYPE_ALIASES = {k: v for k, v in P.TYPE_ALIASES.items()}


def normal_type(raw: Column) -> Column:
    """Search-side type: alias or the raw value; missing becomes ``reference``."""
    known = lookup(SEARCH_TYPE_ALIASES, raw)
    return F.coalesce(known, blank_to_null(raw), F.lit("reference"))


def normal_status(raw: Column, note_type: Column) -> Column:
    """Search-side status: alias or raw; missing or active depends on the type."""
    value = F.coalesce(lookup(P.STATUS_ALIASES, F.lower(raw)), blank_to_null(raw))
    is_record = note_type == "architecture-record"
    return (
        F.when(value.isNull() & is_record, "accepted")
        .when(value.isNull(), "active")
        .when((value == "active") & is_record, "accepted")
        .otherwise(value)
    )


def normalize_for_search(df: DataFrame, type_col: str = "type", status_col: str = "status") -> DataFrame:
    """PRJ7: add ``search_type`` and ``search_status``."""
    t = normal_type(F.col(type_col))
    return df.withColumn("search_type", t).withColumn(
        "search_status", normal_status(F.col(status_col), t)
    )


def source_file_of(source_path: Column) -> Column:
    return F.substring_index(source_path, " § ", 1)


def from_legacy_chunks(df: DataFrame) -> DataFrame:
    """SRC3: a flat chunk table as a retrieval corpus without links and vectors."""
    t = normal_type(F.col("note_type"))
    return df.select(
        F.col("id").alias("chunk_id"),
        F.coalesce("note_id", "id").alias("note_id"),
        F.coalesce("source_file", source_file_of(F.col("source_path"))).alias("source_file"),
        "source_path",
        "heading",
        t.alias("type"),
        normal_status(F.col("status"), t).alias("status"),
        "repo_slug",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        "summary",
        F.col("summary").alias("chunk_summary"),
        F.col("heading").alias("title"),
        F.lit(None).cast("string").alias("note_title"),
        F.lit(None).cast("string").alias("note_summary"),
        "text",
        F.lit(None).cast("string").alias("updated"),
        F.lit("ok").alias("validation_status"),
        F.coalesce("mtime_ms", F.lit(0.0)).alias("mtime_ms"),
        F.array().cast("array<string>").alias("validation_issues"),
    )


def build_corpus(chunks: DataFrame, notes: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """SRC4 / JON1: chunk left-joined to its note and, when given, its vector.

    Of notes that share an id the one of the largest path counts, so that a chunk
    stays one row.

    No broadcast hint: the note side grows with the corpus, so the planner
    decides from its real size.
    """
    fields = [c for c in notes.columns if c != "id"]
    single = notes.groupBy("id").agg(F.max_by(F.struct(fields), F.struct(F.col("path").isNotNull(), "path")).alias("n")).select("id", "n.*")
    n = single.select(
        F.col("id").alias("note_id"),
        F.col("type").alias("note_type"),
        F.col("status").alias("note_status"),
        "repo_slug", "tags", "keywords",
        F.col("title").alias("note_title"),
        F.col("summary").alias("note_summary"),
        "updated", "validation_status", "mtime_ms", "validation_issues",
    )
    empty = F.array().cast("array<string>")
    t = normal_type(F.coalesce("type", "note_type"))
    c = chunks.select("chunk_id", "note_id", "source_path", "heading", "text", "summary", "type", "status")
    out = c.join(n, "note_id", "left").select(
        "chunk_id",
        "note_id",
        source_file_of(F.col("source_path")).alias("source_file"),
        "source_path",
        "heading",
        t.alias("type"),
        normal_status(F.coalesce("status", "note_status"), t).alias("status"),
        "repo_slug",
        F.coalesce("tags", empty).alias("tags"),
        F.coalesce("keywords", empty).alias("keywords"),
        F.coalesce(blank_to_null(F.col("summary")), blank_to_null(F.col("note_summary"))).alias("summary"),
        F.col("summary").alias("chunk_summary"),
        F.coalesce("note_title", "heading").alias("title"),
        "note_title",
        "note_summary",
        "text",
        "updated",
        F.coalesce("validation_status", F.lit("ok")).alias("validation_status"),
        F.coalesce("mtime_ms", F.lit(0.0)).alias("mtime_ms"),
        F.coalesce("validation_issues", empty).alias("validation_issues"),
    )
    if vectors is not None:
        out = out.join(vectors.select("chunk_id", "values"), "chunk_id", "left")
    return out


def corpus_stats(corpus: DataFrame, vector_status: str = "missing") -> DataFrame:
    """AGG4: chunk count and counts by type and status, long form; one pass over the corpus."""
    def facet(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), key.alias("key"), F.lit(1).cast("long").alias("n"))

    spark = corpus.sparkSession
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    each = corpus.select(F.inline(F.array(facet("chunks", F.lit("all")), facet("type", known("type")), facet("status", known("status")))))
    # An empty corpus has its total, too.
    none = spark.range(1).select(F.lit("chunks").alias("facet"), F.lit("all").alias("key"), F.lit(0).cast("long").alias("n"))
    state = spark.range(1).select(
        F.lit("vector_status").alias("facet"), F.lit(vector_status).alias("key"), F.lit(1).cast("long").alias("n"))
    return each.unionByName(none).groupBy("facet", "key").agg(F.sum("n").alias("n")).unionByName(state)
