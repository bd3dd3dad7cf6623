"""Note registry, issues and diagnostics (AGG1-AGG3, JON4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import strings
from marginalia.operators.links import link_lists
from marginalia.operators.notes import note_flags


def duplicate_ids(notes: DataFrame) -> DataFrame:
    """Note ids used more than once, with how often."""
    return notes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def note_issues(notes: DataFrame, unresolved: DataFrame) -> DataFrame:
    """AGG2: add ``validation_issues`` and ``validation_status``.

    ``unresolved`` has a column ``from_id``.
    """
    broken = unresolved.select(F.col("from_id").alias("id")).distinct().withColumn("broken", F.lit(True))
    issues = F.concat(
        note_flags(), F.when(F.col("broken"), strings(["unresolved_links"])).otherwise(strings([]))
    )
    return (
        notes.join(broken, "id", "left")
        .withColumn("validation_issues", issues)
        .withColumn("validation_status", F.when(F.size("validation_issues") > 0, "warning").otherwise("ok"))
        .drop("broken")
    )


def build_registry(
    notes: DataFrame, chunks: DataFrame, links: DataFrame, unresolved: DataFrame, strict: bool = False,
) -> DataFrame:
    """AGG1: one row per note with chunk list, link counts and issues.

    Chunk ids are a list because a note's chunks are bounded by the note; link
    sources are counted here and kept as rows in the link tables.  With
    ``strict`` a repeated id raises; otherwise ``duplicate_ids`` reports it.
    """
    out, inbound = link_lists(links, notes)
    n_out = out.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_outbound"))
    n_in = inbound.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_inbound"))
    lists = chunks.groupBy(F.col("note_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("c"),
        F.sum(F.length("text")).alias("text_length"),
    )
    reg = note_issues(notes, unresolved).join(n_out, "id", "left").join(n_in, "id", "left").join(lists, "id", "left")
    reg = (
        reg.withColumn("chunk_ids", F.coalesce(F.transform("c", lambda x: x["chunk_id"]), strings([])))
        .withColumn("n_outbound", F.coalesce("n_outbound", F.lit(0)))
        .withColumn("n_inbound", F.coalesce("n_inbound", F.lit(0)))
        .withColumn("text_length", F.coalesce("text_length", F.lit(0)))
        .drop("c")
    )
    if strict:
        repeated = duplicate_ids(notes).select("id", F.lit(True).alias("repeated"))
        message = F.concat(F.lit("registry.duplicate_id: Duplicate memory note id '"), F.col("id"), F.lit("'"))
        reg = reg.join(repeated, "id", "left").withColumn(
            "id", F.when(F.col("repeated"), F.raise_error(message)).otherwise(F.col("id"))
        ).drop("repeated")
    return reg


def _has(issue: str) -> Column:
    return F.array_contains("validation_issues", issue)


def diagnostics(reg: DataFrame, unresolved: DataFrame) -> DataFrame:
    """AGG3 in long form: ``section, key, detail, n``.

    Counted facets and listed notes come from one pass over the registry.
    """
    def facet(section: str, key: Column, n: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.alias("key"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("of"), n.cast("long").alias("n"))

    kept_type = F.coalesce("legacy_type", F.lit("")) != ""
    kept_status = F.coalesce("legacy_status", F.lit("")) != ""
    arrow = lambda a, b: F.concat(F.col(a), F.lit(" -> "), F.col(b))
    # A listed note is a group of its own.
    row = lambda cond, section, detail: F.when(cond, F.struct(
        F.lit(section).alias("section"), F.col("path").alias("key"), detail.alias("detail"), F.col("id").alias("of"), F.lit(1).cast("long").alias("n")))
    found = reg.select(F.explode(F.array_compact(F.array(
        facet("notes", F.lit("all"), F.lit(1)),
        facet("chunks", F.lit("all"), F.size("chunk_ids")),
        facet("notes_by_type", F.col("type"), F.lit(1)),
        facet("notes_by_status", F.col("status"), F.lit(1)),
        row(_has("missing_frontmatter_id"), "synthetic_ids", F.lit("")),
        row(kept_type & (F.lower(F.trim("legacy_type")) != F.col("type")), "legacy_type_normalizations",
            arrow("legacy_type", "type")),
        row(kept_status & _has("legacy_status_normalized"), "status_normalizations", arrow("legacy_status", "status")),
        row(_has("missing_frontmatter_id"), "validation_warnings",
            F.concat(F.col("path"), F.lit(": missing frontmatter id; generated "), F.col("id"))),
        row(_has("missing_summary"), "validation_warnings", F.concat(F.col("path"), F.lit(": missing summary"))),
    ))).alias("x")).groupBy("x.section", "x.key", "x.detail", "x.of").agg(F.sum("x.n").alias("n")).select("section", "key", "detail", "n")
    missing = unresolved.select(
        F.lit("unresolved_links").alias("section"), F.col("from_id").alias("key"),
        F.col("target").alias("detail"), F.lit(1).cast("long").alias("n"),
    ).distinct()
    return found.unionByName(missing)


def diff_manifest(previous: DataFrame, current: DataFrame) -> DataFrame:
    """JON4: state of every path: skipped, updated, or gone.

    ``previous`` has ``path, mtime_ms, reusable``; ``current`` has ``path, mtime_ms``.
    """
    p = previous.select("path", F.col("mtime_ms").alias("old_mtime"), "reusable", F.lit(True).alias("was"))
    c = current.select("path", F.col("mtime_ms").alias("new_mtime"), F.lit(True).alias("is"))
    same = F.coalesce(F.col("was") & (F.col("old_mtime") == F.col("new_mtime")) & F.col("reusable"), F.lit(False))
    return p.join(c, "path", "full").select(
        "path",
        F.when(F.col("is").isNull(), "gone").when(same, "skipped").otherwise("updated").alias("state"),
        "old_mtime", "new_mtime",
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts; ``deleted`` is how much smaller the file set became, at least 0."""
    n = lambda s: F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0))
    previous = F.coalesce(F.sum(F.col("old_mtime").isNotNull().cast("long")), F.lit(0))
    files = n("skipped") + n("updated")
    return diff.agg(
        n("skipped").alias("skipped"), n("updated").alias("updated"), files.alias("files"),
        F.greatest(F.lit(0).cast("long"), previous - files).alias("deleted"),
    )
