"""Deterministic views of the driver tables in the engine's own shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.joins import spread
from marginalia.functions.text import strings, tokenize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycle(values: list[str], number: Column) -> Column:
    """``values[number % len(values)]``."""
    return F.element_at(strings(values), (number % len(values) + 1).cast("int"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry-shaped notes, one per document, still carrying the text as ``body``."""
    docs = spread(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    did = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("doc-"), did).alias("id"),
        cycle(P.NOTE_TYPES, did).alias("type"),
        cycle(P.NOTE_STATUSES, did).alias("status"),
        F.col("source").alias("repo_slug"),
        F.concat_ws("/", F.lit("vault"), "source", "lang", F.concat(did, F.lit(".md"))).alias("path"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.substring_index("text", "\n", 1).alias("summary"),
        F.array("lang").alias("tags"),
        F.array("source").alias("keywords"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (did % 365).cast("int")),
                      "yyyy-MM-dd").alias("created"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (did % 365).cast("int")),
                      "yyyy-MM-dd").alias("updated"),
        F.when(F.col("quality") == 0, "warning").otherwise("ok").alias("validation_status"),
        F.col("n_chars").cast("double").alias("mtime_ms"),
        F.col("text").alias("body"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document; the heading is the note title."""
    n = notes(spark, sf_dir)
    return n.select(
        F.concat(
            F.lit("chunk:"), "id", F.lit(":0000:"), F.substring(F.sha2("body", 256), 1, 8)
        ).alias("chunk_id"),
        F.col("id").alias("note_id"),
        F.concat("path", F.lit(" § "), "title").alias("source_path"),
        F.col("title").alias("heading"),
        F.lit(0).alias("heading_level"),
        F.col("body").alias("text"),
        "summary",
        "type",
        "status",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval corpus straight from the note rows.

    Notes and chunks come from the same rows here, so the left join of the
    general builder is not needed.
    """
    n = notes(spark, sf_dir)
    from marginalia.operators.corpus import normal_status, normal_type

    return n.select(
        F.concat(
            F.lit("chunk:"), "id", F.lit(":0000:"), F.substring(F.sha2("body", 256), 1, 8)
        ).alias("chunk_id"),
        F.col("id").alias("note_id"),
        F.col("path").alias("source_file"),
        F.concat("path", F.lit(" § "), "title").alias("source_path"),
        F.col("title").alias("heading"),
        normal_type(F.col("type")).alias("type"),
        normal_status(F.col("status"), normal_type(F.col("type"))).alias("status"),
        "repo_slug", "tags", "keywords",
        F.col("summary"),
        F.col("summary").alias("chunk_summary"),
        "title",
        F.col("title").alias("note_title"),
        F.col("summary").alias("note_summary"),
        F.col("body").alias("text"),
        "updated", "validation_status", "mtime_ms",
        F.array().cast("array<string>").alias("validation_issues"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query table: the search tokens of each benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.concat_ws(" ", tokenize("text")).alias("query"),
    )


SOURCE_SETS = [["lexical"], ["lexical", "vector"], ["vector"]]
TOOL_BY_EVENT = {"view": "search", "purchase": "unfold", "click": "context"}


def retrieval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views become searches with three results, purchases unfolds, clicks context calls."""
    return to_retrieval_events(table(spark, sf_dir, "events"))


def to_retrieval_events(e: DataFrame) -> DataFrame:
    e = e.filter(F.col("event_type").isin("view", "purchase", "click"))
    k = F.get_json_object("props", "$.k").cast("long")
    first = F.col("event_id") % 3

    def sources(rank: int) -> Column:
        shift = (first + rank) % 3
        return (
            F.when(shift == 0, strings(SOURCE_SETS[0]))
            .when(shift == 1, strings(SOURCE_SETS[1]))
            .otherwise(strings(SOURCE_SETS[2]))
        )

    def result(rank: int, step: int) -> Column:
        key = ((k + step) % 100).cast("string")
        return F.struct(
            F.lit(rank).cast("long").alias("rank"),
            F.concat(F.lit("chunk-"), key).alias("chunk_id"),
            F.concat(F.lit("vault/"), key, F.lit(".md")).alias("source_path"),
            sources(rank - 1).alias("retrieval_sources"),
        )

    kind = F.col("event_type")
    return e.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "view", "memory_search")
        .when(kind == "purchase", "memory_unfold")
        .otherwise("memory_context").alias("tool"),
        F.when(kind == "view", F.concat(F.lit("query "), k)).alias("query"),
        F.when(kind == "view", F.array(result(1, 0), result(2, 7), result(3, 13))).alias("results"),
        F.when(
            kind == "purchase",
            F.struct(
                F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("chunk-"), k)).alias("chunk_id"),
                F.concat(F.lit("vault/"), k, F.lit(".md")).alias("source_path"),
            ),
        ).alias("target"),
    )


def todo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_todo_events(table(spark, sf_dir, "events"))


def to_todo_events(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return (
        e.withColumn(
            "kind",
            F.when(kind == "signup", "added")
            .when(kind == "click", "toggled")
            .when(kind == "error", "deleted")
            .when((kind == "purchase") & (F.col("value") > 300), "cleared"),
        )
        .filter(F.col("kind").isNotNull())
        .select(
            F.col("user_id").cast("string").alias("list_id"),
            F.col("event_id").alias("seq"),
            "ts",
            "kind",
            F.get_json_object("props", "$.k").alias("item_id"),
            F.concat(F.lit(" item "), F.get_json_object("props", "$.k"), F.lit(" ")).alias("title"),
        )
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board tasks from orders."""
    o = table(spark, sf_dir, "orders")
    prio = F.least(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(3))
    key = F.col("o_orderkey")
    section = (
        F.when(key % 4 == 3, "Ready")
        .when(F.col("o_orderstatus") == "O", "Backlog")
        .when(F.col("o_orderstatus") == "P", "In Progress")
        .otherwise("Done")
    )
    return o.select(
        F.concat(F.lit("task-"), key).alias("id"),
        F.concat(F.lit("Order "), key, F.lit(" for "), "o_custkey").alias("title"),
        F.concat(F.lit("P"), prio).alias("priority"),
        section.alias("section"),
        F.when(key % 3 == 0, (key % 101).cast("int")).alias("effort"),
        F.when(key % 5 == 0, F.concat(F.lit("Because status "), "o_orderstatus")).alias("why"),
        F.when(key % 7 == 0, F.concat(F.lit("Ship on "), F.date_format("o_orderdate", "yyyy-MM-dd")))
        .alias("outcome"),
        F.when(key % 11 == 0, F.col("o_orderpriority")).alias("source"),
        F.lit(None).cast("string").alias("details"),
        F.concat(F.lit("tasks/task-"), key, F.lit(".md")).alias("task_file"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories from orders; the customer is the run."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("run-"), "o_custkey").alias("run_id"),
        F.col("o_custkey").alias("run_index"),
        key.alias("position"),
        F.concat(F.lit("S-"), F.col("o_orderkey") % 50).alias("story_id"),
        F.when(key % 17 == 0, "  ").otherwise(F.concat(F.lit("Story "), key)).alias("title"),
        F.lower(F.element_at(strings(["CRITICAL", "High", "medium", "low", "someday"]),
                             F.substring("o_orderpriority", 1, 1).cast("int"))).alias("priority"),
        F.when(key % 19 == 0, "weird")
        .when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderstatus") == "P", " In_Progress ")
        .when(key % 2 == 0, "completed")
        .otherwise("blocked").alias("status"),
        (key % 13 == 0).alias("passes"),
    )


CHANGE_PATHS = [
    "packages/ui/src/part-{}.tsx",
    "docs/guide-{}.md",
    "vault/00 Repositories/site/note-{}.md",
    "apps/host/tests/part-{}.test.ts",
    "packages/ui-{}/package.json",
    "packages/ui/dist/part-{}.js",
]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files from line items; the order is the change."""
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("string")
    kind = F.col("l_partkey") % 6
    path = F.coalesce(*[
        F.when(kind == i, F.concat(F.lit(p.split("{}")[0]), part, F.lit(p.split("{}")[1])))
        for i, p in enumerate(CHANGE_PATHS)
    ])
    return li.select(
        F.col("l_orderkey").alias("change_id"),
        path.alias("path"),
        F.col("l_quantity").cast("long").alias("additions"),
        F.col("l_linenumber").cast("long").alias("deletions"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries from parts."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("part-"), key).alias("id"),
        F.col("p_name").alias("display_name"),
        F.concat_ws(" ", F.lit("Handles"), "p_type", F.lit("of size"), "p_size").alias("description"),
        F.array("p_type").alias("tags"),
        F.split("p_name", " ").alias("triggers"),
        F.when(key % 5 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
        .alias("anti_triggers"),
        cycle(P.CATALOG_GROUPS, key).alias("group"),
        cycle(P.CATALOG_TIERS, key).alias("tier"),
    )


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed link targets: note i to i*7+3 modulo n, every 13th to a missing id."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg(F.max("doc_id")).first()[0] + 1
    did = F.col("doc_id")
    return docs.select(
        F.concat(F.lit("doc-"), did).alias("from_id"),
        cycle(P.LINK_GROUPS, did).alias("link_group"),
        F.when(did % 13 == 0, F.concat(F.lit("missing-"), did % 10))
        .otherwise(F.concat(F.lit("doc-"), (did * 7 + 3) % n)).alias("target"),
    )


def driver_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors in whole millionths from the embedding table."""
    e = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return e.select(
        "vec_id",
        F.transform(values, lambda x: F.round(x / norm * 1e6).cast("long")).alias("values"),
        "label",
    )


def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown file with frontmatter per conversation, a section per turn."""
    c = table(spark, sf_dir, "conversations")
    # A conversation is a handful of turns; the array holds one document's lines.
    turns = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    cid = F.col("conv_id")
    body = F.concat(
        F.lit("# conv "), cid, F.lit("\n\n"),
        F.array_join(
            F.transform(
                "turns",
                lambda t: F.concat(
                    F.lit("## "), t["role"], F.lit(" "), t["turn"], F.lit("\n\n"), t["text"], F.lit("\n")
                ),
            ),
            "\n",
        ),
    )
    front = F.concat(
        F.lit("---\ntype: "), cycle(["repo-session", "task", "Repo-Spec", "unknown"], cid),
        F.lit("\nstatus: "), cycle(["In Progress", "draft", "done"], cid),
        F.when(cid % 5 != 0, F.concat(F.lit("\nid: conv-"), cid)).otherwise(F.lit("")),
        F.lit("\nrepo: talk"),
        F.lit("\ntags: [chat, 'c"), cid % 3, F.lit("']"),
        F.lit("\ncreated: "),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (cid % 300).cast("int")), "yyyy-MM-dd"),
        F.lit("\n---\n"),
    )
    folder = cycle(["03 Sessions", "04 Tasks", "specs", "misc"], cid)
    return spread(turns).select(
        F.concat(folder, F.lit("/conv-"), cid, F.lit(".md")).alias("path"),
        F.concat(front, body).alias("content"),
        (cid * 1000 + 1704067200000).cast("double").alias("mtime_ms"),
    )
