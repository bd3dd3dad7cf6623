"""Task board, todo lists, story queue, change gate and site tables.

FLT4-FLT6, JON8, WIN1-WIN2, AGG5-AGG9, DQ1-DQ2, STR3 (batch), CHK7, PRJ20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.text import blank_to_null, lookup, pick, slugify, strip


# --- tasks --------------------------------------------------------------------


def filter_tasks(tasks: DataFrame, query: str = "", priorities: list[str] = P.PRIORITIES) -> DataFrame:
    """FLT4: priority set and substring of title, why, outcome, source, details."""
    out = tasks.filter(F.col("priority").isin(priorities))
    if not query:
        return out
    texts = [blank_to_null(F.col(c)) for c in ("title", "why", "outcome", "source", "details")]
    return out.filter(F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(query.lower())))


def facet_filter(df: DataFrame, query: str, columns: list[str], group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """FLT5: rows with the text in any column, and their row and group counts."""
    hits = df
    if query:
        any_hit = F.lit(False)
        for c in columns:
            any_hit = any_hit | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
        hits = df.filter(any_hit)
    groups = F.countDistinct(group) if group else F.lit(0).cast("long")
    return hits, hits.agg(F.count("*").alias("rows_shown"), groups.alias("groups_shown"))


def sync_board(current: DataFrame, posted: DataFrame) -> DataFrame:
    """JON8: action per task file: write every posted task, delete known ones not posted."""
    c = current.select("task_file").filter(F.col("task_file").isNotNull()).distinct().withColumn("known", F.lit(True))
    p = posted.withColumn("task_file", ensure_task_file(F.col("task_file"), F.col("title"))).withColumn("posted", F.lit(True))
    joined = c.join(p, "task_file", "full")
    return joined.withColumn("action", F.when(F.col("posted").isNull(), "delete").otherwise("write")).drop("known", "posted")


def ensure_task_file(task_file: Column, title: Column) -> Column:
    return F.when(strip(F.coalesce(task_file, F.lit(""))) != "", task_file).otherwise(
        F.concat(F.lit("tasks/"), slugify(title, "board"), F.lit(".md")))


def board_counts(tasks: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """AGG5: ``measure, n``: count per priority (zeros kept), completed, visible."""
    def row(name: str, cond: Column) -> Column:
        return F.struct(F.lit(name).alias("measure"), F.coalesce(F.sum(cond.cast("long")), F.lit(0)).alias("n"))

    counts = tasks.agg(F.array(
        *[row(p, F.col("priority") == p) for p in P.PRIORITIES], row("completed", F.col("section") == "Done"),
    ).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    shown = (tasks if visible is None else visible).agg(F.count("*").alias("n")).select(F.lit("visible").alias("measure"), "n")
    return counts.unionByName(shown)


def board(tasks: DataFrame, by: str = "title") -> DataFrame:
    """AGG6: every section in order, empty ones too, with its tasks as ordered rows.

    Rows and a global (range-partitioned) sort, not one list per section: four
    sections would put the whole board into four tasks.
    """
    spark: SparkSession = tasks.sparkSession
    dim = spark.createDataFrame(list(enumerate(P.BOARD_SECTIONS)), "section_pos int, section string")
    rank = lookup({p: i for i, p in enumerate(P.PRIORITIES)}, F.col("priority"))
    joined = F.broadcast(dim).join(tasks, "section", "right").filter(F.col("section_pos").isNotNull())
    used = joined.select("section").distinct()
    empty = dim.join(used, "section", "left_anti")
    rows = joined.unionByName(empty, allowMissingColumns=True)
    order = ["title", "id"] if by == "title" else [rank, "title", "id"]
    return rows.orderBy("section_pos", *order)


TASK_BLOCK = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"


def task_sections(df: DataFrame, body: str = "body") -> DataFrame:
    """CHK7: add ``title, why, outcome, details`` cut from a task note body.

    Lines under an unknown ``##`` heading go to the details with their heading;
    the heading line of a known section is dropped.
    """
    text = F.regexp_replace(body, "\r\n", "\n")
    title_at = r"(?md)^#[^\S\n]+([^\n]+)$"
    title = F.when(text.rlike(title_at), strip(F.regexp_extract(text, title_at, 1))).otherwise("")
    # Only the first level-one heading line is the title.
    without = F.call_function("regexp_replace", text, F.lit(r"(?sd)\A(.*?)(?m)^#[^\S\n]+[^\n]+$"), F.lit("$1"))
    parts = F.split(without, r"(?md)(?=^##[^\S\n]+[^\n]+$)")
    heading_re = r"^##[^\S\n]+([^\n]+)"

    def tagged(p: Column) -> Column:
        heading = strip(F.regexp_extract(p, heading_re, 1))
        known = heading.isin("Why", "Outcome", "Details")
        return F.struct(
            F.when(heading == "Why", "why").when(heading == "Outcome", "outcome").otherwise("details").alias("field"),
            F.when(known, F.regexp_replace(p, r"^##[^\n]*\n?", "")).otherwise(p).alias("text"),
        )

    tagged_parts = F.transform(parts, tagged)

    def field(name: str) -> Column:
        texts = F.transform(
            F.filter(tagged_parts, lambda x: x["field"] == name), lambda x: F.regexp_replace(x["text"], r"\n\z", ""))
        return blank_to_null(strip(F.array_join(texts, "\n")))

    return df.withColumn("title", title).withColumn("why", field("why")).withColumn(
        "outcome", field("outcome")).withColumn("details", field("details"))


def parse_task_notes(notes: DataFrame) -> DataFrame:
    """DQ2 (reading): task rows of ``task_file, content``; unusable notes are dropped.

    Notes with frontmatter carry priority, status, effort and source there;
    older ones in labelled lines above the first ``##`` heading.
    """
    has = F.col("content").rlike(TASK_BLOCK)
    block = F.concat(F.lit("\n"), F.regexp_extract("content", TASK_BLOCK, 1), F.lit("\n"))
    whole = F.regexp_extract("content", f"({TASK_BLOCK})", 1)
    rows = notes.withColumn("has_block", has).withColumn("block", block).withColumn(
        "body", F.when(has, F.substring(F.col("content"), F.length(whole) + 1, F.length("content"))).otherwise(F.col("content")))
    rows = task_sections(rows)

    def key(name: str) -> Column:
        raw = strip(F.regexp_extract("block", rf"(?m)^\s*{name}\s*:([^\r\n]*)", 1))
        unquoted = F.when(raw.rlike(r"^(\".*\"|'.*')$"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.when(raw != "", unquoted)

    def label(pattern: str) -> Column:
        top = F.regexp_replace("body", r"(?s)(^|\n)## .*", "")
        found = F.regexp_extract(top, rf"(?m)^{pattern}\s*$", 1)
        return blank_to_null(strip(found))

    number = key("ai_appetite")
    section = F.when(F.col("has_block"), key("status")).otherwise(label(r"Status:\s*`(.+)`"))
    parsed = rows.select(
        "task_file", "title", "why", "outcome", "details",
        F.when(F.col("has_block"), key("priority")).otherwise(label(r"Priority:\s*`(P[0-3])`")).alias("priority"),
        section.alias("section"),
        F.when(F.col("has_block"), F.when(number.rlike(r"^\d+$"), number.cast("int")))
        .otherwise(F.least(F.lit(100), label(r"AI Appetite:\s*(\d{1,3})%").cast("int"))).alias("effort"),
        F.when(F.col("has_block"), key("source")).otherwise(label(r"Source:\s*(.+)")).alias("source"),
    )
    return parsed.filter(
        (F.col("title") != "") & F.coalesce(F.col("priority").rlike("^P[0-3]$"), F.lit(False))
        & F.coalesce(F.col("section").isin(P.BOARD_SECTIONS), F.lit(False))
    ).withColumn("id", task_id(F.col("task_file"), F.col("title"), F.col("section")))


def task_id(task_file: Column, title: Column, section: Column) -> Column:
    named = F.regexp_replace(F.regexp_replace(task_file, "^tasks/", ""), r"(?i)\.md$", "")
    return F.when(F.coalesce(task_file, F.lit("")) != "", named).otherwise(
        F.concat(F.lower(section), F.lit("-"), slugify(title, "board")))


def normalise_tasks(posted: DataFrame) -> DataFrame:
    """DQ2 (writing): trimmed task rows with ``error``, task file and suggested effort."""
    trimmed = lambda c: blank_to_null(strip(F.col(c)))
    error = (
        F.when(F.col("id").isNull() | F.col("title").isNull(), "Task payload is missing id or title")
        .when(~F.coalesce(F.col("priority").isin(P.PRIORITIES), F.lit(False)),
              F.concat(F.lit("Task "), "title", F.lit(" has an invalid priority")))
        .when(~F.coalesce(F.col("list_section").isin(P.BOARD_SECTIONS), F.lit(False)), "Invalid section name")
    )
    section = F.when(F.coalesce(F.col("section").isin(P.BOARD_SECTIONS), F.lit(False)), F.col("section")).otherwise(F.col("list_section"))
    return posted.select(
        "id", strip("title").alias("title"), "priority", section.alias("section"), "effort",
        trimmed("why").alias("why"), trimmed("outcome").alias("outcome"), trimmed("source").alias("source"),
        trimmed("details").alias("details"),
        ensure_task_file(F.col("task_file"), F.col("title")).alias("task_file"),
        lookup(P.EFFORT_BY_PRIORITY, F.col("priority")).alias("suggested_effort"),
        error.alias("error"),
    )


def render_task(tasks: DataFrame, repo: str) -> DataFrame:
    """Task note text of board rows."""
    from marginalia.operators.migration import quoted

    has = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    part = lambda name, c: F.when(has(c), F.concat(F.lit(f"\n## {name}\n\n"), strip(c)))
    content = F.concat_ws(
        "\n", F.lit("---"), F.lit("type: repo-task"), F.lit(f"repo: {repo}"),
        F.concat(F.lit("id: "), "id"), F.concat(F.lit("priority: "), "priority"), F.concat(F.lit("status: "), "section"),
        F.concat(F.lit("ai_appetite: "), F.col("effort").cast("string")),
        F.when(has("source"), F.concat(F.lit("source: "), quoted(strip("source")))),
        F.lit("---"), F.lit(""), F.concat(F.lit("# "), "title"),
        part("Why", "why"), part("Outcome", "outcome"), part("Details", "details"))
    return tasks.withColumn("content", F.concat(F.regexp_replace(content, r"\s+$", ""), F.lit("\n")))


# --- todo lists ---------------------------------------------------------------


def todo_state(events: DataFrame) -> DataFrame:
    """STR3 (batch): open and done items of every list after all its events.

    ``events`` has ``list_id, seq, kind, item_id, title`` with kinds added,
    toggled, deleted, cleared, replaced; ``replaced`` carries ``items`` and an
    addition may carry ``completed``.  Each
    step is a combined aggregate, so no list is ever held in one place: last
    reset per list, last removal per item, first addition after it, toggles
    after that.
    """
    if "items" in events.columns:
        put = events.filter("kind = 'replaced'").select(
            "list_id", "seq", F.lit("added").alias("kind"), F.posexplode("items").alias("sub", "i")
        ).select("list_id", "seq", "kind", F.col("i.id").alias("item_id"), F.col("i.title").alias("title"),
                 F.coalesce(F.col("i.completed"), F.lit(False)).alias("done_first"), (F.col("sub") + 1).alias("sub"))
    else:
        put = None
    flag = F.coalesce("completed", F.lit(False)) if "completed" in events.columns else F.lit(False)
    plain = events.select("list_id", "seq", "kind", "item_id", "title", flag.alias("done_first"), F.lit(0).alias("sub"))
    resets = events.filter(F.col("kind").isin("cleared", "replaced")).groupBy("list_id").agg(F.max("seq").alias("reset"))
    items = plain.filter(F.col("kind").isin("added", "toggled", "deleted"))
    if put is not None:
        items = items.unionByName(put)
    items = items.withColumn("title", strip("title")).filter(~((F.col("kind") == "added") & (F.coalesce("title", F.lit("")) == "")))
    # Additions made by the last reset itself come after it.
    alive = items.join(resets, "list_id", "left").filter(
        F.col("reset").isNull() | (F.col("seq") > F.col("reset")) | ((F.col("seq") == F.col("reset")) & (F.col("sub") > 0))
    ).drop("reset").withColumn("at", F.struct("seq", "sub"))
    key = ["list_id", "item_id"]
    gone = alive.filter("kind = 'deleted'").groupBy(*key).agg(F.max("at").alias("gone"))
    live = alive.join(gone, key, "left").filter(F.col("gone").isNull() | (F.col("at") > F.col("gone"))).drop("gone")
    born = live.filter("kind = 'added'").groupBy(*key).agg(
        F.min("at").alias("born"), F.min_by(F.struct("title", "done_first"), "at").alias("b"))
    flips = live.filter("kind = 'toggled'").join(born.select(*key, "born"), key).filter(
        F.col("at") > F.col("born")).groupBy(*key).agg(F.count("*").alias("flips"))
    return born.join(flips, key, "left").select(
        "list_id", "item_id", F.col("b.title").alias("title"),
        ((F.coalesce("flips", F.lit(0)) % 2 == 1) != F.col("b.done_first")).alias("completed"),
        F.col("born.seq").alias("added_seq"),
    )


def todo_stats(state: DataFrame) -> DataFrame:
    """AGG7."""
    done = F.sum(F.col("completed").cast("long"))
    return state.groupBy("list_id").agg(
        F.count("*").alias("total"), done.alias("done"), (F.count("*") - done).alias("remaining"))


# --- stories ------------------------------------------------------------------


def story_status(status: Column, passes: Column) -> Column:
    low = F.lower(strip(F.coalesce(status, F.lit(""))))
    return (
        F.when(F.coalesce(passes, F.lit(False)), "done")
        .when(low == "", "pending").when(low.isin("complete", "completed"), "done").otherwise(low)
    )


def story_priority(priority: Column) -> Column:
    """Named priorities 0 to 3, whole numbers as they are, else 99."""
    return F.coalesce(lookup(P.STORY_PRIORITY_ORDER, F.lower(priority)), priority.try_cast("int"), F.lit(99))


def _staged(stories: DataFrame) -> DataFrame:
    status = story_status(F.col("status"), F.col("passes"))
    return stories.withColumn("state", status).withColumn("p", story_priority(F.col("priority"))).withColumn(
        "s", F.coalesce(lookup(P.STORY_STATUS_ORDER, F.col("state")), F.lit(99)))


def next_story(stories: DataFrame, skip: DataFrame | None = None, story_id: str | None = None) -> DataFrame:
    """WIN1: the next story of each run; a minimum, so runs of any size combine map-side."""
    rows = _staged(stories)
    if story_id is not None:
        chosen = rows.filter(F.col("story_id") == story_id)
        pick_first = F.struct("position", "s", "p", "story_id", "title", "state")
    else:
        chosen = rows.filter(F.col("state") != "done")
        if skip is not None:
            chosen = chosen.join(skip.select("run_id", "story_id"), ["run_id", "story_id"], "left_anti")
        pick_first = F.struct("s", "p", "position", "story_id", "title", "state")
    return chosen.groupBy("run_id", "run_index").agg(F.min(pick_first).alias("x")).select("run_id", "run_index", "x.*")


def next_story_global(winners: DataFrame) -> DataFrame:
    """WIN2: the best of the per-run winners (take-ordered, one row)."""
    return winners.orderBy("s", "p", "run_index").limit(1)


def check_runs(runs: DataFrame, stories: DataFrame) -> DataFrame:
    """DQ1: issue rows ``run_id, code, position``; position is NULL for run issues."""
    position = F.lit(None).cast("long")
    untitled = runs.filter(strip(F.coalesce("title", F.lit(""))) == "").select("run_id", F.lit("empty_title").alias("code"), position.alias("position"))
    empty = runs.select("run_id").join(stories.select("run_id"), "run_id", "left_anti").select(
        "run_id", F.lit("no_stories").alias("code"), position.alias("position"))
    state = story_status(F.col("status"), F.col("passes"))
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    local = stories.select("run_id", "position", F.explode(pick(
        (blank("story_id"), "empty_story_id"),
        (blank("title"), "empty_story_title"),
        (~state.isin(list(P.STORY_STATUS_ORDER)), "invalid_status"),
    )).alias("code")).select("run_id", "code", "position")
    # A repeated id is reported on every row but its first.
    first = stories.filter(~blank("story_id")).groupBy("run_id", "story_id").agg(
        F.min("position").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = stories.join(first, ["run_id", "story_id"]).filter(F.col("position") > F.col("first")).select(
        "run_id", F.lit("duplicate_story_id").alias("code"), "position")
    return untitled.unionByName(empty).unionByName(local).unionByName(repeated)


# --- change gate --------------------------------------------------------------


def audit_changes(changes: DataFrame, skip_memory: bool = False, skip_docs: bool = False) -> DataFrame:
    """AGG9: per change the path classes, whether it is large, and the verdict."""
    flags = {k: F.col("path").rlike(p) for k, p in P.CHANGE_PATTERNS.items()}
    relevant = ~(flags["doc"] | flags["generated"] | flags["test"] | flags["markdown"]) & flags["source"]
    rows = changes.select(
        "change_id", flags["doc"].alias("doc"), flags["memory"].alias("memory"), relevant.alias("relevant"),
        (relevant & flags["structural"]).alias("structural"),
        (F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("lines"))
    total = lambda c: F.sum(F.col(c).cast("long"))
    g = rows.groupBy("change_id").agg(
        F.count("*").alias("files"), total("doc").alias("doc_files"), total("memory").alias("memory_files"),
        total("relevant").alias("relevant_files"), total("structural").alias("structural_files"),
        F.sum(F.when(F.col("relevant"), F.col("lines")).otherwise(0)).alias("relevant_lines"))
    large = (
        (F.col("relevant_files") >= P.LARGE_FILE_COUNT) | (F.col("relevant_lines") >= P.LARGE_LINE_COUNT)
        | (F.col("structural_files") > 0))
    verdict = (
        F.when(~F.col("large"), "pass")
        .when((F.col("memory_files") == 0) & ~F.lit(skip_memory), "needs-memory")
        .when((F.col("doc_files") > 0) | F.lit(skip_docs), "pass")
        .otherwise("needs-docs"))
    return g.withColumn("large", large).withColumn("verdict", verdict)


# --- site tables --------------------------------------------------------------


def published_posts(posts: DataFrame) -> DataFrame:
    """FLT6: published posts, latest first."""
    return posts.filter("published").orderBy(F.col("date").try_cast("date").desc_nulls_last(), "slug")


def post_by_slug(posts: DataFrame, slug: str) -> DataFrame:
    return posts.filter(F.col("published") & (F.col("slug") == slug))


def featured_posts(posts: DataFrame, n: int = 2) -> DataFrame:
    """The latest ``n`` published posts."""
    return published_posts(posts).limit(n)


def inventory_totals(sections: DataFrame) -> DataFrame:
    """AGG8: items and items with a link over ``title, items array<struct<label,href,note>>``."""
    linked = F.size(F.filter("items", lambda i: F.coalesce(i["href"], F.lit("")) != ""))
    return sections.agg(
        F.coalesce(F.sum(F.size("items")), F.lit(0)).cast("long").alias("items"),
        F.coalesce(F.sum(linked), F.lit(0)).cast("long").alias("linked_items"))


TRACK = (
    "struct<name:string,artists:array<struct<name:string>>,"
    "album:struct<images:array<struct<url:string>>>,external_urls:struct<spotify:string>>"
)
PLAYBACK = f"is_playing boolean, item {TRACK}, items array<struct<track:{TRACK}>>"


def normalize_playback(df: DataFrame, payload: str = "payload") -> DataFrame:
    """PRJ20: current or recently played payload text to a now-playing row."""
    p = F.from_json(payload, PLAYBACK)
    out = df.withColumn("p", p)
    recent = F.col("p.items").isNotNull()
    track = F.when(recent, F.try_element_at(F.col("p.items"), F.lit(1))["track"]).otherwise(F.col("p.item"))
    out = out.withColumn("t", track)
    names = F.filter(F.transform("t.artists", lambda a: strip(a["name"])), lambda n: n != "")
    artist = F.array_join(names, ", ")
    art = F.try_element_at(F.filter(F.transform("t.album.images", lambda i: strip(i["url"])), lambda u: u != ""), F.lit(1))
    live = (F.coalesce("t.name", F.lit("")) != "") & (F.coalesce(artist, F.lit("")) != "") & art.isNotNull()
    url = F.coalesce(blank_to_null(strip("t.external_urls.spotify")), F.lit(P.DEFAULT_SONG_URL))
    return out.select(
        *df.columns,
        F.when(live & ~recent, F.coalesce("p.is_playing", F.lit(False))).otherwise(F.lit(False)).alias("is_playing"),
        F.when(live, F.col("t.name")).alias("track"),
        F.when(live, artist).alias("artist"),
        F.when(live, art).alias("album_art"),
        F.when(live, url).alias("song_url"),
        F.when(live, "track").otherwise("idle").alias("state"),
    )
