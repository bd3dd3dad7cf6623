"""Corpus health: cleanup buckets, verification, write checks (GOV1-GOV13).

Reports are rows, never one list per group: a group of equal notes may hold a
third of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.text import blank_to_null, days_between, lookup, slugify, strip
from marginalia.operators.notes import registry_pair_ok


def duplicate_notes(reg: DataFrame) -> DataFrame:
    """GOV1: notes that share title and summary (case ignored), one row each.

    Group sizes are counted with map-side combine; the rows are then joined to
    the groups of two and more, a join whose skew adaptive execution splits.
    """
    key = F.sha2(F.concat(F.lower("title"), F.lit("|"), F.lower(F.coalesce("summary", F.lit("")))), 256)
    keyed = reg.select("id", "path", "title", key.alias("group_key"))
    groups = keyed.groupBy("group_key").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return keyed.join(groups, "group_key").select("group_key", "group_size", "path", F.col("id").alias("note_id"))


def _age(as_of: str) -> Column:
    return F.coalesce(days_between("updated", as_of), days_between("created", as_of))


def _rules(as_of: str) -> dict[str, tuple[Column, Column]]:
    """Buckets one registry row can decide by itself: condition and days."""
    t, s, age = F.col("type"), F.col("status"), _age(as_of)
    return {
        "stale_todos": ((t == "todo") & (s == "active") & (age > P.STALE_TODO_DAYS), age),
        "sessions_to_summarise": ((t == "session") & (s == "active") & (age > P.SESSION_SUMMARY_DAYS), age),
        "orphan_notes": (
            (t != "repo-home") & (s == "active") & (age > P.ORPHAN_DAYS)
            & (F.col("n_outbound") == 0) & (F.col("n_inbound") == 0),
            F.lit(0),
        ),
        "archivable_specs": ((t == "spec") & (s == "done") & (age > P.ARCHIVE_SPEC_DAYS), age),
        "superseded_decisions": ((t == "architecture-record") & (s == "superseded"), F.lit(0)),
    }


def _bucket(reg: DataFrame, name: str, as_of: str) -> DataFrame:
    cond, days = _rules(as_of)[name]
    return reg.filter(cond).select(F.col("id").alias("note_id"), "path", "type", days.cast("long").alias("days"))


def stale_todos(reg: DataFrame, as_of: str) -> DataFrame:
    """GOV2."""
    return _bucket(reg, "stale_todos", as_of)


def sessions_to_summarise(reg: DataFrame, as_of: str) -> DataFrame:
    """GOV3."""
    return _bucket(reg, "sessions_to_summarise", as_of)


def orphan_notes(reg: DataFrame, as_of: str) -> DataFrame:
    """GOV4."""
    return _bucket(reg, "orphan_notes", as_of)


def archivable_specs(reg: DataFrame, as_of: str) -> DataFrame:
    """GOV7."""
    return _bucket(reg, "archivable_specs", as_of)


def superseded_decisions(reg: DataFrame) -> DataFrame:
    """GOV7."""
    return _bucket(reg, "superseded_decisions", "1970-01-01")


def note_sizes(chunks: DataFrame) -> DataFrame:
    """Estimated tokens of each note's chunk texts joined by a blank line.

    The joined length is a sum, so no text is concatenated or shuffled.
    """
    length = F.sum(F.length("text")) + 2 * (F.count("*") - 1)
    return chunks.groupBy("note_id").agg(length.alias("n")).select(
        "note_id", F.when(F.col("n") == 0, 0).otherwise(F.ceil(F.col("n") / 4)).cast("long").alias("estimated_tokens")
    )


def oversized_notes(reg: DataFrame, chunks: DataFrame) -> DataFrame:
    """GOV5."""
    big = note_sizes(chunks).filter(F.col("estimated_tokens") > P.OVERSIZED_TOKENS)
    return reg.select(F.col("id").alias("note_id"), "path").join(big, "note_id")


def invalid_frontmatter(reg: DataFrame) -> DataFrame:
    """GOV6: distinct ``(path, reason)``: issues, and the warnings made of them."""
    has = lambda i: F.array_contains("validation_issues", i)
    reasons = F.concat(
        F.filter("validation_issues", lambda i: i != "unresolved_links"),
        F.array_compact(F.array(
            F.when(has("missing_frontmatter_id"),
                   F.concat(F.col("path"), F.lit(": missing frontmatter id; generated "), F.col("id"))),
            F.when(has("missing_summary"), F.concat(F.col("path"), F.lit(": missing summary"))),
        )),
    )
    rows = reg.select("path", F.explode(F.array_distinct(reasons)).alias("reason"))
    # A warning names its path up to the first colon.
    return rows.select(
        F.when(F.contains("reason", F.lit(": missing ")), F.substring_index("reason", ":", 1)).otherwise(F.col("path")).alias("path"),
        "reason",
    ).distinct()


def stale_index_files(listing: DataFrame, allowed: list[str] = P.INDEX_TABLES) -> DataFrame:
    """GOV8: names in the index area outside the allowed set."""
    return listing.filter(~F.col("name").isin(allowed)).select("name")


REPORT = ["bucket", "note_id", "path", "detail", "n"]


def cleanup_report(reg: DataFrame, chunks: DataFrame, as_of: str, listing: DataFrame | None = None) -> DataFrame:
    """GOV9: every bucket in long form ``bucket, note_id, path, detail, n``.

    The five row-local buckets come from one pass over the registry.
    """
    rules = _rules(as_of)
    local = reg.select(
        F.col("id").alias("note_id"), "path",
        F.explode(F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(name).alias("bucket"), days.cast("long").alias("n")))
            for name, (cond, days) in rules.items()
        ]))).alias("x"),
    ).select("x.bucket", "note_id", "path", F.lit("").alias("detail"), "x.n")
    dup = duplicate_notes(reg).select(
        F.lit("duplicate_notes").alias("bucket"), "note_id", "path",
        F.substring("group_key", 1, 16).alias("detail"), F.col("group_size").alias("n"))
    big = oversized_notes(reg, chunks).select(
        F.lit("oversized_notes").alias("bucket"), "note_id", "path", F.lit("").alias("detail"),
        F.col("estimated_tokens").alias("n"))
    bad = invalid_frontmatter(reg).select(
        F.lit("invalid_frontmatter").alias("bucket"), F.lit("").alias("note_id"), "path",
        F.col("reason").alias("detail"), F.lit(0).cast("long").alias("n"))
    out = local.unionByName(dup).unionByName(big).unionByName(bad)
    if listing is not None:
        out = out.unionByName(stale_index_files(listing).select(
            F.lit("generated_files_to_delete").alias("bucket"), F.lit("").alias("note_id"),
            F.col("name").alias("path"), F.lit("").alias("detail"), F.lit(0).cast("long").alias("n")))
    return out


def verify_index(reg: DataFrame) -> DataFrame:
    """GOV10: violation rows ``severity, code, subject, n``."""
    path = F.col("path")
    row = lambda cond, code, subject: F.when(
        cond, F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"), subject.alias("subject")))
    local = reg.select(F.explode(F.array_compact(F.array(
        row(~registry_pair_ok(F.col("type"), F.col("status")), "invalid_status_for_type",
            F.concat_ws(" ", "type", F.lit("->"), "status", path)),
        row(~path.startswith("vault/"), "outside_vault", path),
        row(path.rlike(r"/(90 Templates|91 Scripts)/"), "template_indexed", path),
    ))).alias("x")).select("x.*", F.lit(1).cast("long").alias("n"))
    repeated = reg.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select(
        F.lit("error").alias("severity"), F.lit("duplicate_id").alias("code"), F.col("id").alias("subject"),
        (F.col("c") - 1).alias("n"))
    has = lambda i: F.coalesce(F.sum(F.array_contains("validation_issues", i).cast("long")), F.lit(0))
    totals = reg.agg(has("unresolved_links").alias("u"), has("missing_frontmatter_id").alias("s")).select(F.explode(F.array(
        F.struct(F.lit("error").alias("severity"), F.lit("unresolved_links").alias("code"), F.col("u").alias("n")),
        F.struct(F.lit("warning").alias("severity"), F.lit("synthetic_ids").alias("code"), F.col("s").alias("n")),
    )).alias("x")).filter("x.n > 0").select("x.severity", "x.code", F.lit("").alias("subject"), "x.n")
    return local.unionByName(repeated).unionByName(totals)


def verify_summary(reg: DataFrame) -> DataFrame:
    has = lambda i: F.coalesce(F.sum(F.array_contains("validation_issues", i).cast("long")), F.lit(0))
    return reg.agg(
        F.count("*").alias("notes"),
        F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).cast("long").alias("chunks"),
        has("unresolved_links").alias("unresolved_links"),
        has("missing_frontmatter_id").alias("synthetic_ids"),
    )


def classify_issue(reason: Column) -> tuple[Column, Column]:
    """Category of a frontmatter reason and whether it blocks."""
    text = strip(F.regexp_replace(reason, r"\s+", " "))
    category = (
        F.when(reason == "status_review_required", "status_review_required")
        .when((reason == "missing_frontmatter_id") | F.contains(text, F.lit("missing frontmatter id")), "missing_frontmatter_id")
        .when(F.contains(text, F.lit("missing summary")), "missing_summary")
        .otherwise("unknown")
    )
    return category, category.isin("status_review_required", "unknown")


def doctor(
    reg: DataFrame, chunks: DataFrame, as_of: str, plans: DataFrame | None = None, listing: DataFrame | None = None,
) -> DataFrame:
    """GOV11: check rows ``check, code, n`` plus one ``passed`` row (n = 1 or 0).

    ``plans`` are migration plans; their blocking issues count as frontmatter
    issues.
    """
    violations = verify_index(reg).groupBy("severity", "code").agg(F.sum("n").alias("n"))
    checks = violations.select(
        F.when(F.col("severity") == "warning", "warnings")
        .when(F.col("code") == "unresolved_links", "link_check").otherwise("schema_check").alias("check"),
        "code", "n")
    reasons = invalid_frontmatter(reg).select("reason")
    if plans is not None:
        reasons = reasons.unionByName(plans.select(F.explode("blocking_issues").alias("reason")))
    category, blocking = classify_issue(F.col("reason"))
    front = reasons.select(
        F.when(blocking, "frontmatter_blocking").otherwise("frontmatter_advisory").alias("check"), category.alias("code")
    ).groupBy("check", "code").agg(F.count("*").alias("n"))
    clean = cleanup_report(reg, chunks, as_of, listing).groupBy("bucket").agg(F.count("*").alias("n")).select(
        F.lit("cleanup_dry_run").alias("check"), F.col("bucket").alias("code"), "n")
    rows = checks.unionByName(front).unionByName(clean)
    fails = F.col("check").isin("schema_check", "link_check", "frontmatter_blocking") | (
        F.col("code") == "generated_files_to_delete")
    passed = rows.agg((F.coalesce(F.sum(fails.cast("long")), F.lit(0)) == 0).cast("long").alias("n")).select(
        F.lit("passed").alias("check"), F.lit("").alias("code"), "n")
    return rows.unionByName(passed)


# --- GOV12: write duplicates --------------------------------------------------


def find_duplicates(proposals: DataFrame, reg: DataFrame) -> DataFrame:
    """GOV12: per proposal the number of exact and of heuristic matches.

    Counted by key on the registry side first, so a title that a third of both
    sides share costs one row per key and never all pairs.
    """
    live = reg.filter(~F.col("status").isin(P.EXCLUDED_STATUSES)).select(
        "type", F.lower("title").alias("t"), F.lower(F.coalesce("summary", F.lit(""))).alias("s"))
    both = live.groupBy("type", "t", "s").agg(F.count("*").alias("n_both"))
    by_title = both.groupBy("type", "t").agg(F.sum("n_both").alias("n_title"))
    by_summary = both.filter("s <> ''").groupBy("type", "s").agg(F.sum("n_both").alias("n_summary"))
    p = proposals.withColumn("t", F.lower("title")).withColumn("s", F.lower(F.coalesce("summary", F.lit(""))))
    joined = (
        p.join(by_title, ["type", "t"], "left").join(by_summary, ["type", "s"], "left")
        .join(both.filter("s <> ''"), ["type", "t", "s"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        *proposals.columns,
        zero("n_both").alias("n_exact"),
        (zero("n_title") + zero("n_summary") - 2 * zero("n_both")).alias("n_heuristic"),
    ).withColumn(
        "verdict", F.when(F.col("n_exact") > 0, "reject").when(F.col("n_heuristic") > 0, "review").otherwise("accept")
    )


def duplicate_candidates(proposals: DataFrame, reg: DataFrame) -> DataFrame:
    """GOV12 listing: registry notes by the proposal key they match.

    Keys of the proposals are made distinct first: a note is listed at most
    once per kind of key however many proposals share it.
    """
    live = reg.filter(~F.col("status").isin(P.EXCLUDED_STATUSES))
    out = None
    for reason in ("title", "summary"):
        key = F.lower(F.coalesce(reason, F.lit("")))
        wanted = proposals.select("type", key.alias("key")).filter("key <> ''").distinct()
        part = live.select("type", key.alias("key"), "id", "path").join(wanted, ["type", "key"]).select(
            "type", F.lit(reason).alias("match_reason"), "key", "id", "path")
        out = part if out is None else out.unionByName(part)
    return out


# --- GOV13: proposals ---------------------------------------------------------


def config(field: str, note_type: Column, table: dict = P.WRITE_CONFIG) -> Column:
    return lookup({t: c[field] for t, c in table.items() if c[field] is not None}, note_type)


def propose_notes(proposals: DataFrame, as_of: str, maintainer: str = "maintainer") -> DataFrame:
    """GOV13: validated write proposals with id, path and rendered template.

    Rows that lack a supported type, a title or a summary carry ``error``.
    """
    t = F.col("type")
    supported = t.isin(list(P.WRITE_CONFIG))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    error = (
        F.when(blank("type"), "--type is required")
        .when(~supported, F.concat(F.lit("Unsupported note type: "), t))
        .when(blank("title"), "--title is required")
        .when(blank("summary"), "--summary is required")
    )
    day = F.lit(as_of).cast("date")
    text_day = F.date_format(day, "yyyy-MM-dd")
    owners = {k: (maintainer if c["owner"] == "maintainer" else c["owner"]) for k, c in P.WRITE_CONFIG.items()}
    default_owner = lookup(owners, t)

    def after(field: str) -> Column:
        return F.date_format(F.date_add(day, config(field, t)), "yyyy-MM-dd")

    def quoted_or_null(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))

    rows = proposals.withColumn("error", error).withColumn("slug", slugify("title")).withColumn(
        "note_id", F.concat(F.lit("mem-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), "slug"))
    line = lambda key, c: F.concat(F.lit(f'{key}: "'), c, F.lit('"'))
    content = F.concat_ws(
        "\n", F.lit("---"),
        line("id", F.col("note_id")), line("type", t), line("repo_slug", F.col("repo_slug")), line("title", F.col("title")),
        line("status", config("status", t)), line("created", text_day), line("updated", text_day),
        line("owner", F.coalesce(blank_to_null(F.col("owner")), default_owner)), line("summary", F.col("summary")),
        F.lit("tags: []"), F.lit("keywords: []"), F.lit("links:"),
        *[F.lit(f"  {g}: []") for g in P.LINK_GROUPS],
        F.lit("retention:"),
        F.concat(F.lit("  review_after: "), quoted_or_null(after("review_days"))),
        F.concat(F.lit("  expires_after: "), quoted_or_null(after("expire_days"))),
        F.concat(F.lit("  keep: "), config("keep", t).cast("string")),
        F.lit("---"), F.lit(""),
        lookup({k: "\n\n".join(c["sections"]) + "\n" for k, c in P.WRITE_CONFIG.items()}, t),
    )
    ok = F.col("error").isNull()
    return rows.select(
        *proposals.columns, "error",
        F.when(ok, F.col("note_id")).alias("note_id"),
        F.when(ok, F.concat_ws("/", F.lit(P.REPOSITORY_ROOT), "repo_slug", config("folder", t),
                               F.concat(text_day, F.lit(" "), "title", F.lit(".md")))).alias("path"),
        F.when(ok, config("status", t)).alias("status"),
        F.when(ok, content).alias("content"),
    )
