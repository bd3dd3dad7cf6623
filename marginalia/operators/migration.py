"""Metadata migration plans over a table of notes (MIG1-MIG3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.text import lookup, path_hash, pick, slugify, strings, strip
from marginalia.operators.governance import config
from marginalia.operators.notes import (
    day_of, derive_date, derive_summary, derive_title, is_map, kind, link_groups, registry_pair_ok, resolve_note_type,
    status_alias, string_array, string_value, text,
)


def normalize_body(body: Column, title: Column) -> Column:
    """Body without leading blanks, without a heading equal to the title, blank runs cut."""
    lines = F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), r"^(?:[^\S\n]*\n)+", "")
    first = F.substring_index(lines, "\n", 1)
    heading = F.regexp_extract(first, r"^#[^\S\n]+(.+)$", 1)
    same = first.rlike(r"^#[^\S\n]+(.+)$") & (slugify(heading, "comparable") == slugify(title, "comparable"))
    rest = F.regexp_replace(F.regexp_replace(lines, r"^[^\n]*\n?", ""), r"^(?:[^\S\n]*\n)+", "")
    return strip(F.regexp_replace(F.when(same, rest).otherwise(lines), r"\n{3,}", "\n\n"))


def quoted(c: Column) -> Column:
    """A JSON string literal."""
    as_list = F.to_json(F.array(c))
    return F.substring(as_list, F.lit(2), F.length(as_list) - 2)


def _as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _shape(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _scalar(v: Column) -> Column:
    """One YAML scalar of a variant."""
    return (
        F.when(_shape(v).isin("", "VOID"), "null")
        .when(_shape(v) == "STRING", quoted(_as_text(v)))
        .otherwise(F.coalesce(_as_text(v), F.lit("null")))
    )


def _list_lines(key: Column, items: Column, indent: str) -> Column:
    inner = indent + "  "
    return F.when(F.size(items) == 0, F.concat(F.lit(indent), key, F.lit(": []"))).otherwise(
        F.concat(F.lit(indent), key, F.lit(":\n"), F.array_join(
            F.transform(items, lambda x: F.concat(F.lit(inner + "- "), x)), "\n")))


def _extra(key: Column, v: Column) -> Column:
    """Lines of one unknown key: scalar, list of scalars, or map of those."""
    def listed(x: Column) -> Column:
        return F.transform(F.try_variant_get(x, "$", "array<variant>"), _scalar)

    inner = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    return (
        F.when(_shape(v).startswith("ARRAY"), _list_lines(key, listed(v), ""))
        .when(_shape(v).startswith("OBJECT"), F.concat(key, F.lit(":\n"), F.array_join(F.transform(
            inner,
            lambda e: F.when(_shape(e["value"]).startswith("ARRAY"), _list_lines(e["key"], listed(e["value"]), "  "))
            .otherwise(F.concat(F.lit("  "), e["key"], F.lit(": "), _scalar(e["value"])))), "\n")))
        .otherwise(F.concat(key, F.lit(": "), _scalar(v)))
    )


def _render(value: dict[str, Column], extras: Column) -> Column:
    """Frontmatter text: fixed keys in order, unknown keys after them by name."""
    texts = ["id", "type", "repo_slug", "title", "status", "created", "updated", "owner", "summary"]
    null_or = lambda c: F.coalesce(quoted(c), F.lit("null"))
    listed = lambda k, c, ind="": _list_lines(F.lit(k), F.transform(c, quoted), ind)
    lines = [
        F.lit("---"),
        *[F.concat(F.lit(f"{k}: "), quoted(value[k])) for k in texts],
        listed("tags", value["tags"]), listed("keywords", value["keywords"]),
        F.lit("links:"), *[listed(g, value["links"][g], "  ") for g in P.LINK_GROUPS],
        F.lit("retention:"),
        F.concat(F.lit("  review_after: "), F.when(value["review_after"].isNull(), "null").otherwise(null_or(value["review_after"]))),
        F.concat(F.lit("  expires_after: "), F.when(value["expires_after"].isNull(), "null").otherwise(null_or(value["expires_after"]))),
        F.concat(F.lit("  keep: "), value["keep"].cast("string")),
        F.when(F.size(extras) > 0, F.array_join(extras, "\n")),
        F.lit("---"),
    ]
    return F.concat_ws("\n", *lines)


def plan_fixes(parsed: DataFrame, repo_slug: str, maintainer: str = "maintainer") -> DataFrame:
    """MIG1: per note the canonical metadata, the changes and the new content.

    ``parsed`` has ``path`` (relative to the repository folder), ``mtime_ms``,
    ``body`` and the parsed frontmatter; rows with unreadable YAML are left out
    and stay in the caller's error table.
    """
    path = F.col("path")
    falsy = lambda c: F.coalesce(c, F.lit("")) == ""
    rows = parsed.filter(F.coalesce("parse_error", F.lit("")) != "frontmatter.invalid_yaml").select(
        "path", "body", "fm_json", "keys", "kinds", "texts", "lists",
        string_value("type", "note_type").alias("raw_type"),
        text("status").alias("raw_status"),
        F.coalesce(text("title"), derive_title(F.col("body"), path)).alias("title"),
        derive_date(
            path, day_of(F.col("mtime_ms")),
            ["created", "date", "decided_on", "last_reviewed", "started_at"], "migrate").alias("created"),
    )
    note_type, _ = resolve_note_type(F.col("raw_type"), path, anywhere=False)
    rows = rows.withColumn("type", note_type).withColumn("new_body", normalize_body(F.col("body"), F.col("title")))
    alias = status_alias(F.lower(strip("raw_status")), F.col("type"))
    explicit = registry_pair_ok(F.col("type"), alias)
    fallback = lookup(P.DEFAULT_STATUS, F.col("type"))
    sure = F.col("type").isin("repo-home", "reference", "glossary") | (
        (F.col("type") == "session") & path.startswith("03 Sessions/"))
    alternatives = {
        t: "|".join(sorted(s for s in group if s != P.DEFAULT_STATUS[t])) for t, group in P.REGISTRY_STATUSES.items()
    }
    owners = {t: (maintainer if o == "maintainer" else o) for t, o in P.OWNER_BY_TYPE.items()}
    all_types = {**P.WRITE_CONFIG, "repo-home": P.REPO_HOME_RETENTION}

    def due(key: str, field: str) -> Column:
        given = text(f"retention.{key}")
        days = config(field, F.col("type"), all_types)
        return F.coalesce(given, F.date_format(F.date_add(F.col("created").try_cast("date"), days), "yyyy-MM-dd"))

    keep_given = F.when(kind("retention.keep") == "boolean", text("retention.keep") == "true")
    rows = (
        rows.withColumn("status", F.when(explicit, alias).otherwise(fallback))
        .withColumn("suggested", ~explicit & ~sure)
        .withColumn("updated", derive_date(path, F.col("created"), ["updated", "date", "last_reviewed", "started_at"], "migrate"))
        .withColumn("summary", F.coalesce(text("summary"), derive_summary(F.col("new_body"))))
        .withColumn("note_id", F.coalesce(
            text("id"),
            F.concat(F.lit("mem-"), F.replace("created", F.lit("-"), F.lit("")), F.lit("-"),
                     F.when(slugify("title") != "", slugify("title")).otherwise(path_hash("path")))))
        .withColumn("slug", F.coalesce(string_value("repo_slug", "repo"), F.lit(repo_slug)))
        .withColumn("owner", F.coalesce(text("owner"), lookup(owners, F.col("type"))))
        .withColumn("review_after", due("review_after", "review_days"))
        .withColumn("expires_after", due("expires_after", "expire_days"))
        .withColumn("keep", F.coalesce(keep_given, config("keep", F.col("type"), all_types)))
        .withColumn("tags", string_array("tags"))
        .withColumn("keywords", string_array("keywords"))
        .withColumn("links", link_groups())
    )
    ask = falsy(F.col("raw_status")) & F.col("suggested")
    new_retention = F.to_json(F.struct("review_after", "expires_after", "keep"), {"ignoreNullFields": "false"})
    old_retention = F.when(is_map("retention"), F.get_json_object("fm_json", "$.retention")).otherwise("{}")
    has_key = lambda k: F.array_contains("keys", k)
    changes = pick(
        (falsy(text("id")), "add_id"),
        (~F.col("raw_type").eqNullSafe(F.col("type")), "normalize_type"),
        (string_value("repo_slug", "repo").isNull(), "set_repo_slug"),
        (falsy(text("title")), "add_title"),
        (ask, "suggest_status"),
        (~ask & ~F.col("raw_status").eqNullSafe(F.col("status")), "normalize_status"),
        (falsy(text("created")) & falsy(text("date")), "set_created"),
        (falsy(text("updated")), "set_updated"),
        (falsy(text("owner")), "set_owner"),
        (falsy(text("summary")), "add_summary"),
        (F.col("new_body") != strip("body"), "normalize_body"),
        (~is_map("links"), "add_links"),
        (old_retention != new_retention, "set_retention"),
        *[(has_key(k), f"drop_{k}") for k in P.MIGRATION_DROPPED_KEYS],
    )
    known = P.STRICT_KEYS + P.MIGRATION_DROPPED_KEYS
    unknown = F.sort_array(F.filter("keys", lambda k: ~k.isin(known)))
    # Unknown keys are rare: only then is the block read as a variant.
    by_key = F.try_variant_get(F.parse_json("fm_json"), "$", "map<string,variant>")
    extras = F.when(
        F.size(unknown) > 0, F.transform(unknown, lambda k: _extra(k, F.try_element_at(by_key, k)))
    ).otherwise(strings([]))
    value = {k: F.col(k) for k in ("type", "title", "status", "created", "updated", "owner", "summary", "tags",
                                   "keywords", "links", "review_after", "expires_after", "keep")}
    value |= {"id": F.col("note_id"), "repo_slug": F.col("slug")}
    return rows.withColumn("changes", changes).select(
        "path", "note_id", "type", "status", "title", "created", "updated",
        F.when(F.col("suggested"), F.col("status")).alias("suggested_status"),
        F.when(F.col("suggested"), "ambiguous_type_default_requires_review").alias("suggested_status_reason"),
        F.when(F.col("suggested"), F.filter(F.split(lookup(alternatives, F.col("type")), r"\|"), lambda s: s != ""))
        .otherwise(strings([])).alias("suggested_status_alternatives"),
        F.when(ask, strings(["status_review_required"])).otherwise(strings([])).alias("blocking_issues"),
        "changes",
        (F.size("changes") > 0).alias("changed"),
        F.concat(_render(value, extras), F.lit("\n\n"), F.col("new_body"), F.lit("\n")).alias("content"),
    )


def dedupe_ids(plans: DataFrame) -> DataFrame:
    """MIG2: every plan of a repeated id gets a suffix from its path.

    Repeats are found by a combined count; the plans are joined to the repeated
    ids only.
    """
    repeated = plans.groupBy("note_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "note_id", F.lit(True).alias("again"))
    joined = plans.join(repeated, "note_id", "left")
    again = F.coalesce("again", F.lit(False))
    new_id = F.concat("note_id", F.lit("-"), path_hash("path"))
    fixed_line = F.concat(F.lit("id: "), quoted(F.col("note_id")))
    at = F.locate("id: ", F.col("content"))
    # The id line is the first one after the opening mark.
    content = F.concat(
        F.lit("---\nid: "), quoted(new_id),
        F.substring(F.col("content"), F.length(fixed_line) + 5, F.length("content")),
    )
    return joined.select(
        "path", F.when(again, new_id).otherwise(F.col("note_id")).alias("note_id"),
        *[c for c in plans.columns if c not in ("path", "note_id", "changes", "changed", "content")],
        F.when(again, F.array_distinct(F.concat("changes", strings(["dedupe_id"])))).otherwise(F.col("changes")).alias("changes"),
        (again | F.col("changed")).alias("changed"),
        F.when(again & (at > 0), content).otherwise(F.col("content")).alias("content"),
    )


def in_prefix(plans: DataFrame, path_prefix: str) -> DataFrame:
    prefix = path_prefix.strip("/")
    if not prefix:
        return plans
    return plans.filter((F.col("path") == prefix) | F.col("path").startswith(prefix + "/"))


def migration_report(
    plans: DataFrame, *, path_prefix: str = "", limit: int | None = None,
    status_review_only: bool = False, accept_suggested: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MIG3: ``(totals, change counts, selected plans)``; nothing is written.

    ``limit`` is the caller's page size, in path order.
    """
    scoped = in_prefix(plans, path_prefix)
    changed = scoped.filter("changed")
    chosen = changed.filter(F.array_contains("blocking_issues", "status_review_required")) if status_review_only else changed
    if limit is not None:
        chosen = chosen.orderBy("path").limit(limit)
    blocked = F.size("blocking_issues") > 0
    only_status = F.forall("blocking_issues", lambda i: i == "status_review_required")
    applicable = ~blocked | (F.lit(accept_suggested) & only_status)
    # One aggregate over both row sets, told apart by zeros.
    one, zero = F.lit(1), F.lit(0)
    flags = {
        "scanned": (one, zero),
        "total_candidates": (F.col("changed").cast("int"), zero),
        "changed": (zero, one),
        "applicable": (zero, applicable.cast("int")),
        "blocked": (zero, blocked.cast("int")),
    }
    both = scoped.select(*[c[0].alias(k) for k, c in flags.items()]).unionByName(
        chosen.select(*[c[1].alias(k) for k, c in flags.items()]))
    totals = both.agg(*[F.coalesce(F.sum(k), zero).cast("long").alias(k) for k in flags]).withColumn(
        "unchanged", F.col("scanned") - F.col("total_candidates"))
    counts = chosen.select(F.explode("changes").alias("change")).groupBy("change").agg(F.count("*").alias("n"))
    return totals, counts, chosen
