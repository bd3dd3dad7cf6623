"""Notes: frontmatter, typing, dates, chunking (PRJ1-PRJ13, CHK1-CHK2).

Everything after the YAML step is a projection over one note row.  Chunks are
cut inside the row, so neither chunk order nor chunk lists need a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.frontmatter import read_blocks
from marginalia.functions.text import (
    blank_to_null, collapse, estimate_tokens, is_date, lookup, pick, strings, strip,
)

BLOCK = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"


# --- PRJ1, PRJ2 ---------------------------------------------------------------


def split_frontmatter(df: DataFrame, content: str = "content") -> DataFrame:
    """PRJ1: add ``block`` (NULL when there is none) and ``body``."""
    whole = F.regexp_extract(content, f"({BLOCK})", 1)
    has = F.col(content).rlike(BLOCK)
    return df.withColumn("block", F.when(has, F.regexp_extract(content, BLOCK, 1))).withColumn(
        "body", F.when(has, F.substring(F.col(content), F.length(whole) + 1, F.length(content))).otherwise(F.col(content))
    )


def parse_frontmatter(df: DataFrame) -> DataFrame:
    """PRJ2: add ``fm_json, keys, kinds, texts, lists`` and ``parse_error`` (code or NULL)."""
    return (
        # Marked so that filters on its result do not run it a second time.
        df.withColumn("p", read_blocks.asNondeterministic()("block"))
        .withColumn(
            "parse_error",
            F.when(F.col("block").isNull(), "frontmatter.missing_block")
            .when(F.col("p.json").isNull(), "frontmatter.invalid_yaml"),
        )
        .withColumn("parse_message", F.col("p.error"))
        .withColumn("fm_json", F.coalesce("p.json", F.lit("{}")))
        .withColumn("keys", F.coalesce("p.keys", strings([])))
        .withColumns({k: F.col(f"p.{k}") for k in ("kinds", "texts", "lists")})
        .drop("p")
    )


# --- PRJ11: typed access to dynamic values ------------------------------------


def kind(path: str) -> Column:
    """string, boolean, number, null, map, list, list:string; empty when absent."""
    return F.coalesce(F.try_element_at("kinds", F.lit(path)), F.lit(""))


def text(path: str) -> Column:
    """Text of a string, number or boolean."""
    return F.try_element_at("texts", F.lit(path))


def is_map(path: str) -> Column:
    return kind(path) == "map"


def string_value(*paths: str) -> Column:
    """First of the keys that holds a string, number or boolean, as text."""
    return F.coalesce(*[text(p) for p in paths])


def string_array(path: str) -> Column:
    """List of texts; a single non-blank string becomes a one-item list."""
    one = strip(text(path))
    return (
        F.when(kind(path).startswith("list"), F.filter(F.try_element_at("lists", F.lit(path)), lambda x: x != ""))
        .when((kind(path) == "string") & (one != ""), F.array(one))
        .otherwise(strings([]))
    )


def link_groups() -> Column:
    return F.struct(*[string_array(f"links.{g}").alias(g) for g in P.LINK_GROUPS])


# --- PRJ3, PRJ4: strict validation --------------------------------------------


def has_strict_shape(df: DataFrame) -> DataFrame:
    """PRJ4: add ``strict``: all strict keys are present."""
    return df.withColumn("strict", F.size(F.array_intersect("keys", strings(P.STRICT_KEYS))) == len(P.STRICT_KEYS))


def strict_candidates(df: DataFrame) -> DataFrame:
    """PRJ4: strict rows with links and retention coerced before validation.

    Links become lists of texts, retention dates become texts, and a ``keep``
    that is no boolean becomes false.
    """
    link_paths = [f"links.{g}" for g in P.LINK_GROUPS]
    due = ["retention.review_after", "retention.expires_after"]
    own = [*link_paths, *due, "retention.keep", "links", "retention"]

    def replaced(name: str, new: dict[str, Column]) -> Column:
        kept = F.map_filter(F.coalesce(name, F.create_map().cast(dict(df.dtypes)[name])), lambda k, _: ~k.isin(own))
        return F.map_concat(kept, F.create_map(*[x for k, c in new.items() for x in (F.lit(k), c)]))

    keep_text = F.when(kind("retention.keep") == "boolean", text("retention.keep")).otherwise("false")
    return has_strict_shape(df).filter("strict").select(
        *[c for c in df.columns if c not in ("kinds", "texts", "lists")],
        replaced("kinds", {
            "links": F.lit("map"), "retention": F.lit("map"), "retention.keep": F.lit("boolean"),
            **{p: F.lit("list:string") for p in link_paths},
            **{p: F.when(text(p).isNull(), "null").otherwise("string") for p in due},
        }).alias("kinds"),
        replaced("texts", {"retention.keep": keep_text, **{p: text(p) for p in due}}).alias("texts"),
        replaced("lists", {p: string_array(p) for p in link_paths}).alias("lists"),
    )


def _clean_list(path: str) -> Column:
    """Distinct trimmed texts in first-seen order; NULL unless all items are strings."""
    items = F.transform(F.try_element_at("lists", F.lit(path)), strip)
    return F.when(kind(path) == "list:string", F.array_distinct(F.filter(items, lambda x: x != "")))


def validate_frontmatter(df: DataFrame, owners: list[str] = P.DEFAULT_OWNERS) -> DataFrame:
    """PRJ3: add ``ok``, ``errors array<struct<code,message>>`` and ``value``."""

    def trimmed(key: str) -> Column:
        return F.when(kind(key) == "string", blank_to_null(strip(text(key))))

    def error(bad: Column, code: str, message) -> Column:
        shown = F.lit(message) if isinstance(message, str) else message
        return F.when(bad, F.struct(F.lit(f"frontmatter.{code}").alias("code"), shown.alias("message")))

    note_type, status, owner = trimmed("type"), trimmed("status"), trimmed("owner")
    known_type = F.coalesce(note_type.isin(P.NOTE_TYPES), F.lit(False))
    pairs = [f"{t}|{s}" for t, group in P.STRICT_STATUSES.items() for s in group]
    good_pair = F.concat_ws("|", note_type, status).isin(pairs)
    keep_ok = kind("retention.keep") == "boolean"

    def date_error(path: str, when: Column = F.lit(True), optional: bool = False) -> Column:
        wrong = ~((kind(path) == "string") & is_date(text(path)))
        if optional:
            wrong = wrong & ~kind(path).isin("", "null")
        return error(when & wrong, "invalid_date", f"Field '{path}' must use YYYY-MM-DD format.")

    dated = is_map("retention") & keep_ok
    errors = F.array_compact(F.array(
        error(trimmed("id").isNull(), "missing_id", "Memory notes must define a stable frontmatter id."),
        error(~known_type, "invalid_type",
              F.concat(F.lit("Unsupported memory type '"), F.coalesce(text("type"), F.lit("")), F.lit("'."))),
        error(status.isNull(), "invalid_status", "Memory notes must define a status."),
        error(status.isNotNull() & known_type & ~good_pair, "invalid_status_for_type",
              F.concat(F.lit("Status '"), status, F.lit("' is not valid for type '"), note_type, F.lit("'."))),
        error(trimmed("repo_slug").isNull(), "missing_repo_slug", "Memory notes must define repo_slug."),
        error(trimmed("title").isNull(), "empty_title", "Memory notes must define a non-empty title."),
        error(owner.isNull() | ~owner.isin(owners), "invalid_owner", f"Owner must be one of: {', '.join(owners)}."),
        error(trimmed("summary").isNull(), "empty_summary", "Memory notes must define a non-empty summary."),
        error(kind("tags") != "list:string", "invalid_tags", "Field 'tags' must be an array of strings."),
        error(kind("keywords") != "list:string", "invalid_keywords", "Field 'keywords' must be an array of strings."),
        error(~is_map("links"), "invalid_links", "Field 'links' must be an object with note-id arrays."),
        *[
            error(is_map("links") & (kind(f"links.{g}") != "list:string"), "invalid_links",
                  f"Field 'links.{g}' must be an array of strings.")
            for g in P.LINK_GROUPS
        ],
        error(~is_map("retention"), "invalid_retention", "Field 'retention' must be an object."),
        error(is_map("retention") & ~keep_ok, "invalid_retention", "Field 'retention.keep' must be a boolean."),
        date_error("retention.review_after", dated, True),
        date_error("retention.expires_after", dated, True),
        date_error("created"),
        date_error("updated"),
    ))
    value = F.struct(
        *[trimmed(k).alias(k) for k in ("id", "type", "repo_slug", "title", "status", "owner", "summary")],
        text("created").alias("created"),
        text("updated").alias("updated"),
        _clean_list("tags").alias("tags"),
        _clean_list("keywords").alias("keywords"),
        F.struct(*[_clean_list(f"links.{g}").alias(g) for g in P.LINK_GROUPS]).alias("links"),
        F.struct(
            text("retention.review_after").alias("review_after"),
            text("retention.expires_after").alias("expires_after"),
            (text("retention.keep") == "true").alias("keep"),
        ).alias("retention"),
    )
    return (
        df.withColumn("errors", errors)
        .withColumn("ok", F.size("errors") == 0)
        .withColumn("value", F.when(F.col("ok"), value))
    )


# --- PRJ5, PRJ6: type and status ----------------------------------------------


def type_from_path(path: Column, anywhere: bool = True) -> Column:
    """Folder rule; ``anywhere`` also accepts the folder deeper in the path."""
    lead = "(^|/)" if anywhere else "^"
    home = path == P.REPO_HOME_FILE
    if anywhere:
        home = home | path.rlike(rf"(^|/){P.REPOSITORY_ROOT}/[^/]+/{P.REPO_HOME_FILE.replace('.', chr(92) + '.')}$")
    out = F.when(home, "repo-home")
    for folder, note_type in P.FOLDER_TYPES:
        out = out.when(path.rlike(f"{lead}{folder}/"), note_type)
    return out.otherwise("reference")


def resolve_note_type(raw: Column, path: Column, anywhere: bool = True) -> tuple[Column, Column]:
    """PRJ5: ``(type, normalized flag)``."""
    low = F.lower(strip(raw))
    alias = lookup(P.TYPE_ALIASES, low)
    value = F.coalesce(alias, type_from_path(path, anywhere))
    return value, ~low.eqNullSafe(value)


def status_alias(low: Column, note_type: Column) -> Column:
    alias = lookup(P.STATUS_ALIASES, low)
    return F.when((alias == "active") & (note_type == "architecture-record"), "accepted").otherwise(alias)


def registry_pair_ok(note_type: Column, status: Column) -> Column:
    pairs = [f"{t}|{s}" for t, group in P.REGISTRY_STATUSES.items() for s in group]
    return F.coalesce(F.concat(note_type, F.lit("|"), status).isin(pairs), F.lit(False))


def resolve_note_status(raw: Column, note_type: Column) -> tuple[Column, Column]:
    """PRJ6: ``(status, normalized flag)``."""
    low = F.lower(strip(raw))
    alias = status_alias(low, note_type)
    value = F.when(registry_pair_ok(note_type, alias), alias).otherwise(lookup(P.DEFAULT_STATUS, note_type))
    return value, ~low.eqNullSafe(value)


# --- PRJ8-PRJ10, PRJ12 --------------------------------------------------------


def file_stem(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return collapse(F.regexp_replace(F.regexp_replace(base, r"\.md$", ""), r"[-_]+", " "))


def derive_title(body: Column, path: Column) -> Column:
    """PRJ8 without frontmatter: first level-one heading, else the file stem."""
    pattern = r"(?md)^#[^\S\n]+([^\n]+)$"
    return F.when(body.rlike(pattern), strip(F.regexp_extract(body, pattern, 1))).otherwise(file_stem(path))


def derive_summary(body: Column) -> Column:
    """PRJ9 without frontmatter: first paragraph that has prose."""
    blocks = F.split(body, r"\r?\n\r?\n")
    prose = F.transform(
        blocks,
        lambda b: collapse(F.array_join(
            F.filter(
                F.transform(F.split(b, r"\r?\n"), strip),
                lambda line: (line != "") & ~line.startswith("#") & ~line.startswith("- "),
            ), " ")),
    )
    return F.coalesce(F.try_element_at(F.filter(prose, lambda p: p != ""), F.lit(1)), F.lit(""))


def day_of(mtime_ms: Column) -> Column:
    """UTC day of a time in milliseconds, whatever the session time zone."""
    days = F.floor(mtime_ms / 86_400_000).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


DATE_PREFIX = r"^(\d{4}-\d{2}-\d{2})\b"


def derive_date(path: Column, fallback: Column, keys: list[str], mode: str = "index") -> Column:
    """PRJ10: first usable key, else a date in the file name, else the fallback.

    ``index`` looks at the start of the relative path; ``migrate`` looks at the
    base name and also accepts timestamps that begin with a date.
    """
    tries = []
    for k in keys:
        v = text(k)
        if mode == "migrate":
            tries.append(F.when(v.rlike(DATE_PREFIX), F.regexp_extract(v, DATE_PREFIX, 1)))
        else:
            tries.append(F.when(is_date(v), v))
    name = F.substring_index(path, "/", -1) if mode == "migrate" else path
    return F.coalesce(*tries, F.when(name.rlike(DATE_PREFIX), F.regexp_extract(name, DATE_PREFIX, 1)), fallback)


def synthetic_id(path: Column) -> Column:
    return F.concat(F.lit("mem-"), F.substring(F.sha2(path, 256), 1, 16))


# --- notes --------------------------------------------------------------------


def index_notes(parsed: DataFrame, prefix: str = "vault/") -> DataFrame:
    """One typed row per note from parsed ``path, content, mtime_ms, body`` rows.

    Staged so that each derived value is computed once per row.
    """
    path = F.col("path")
    staged = parsed.select(
        "path", "content", "mtime_ms", "body", "kinds", "texts", "lists",
        string_value("type", "note_type").alias("legacy_type"),
        text("status").alias("legacy_status"),
        text("id").alias("given_id"),
        F.coalesce(text("title"), derive_title(F.col("body"), path)).alias("title"),
        F.coalesce(text("summary"), derive_summary(F.col("body"))).alias("summary"),
        day_of(F.col("mtime_ms")).alias("fallback_date"),
    )
    t, t_norm = resolve_note_type(F.col("legacy_type"), path)
    typed = staged.withColumn("type", t).withColumn("type_normalized", t_norm).withColumn(
        "created", derive_date(path, F.col("fallback_date"), ["created", "date", "decided_on", "last_reviewed"])
    )
    s, s_norm = resolve_note_status(F.col("legacy_status"), F.col("type"))
    return typed.select(
        F.coalesce("given_id", synthetic_id(path)).alias("id"),
        "type",
        s.alias("status"),
        string_value("repo_slug", "repo").alias("repo_slug"),
        F.concat(F.lit(prefix), path).alias("path"),
        "title", "summary",
        string_array("tags").alias("tags"),
        string_array("keywords").alias("keywords"),
        text("owner").alias("owner"),
        "created",
        derive_date(path, F.col("created"), ["updated", "date", "last_reviewed"]).alias("updated"),
        "mtime_ms",
        F.sha2("content", 256).alias("content_hash"),
        link_groups().alias("links"),
        "legacy_type", "legacy_status",
        F.col("given_id").isNull().alias("synthetic_id"),
        "type_normalized",
        s_norm.alias("status_normalized"),
        "body",
    )


# --- CHK1, CHK2: chunks -------------------------------------------------------

H1 = r"^#[^\S\n]+([^\n]+)"
H2 = r"^##[^\S\n]+([^\n]+)"


def sections(body: Column, title: Column) -> Column:
    """CHK1: array of ``(heading, heading_level, content)`` of a Markdown body.

    The body is cut in front of its level-one and level-two heading lines; a
    level-one heading line is dropped from its section, a level-two one kept.
    """
    lines = F.regexp_replace(body, "\r\n", "\n")
    top = F.coalesce(blank_to_null(title), F.lit("Overview"))

    def cut(part: Column) -> Column:
        first = part.rlike(H1)
        second = part.rlike(H2)
        return F.struct(
            F.when(first, strip(F.regexp_extract(part, H1, 1)))
            .when(second, strip(F.regexp_extract(part, H2, 1)))
            .otherwise(top).alias("heading"),
            F.when(second, 2).otherwise(0).alias("heading_level"),
            strip(F.when(first, F.regexp_replace(part, H1, "")).otherwise(part)).alias("content"),
        )

    parts = F.filter(
        F.transform(F.split(lines, r"(?md)(?=^##?[^\S\n]+[^\n]+$)"), cut), lambda s: s["content"] != ""
    )
    whole = F.array(F.struct(top.alias("heading"), F.lit(0).alias("heading_level"), body.alias("content")))
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def build_chunks(notes: DataFrame) -> DataFrame:
    """CHK1 + CHK2: chunk rows of note rows, numbered inside each note."""
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    cut = notes.withColumn("parts", sections(F.col("body"), F.col("title"))).select(
        F.col("id").alias("note_id"), "path", "type", "status", "repo_slug", "tags", "keywords", "summary", "mtime_ms",
        F.posexplode("parts").alias("chunk_index", "part"),
    )
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("Source: "), F.col("path")),
        F.concat(F.lit("Heading: "), F.col("part.heading")),
        F.concat(F.lit("Type: "), F.col("type")),
        F.concat(F.lit("Repo: "), blank_to_null(F.col("repo_slug"))),
        F.concat(F.lit("Status: "), F.col("status")),
        listed("Tags", F.col("tags")),
        listed("Keywords", F.col("keywords")),
        F.concat(F.lit("Summary: "), blank_to_null(F.col("summary"))),
    )
    texts = cut.withColumn("text", strip(F.concat(header, F.lit("\n\n"), strip(F.col("part.content")))))
    return texts.select(
        F.concat(
            F.lit("chunk:"), "note_id", F.lit(":"), F.lpad(F.col("chunk_index").cast("string"), 4, "0"),
            F.lit(":"), F.substring(F.sha2("text", 256), 1, 8),
        ).alias("chunk_id"),
        "note_id",
        F.concat("path", F.lit(" § "), "part.heading").alias("source_path"),
        F.col("part.heading").alias("heading"),
        F.col("part.heading_level").alias("heading_level"),
        "chunk_index",
        "text",
        F.coalesce("summary", F.lit("")).alias("summary"),
        estimate_tokens("text").alias("tokens_estimated"),
        F.sha2("text", 256).alias("content_hash"),
        "type",
        "status",
        "mtime_ms",
    )


def note_flags() -> Column:
    """Issue names every note row can tell by itself (part of AGG2)."""
    return pick(
        (F.col("synthetic_id"), "missing_frontmatter_id"),
        (F.coalesce("summary", F.lit("")) == "", "missing_summary"),
        (F.col("type_normalized"), "legacy_type_normalized"),
        (F.col("status_normalized"), "legacy_status_normalized"),
    )
