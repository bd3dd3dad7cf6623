"""Links between notes: extraction, resolution, graph (CHK5-6, JON2-3, GRF1-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.joins import small
from marginalia.functions.text import lookup, strings, strip
from marginalia.operators.lexical import eligible, top_pool


def path_key(c: Column) -> Column:
    """Comparable form of a path: no vault prefix, no ``.md``, lower case."""
    out = F.replace(c, F.lit("\\"), F.lit("/"))
    for pattern in (r"(?i)^vault/", r"(?i)\.md$", r"^\./+", r"^/+"):
        out = F.regexp_replace(out, pattern, "")
    return F.lower(strip(out))


def title_key(c: Column) -> Column:
    return F.lower(strip(c))


def collapse_path(c: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a relative path."""
    kept = F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        kept,
        strings([]),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.array_join(folded, "/"), F.when(c.endswith("/"), "/").otherwise(""))


# --- CHK5, CHK6: explode ------------------------------------------------------


def extract_links(notes: DataFrame) -> DataFrame:
    """CHK5: ``(from_id, path, kind, target)`` for each Markdown link and wikilink."""
    md = F.regexp_extract_all("body", F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))
    wiki = F.regexp_extract_all("body", F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    tagged = F.concat(
        F.transform(md, lambda t: F.struct(F.lit("markdown").alias("kind"), strip(t).alias("target"))),
        F.transform(wiki, lambda t: F.struct(F.lit("wiki").alias("kind"), strip(t).alias("target"))),
    )
    return (
        notes.select(F.col("id").alias("from_id"), "path", F.explode(tagged).alias("x"))
        .select("from_id", "path", "x.kind", "x.target")
        .filter(F.col("target") != "")
    )


def explode_links(notes: DataFrame) -> DataFrame:
    """CHK6: frontmatter ``links`` struct to ``(from_id, link_group, target)`` rows."""
    def rows(group: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"links.{group}"), strings([])),
            lambda t: F.struct(F.lit(group).alias("link_group"), t.alias("target")),
        )

    grouped = F.flatten(F.array(*[rows(g) for g in P.LINK_GROUPS]))
    return notes.select(F.col("id").alias("from_id"), F.explode(grouped).alias("x")).select("from_id", "x.*")


# --- JON2: resolution ---------------------------------------------------------


def _unique(keys: DataFrame, name: str) -> DataFrame:
    """Keys that name exactly one note.  min = max needs no distinct set per key."""
    return (
        keys.filter(F.col("key") != "")
        .groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        .filter(F.col("lo") == F.col("hi"))
        .select(F.col("key").alias(f"{name}_key"), F.col("lo").alias(name))
    )


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """JON2: add ``resolved`` (a note id or NULL) to ``extract_links`` rows.

    Order: exact id, unique path key, unique directory-relative path key
    (Markdown) or unique title (wikilink).  Ambiguous keys name nothing.
    """
    key = path_key(F.col("path"))
    path_keys = _unique(
        notes.select("id", F.explode(F.array(key, F.substring_index(key, "/", -1))).alias("key")), "by_path"
    )
    title_keys = _unique(notes.select("id", title_key(F.col("title")).alias("key")), "by_title")
    ids = notes.select(F.col("id").alias("by_id")).distinct()

    is_md = F.col("kind") == "markdown"
    bare = F.regexp_replace(F.col("target"), r"^<|>$", "")
    md_target = strip(F.regexp_extract(bare, r"^([^#?]*)", 1))
    # A question mark after a hash is gone with the hash, so one cut is enough.
    wiki_target = strip(F.regexp_extract(F.col("target"), r"^([^|#]*)", 1))
    wanted = F.when(is_md, md_target).otherwise(wiki_target)
    outside = is_md & (
        F.col("wanted").rlike(r"(?i)^[a-z]+://") | F.startswith("wanted", F.lit("mailto:"))
    )
    own = path_key(F.col("path"))
    folder = F.when(F.contains(own, F.lit("/")), F.regexp_replace(own, r"/[^/]*$", "")).otherwise("")
    relative = path_key(collapse_path(F.concat_ws("/", F.when(folder != "", folder), "wanted")))
    # A key that does not apply names nothing; it is spread, as equal nulls would meet in one task.
    nothing = F.concat(F.lit("\u0000"), F.xxhash64("from_id", "target").cast("string"))
    keyed = (
        links.withColumn("wanted", wanted)
        .withColumn("usable", (F.col("wanted") != "") & ~outside)
        .withColumn("direct_key", F.when(F.col("usable"), path_key(F.col("wanted"))).otherwise(nothing))
        .withColumn("relative_key", F.when(F.col("usable") & is_md, relative).otherwise(nothing))
        .withColumn("title_key", F.when(F.col("usable") & ~is_md, title_key(F.col("wanted"))).otherwise(nothing))
    )
    rel = path_keys.select(F.col("by_path_key").alias("rel_key"), F.col("by_path").alias("by_rel"))
    return (
        keyed.join(ids, F.col("usable") & (F.col("wanted") == F.col("by_id")), "left")
        .join(path_keys, F.col("direct_key") == F.col("by_path_key"), "left")
        .join(rel, F.col("relative_key") == F.col("rel_key"), "left")
        .join(title_keys, F.col("title_key") == F.col("by_title_key"), "left")
        .select(
            "from_id", "path", "kind", "target",
            F.coalesce("by_id", "by_path", "by_rel", "by_title").alias("resolved"),
        )
    )


# --- JON3, GRF1: edges --------------------------------------------------------


def split_links(links: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JON3: typed edges of existing targets, and the distinct missing targets.

    Missing targets stay one row each: a list per note is only a presentation
    of them.
    """
    ids = notes.select(F.col("id").alias("target"))
    edges = links.join(ids, "target", "left_semi").select(
        "from_id", F.col("target").alias("to_id"),
        lookup(P.EDGE_TYPE_BY_GROUP, F.col("link_group")).alias("type"),
    ).distinct()
    missing = links.join(ids, "target", "left_anti").select("from_id", "target").distinct()
    return edges, missing


def build_graph(
    notes: DataFrame, links: DataFrame, body_links: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """GRF1: ``(nodes, edges, unresolved)``."""
    edges, missing = split_links(links, notes)
    if body_links is not None:
        inferred = (
            resolve_links(body_links, notes)
            .filter(F.col("resolved").isNotNull() & (F.col("resolved") != F.col("from_id")))
            .select("from_id", F.col("resolved").alias("to_id"), F.lit(P.BODY_EDGE_TYPE).alias("type"))
        )
        edges = edges.unionByName(inferred).distinct()
    return notes.select("id", "type", "status"), edges, missing


def link_lists(links: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF2: outbound targets (unresolved ones too) and inbound sources, as rows.

    A popular note may be linked from a third of the corpus, so inbound
    sources are rows and are never gathered into one array.
    """
    out = links.select("from_id", strip(F.col("target")).alias("to_id")).filter(F.col("to_id") != "").distinct()
    ids = notes.select(F.col("id").alias("to_id"))
    inbound = out.join(ids, "to_id", "left_semi")
    return out, inbound


# --- GRF3, GRF4: neighbourhood ------------------------------------------------


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected ``(a, b)`` adjacency without repeats or self-links."""
    fwd = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    back = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    return fwd.unionByName(back).filter(F.col("a") != F.col("b")).distinct()


def two_hop(edges: DataFrame, seeds: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """GRF3: ``(seed, id, distance)`` for nodes one or two undirected steps away."""
    adj = neighbours(edges)
    first = small(seeds.select("seed").distinct(), like=like).join(adj, F.col("seed") == F.col("a")).select(
        "seed", F.col("b").alias("id"), F.lit(1).alias("distance")
    )
    second = (
        first.join(adj, F.col("id") == F.col("a"))
        .filter(F.col("b") != F.col("seed"))
        .select("seed", F.col("b").alias("id"), F.lit(2).alias("distance"))
    )
    return first.unionByName(second).groupBy("seed", "id").agg(F.min("distance").alias("distance"))


def graph_search(
    lexical: DataFrame, plans: DataFrame, edges: DataFrame, corpus: DataFrame, *, pool: int,
    repo_slug: str | None = None, note_type: str | None = None, integrity_mode: str = "prefer-healthy",
) -> DataFrame:
    """GRF4: chunks of notes near the note of the best lexical hit.

    The seed is taken from the ranks, that is before the duplicate penalty.
    """
    seeds = (
        lexical.filter(F.col("rank") == 1)
        .join(small(plans.filter("use_graph").select("query_id"), like=plans), "query_id")
        .select("query_id", F.col("note_id").alias("seed"))
    )
    near = two_hop(edges, seeds, like=plans)
    by_query = near.join(small(seeds, like=plans), "seed").select(
        "query_id", F.col("id").alias("note_id"), "distance", lookup(P.GRAPH_SCORES, F.col("distance")).alias("score")
    )
    hits = by_query.join(corpus.select("note_id", "chunk_id"), "note_id").select(
        "query_id", "chunk_id", "distance", "score"
    )
    allowed = eligible(
        hits, plans, corpus, repo_slug=repo_slug, note_type=note_type, integrity_mode=integrity_mode,
        columns=["source_file", "heading"],
    )
    return top_pool(allowed, pool, F.desc("score"), "source_file", "heading", "chunk_id").drop("status")
