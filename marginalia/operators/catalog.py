"""Catalog search and routing (CAT1-CAT7, FLT7-FLT9, JON9).

A catalog row has ``id, display_name, description, tags, triggers,
anti_triggers, group, tier``.  Tasks and queries are tables; every match is an
equi-join on tokens, anchors, prefixes or segments, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.joins import contains_pairs, lower_strip, materialise, rank_rows, short_contains_pairs, small, spread
from marginalia.functions.text import catalog_tokens, lookup, pick, strings, strip
from marginalia.operators.queries import expand_catalog_query

MULTIPLIER = {"triggers": 4, "tags": 3, "name": 1, "description": 1, "anti_triggers": 4}
# Entries of one task; each gives some ten tokens and as many pairs as tasks share them.
ENTRIES_PER_TASK = 5_000
REASONS = {
    "triggers": "evidence match", "tags": "tag match", "name": "name match",
    "description": "description match", "anti_triggers": "anti-trigger penalty",
}
TIER_RANK = {t: i for i, t in enumerate(P.CATALOG_TIERS)}


def tier_rank(tier: Column) -> Column:
    return F.coalesce(lookup(TIER_RANK, tier), F.lit(99))


def _elements(catalog: DataFrame) -> DataFrame:
    """One row per scored text of an entry: ``id, kind, el, text``."""
    def texts(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("text")))

    every = F.concat(
        texts("triggers", F.col("triggers")), texts("tags", F.col("tags")), texts("anti_triggers", F.col("anti_triggers")),
        texts("name", F.array(F.concat_ws(" ", "id", "display_name"))), texts("description", F.array("description")),
        texts("match", F.array("id", "display_name")),
    )
    return catalog.select("id", F.posexplode(every).alias("el", "x")).select("id", "el", "x.kind", "x.text")


def _parts(catalog: DataFrame) -> int:
    """Partitions for rows dealt by entry: as many as the catalog has, or the session's number."""
    return max(catalog.rdd.getNumPartitions(), int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def route_evidence(tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """CAT2: scores per ``(task_id, id)`` pair that shares a token or a phrase.

    ``tasks`` has ``task_id, task``.  Entries of the daily tier that share
    nothing with a task have the constant evidence 0.5; those pairs are not
    listed (``route_tasks`` accounts for them).
    """
    catalog = spread(catalog, ENTRIES_PER_TASK)
    elements = _elements(catalog)
    weight = F.coalesce(lookup(MULTIPLIER, F.col("kind")), F.lit(0))
    tokens = elements.filter("kind <> 'match'").select(
        "id", "kind", (weight * 2).cast("long").alias("score"), F.explode(catalog_tokens("text")).alias("token"))
    asked = tasks.select("task_id", F.explode(catalog_tokens("task")).alias("token"))
    shared = tokens.join(small(asked), "token").select("task_id", "id", "kind", "score")

    keyed = elements.select(F.struct("id", "kind", "el").alias("element"), lower_strip(F.col("text")).alias("hay"))
    pairs = short_contains_pairs(
        keyed, tasks.select("task_id", lower_strip(F.col("task")).alias("needle")), "element", "task_id", _parts(catalog))
    phrases = pairs.select("task_id", "element.id", "element.kind").select(
        "task_id", "id", "kind", F.when(F.col("kind") == "match", 1).otherwise(weight * 10).cast("long").alias("score"))

    # Dealt by entry before they are summed, so that a task's pairs are those of its entries.
    dealt = shared.unionByName(phrases).repartition(_parts(catalog), "id")
    by_kind = dealt.groupBy("task_id", "id").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).alias(f"s_{k}")
        for k in [*MULTIPLIER, "match"]
    ])
    rows = by_kind.join(catalog.select("id", "group", "tier"), "id")
    evidence = (
        F.when(F.col("tier") == "daily", 0.5).otherwise(0.0) + F.col("s_triggers") + F.col("s_tags") + F.col("s_name")
        + F.col("s_description") - F.col("s_anti_triggers"))
    return rows.select(
        "task_id", "id", "tier", evidence.cast("double").alias("evidence"),
        (F.col("s_match") > 0).alias("name_match"),
        pick(*[(F.col(f"s_{k}") > 0, r) for k, r in REASONS.items()]).alias("reasons"),
    )


def activation(evidence: DataFrame, by_score: bool = True) -> DataFrame:
    """CAT3: add ``activation`` and ``policy_reasons``."""
    strong = (F.col("evidence") >= 12) if by_score else F.lit(False)
    rank = (
        F.when((F.col("tier") == "explicit") & ~F.col("name_match"), 2)
        .when((F.col("tier") == "quiet") & ~(strong | F.col("name_match")), 1).otherwise(0))
    return evidence.withColumn("activation", rank).withColumn("policy_reasons", pick(
        (F.col("tier") == "daily", "daily tier"),
        ((F.col("activation") > 0) & (F.col("tier") == "explicit"), "explicit tier gating"),
        ((F.col("activation") > 0) & (F.col("tier") != "explicit"), "quiet activation gate"),
    ))


def rank_catalog(evidence: DataFrame, key: str = "task_id") -> DataFrame:
    """CAT4: matched entries with positive evidence in policy order."""
    return rank_rows(evidence.filter(F.col("evidence") > 0), key, F.desc("evidence"), F.col("activation"), tier_rank(F.col("tier")), F.col("id"))


def route_tasks(tasks: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CAT5: ``(routes, secondary)``: one row per task, and its secondary entries as rows."""
    # Read by every step below.
    scored = materialise(activation(route_evidence(tasks, catalog)))
    order = F.struct((-F.col("evidence")).alias("e"), "activation", tier_rank(F.col("tier")).alias("t"), "id")
    best = scored.filter(F.col("evidence") > 0).groupBy("task_id").agg(
        F.min_by(F.struct("id", "tier", "evidence", "activation", "reasons", "policy_reasons"), order).alias("b"))
    with_best = tasks.select("task_id", "task").join(best, "task_id", "left")
    # A daily entry that matches nothing has evidence 0.5 and may win over these.
    open_tasks = with_best.filter(F.col("b").isNull() | (F.col("b.evidence") <= 0.5)).select("task_id")
    touched = scored.filter("tier = 'daily'").join(open_tasks, "task_id", "left_semi").groupBy("task_id").agg(
        F.collect_set("id").alias("touched"), F.count("*").alias("n"))
    most = touched.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    lowest = [r["id"] for r in catalog.filter("tier = 'daily'").select("id").orderBy("id").limit(most + 1).collect()]
    daily = F.try_element_at(
        F.array_except(strings(lowest), F.coalesce("touched", strings([]))), F.lit(1))
    floor = F.struct(
        daily.alias("id"), F.lit("daily").alias("tier"), F.lit(0.5).alias("evidence"), F.lit(0).alias("activation"),
        strings([]).alias("reasons"), strings(["daily tier"]).alias("policy_reasons"))
    ahead = F.col("b").isNotNull() & (
        (F.col("b.evidence") > 0.5)
        | ((F.col("b.evidence") == 0.5) & (F.col("b.activation") == 0) & (F.col("b.tier") == "daily") & (F.col("b.id") < daily)))
    chosen = materialise(
        with_best.join(touched.select("task_id", "touched"), "task_id", "left")
        .withColumn("p", F.when(ahead | daily.isNull(), F.col("b")).otherwise(floor))
        .withColumn("primary", F.coalesce("p.id", F.lit(P.ROUTE_FALLBACK)))
        .withColumn("evidence", F.coalesce("p.evidence", F.lit(0.0)))
    )
    modes = {k: m for k, (m, _) in P.ROUTE_PROFILES.items()}
    seconds = {k: s for k, (_, s) in P.ROUTE_PROFILES.items()}
    chosen = chosen.withColumn("mode", F.coalesce(lookup(modes, F.col("primary")), F.lit("implement"))).withColumn(
        "default_second", F.coalesce(lookup(seconds, F.col("primary")), F.lit(P.ROUTE_FALLBACK)))
    bar = F.when(F.col("p_evidence") >= 20, 8).when(F.col("p_evidence") >= 10, 5).otherwise(3)
    strong = (
        scored.join(chosen.select("task_id", "primary", F.col("evidence").alias("p_evidence")), "task_id")
        .filter((F.col("id") != F.col("primary")) & (F.col("evidence") > bar))
        .select("task_id", "id", F.struct(F.lit(1).alias("l"), order.alias("o")).alias("pos"))
    )
    first = chosen.select(
        "task_id", F.col("default_second").alias("id"),
        F.struct(F.lit(0).alias("l"), F.lit(None).cast(scored.select(order.alias("o")).schema["o"].dataType).alias("o")).alias("pos"),
    ).join(chosen.select("task_id", "primary"), "task_id").filter(F.col("id") != F.col("primary")).drop("primary")
    listed = first.unionByName(strong).groupBy("task_id", "id").agg(F.min("pos").alias("pos"))
    listed = materialise(listed)
    secondary = rank_rows(listed, "task_id", F.col("pos"), name="position").select("task_id", "position", "id")
    named = lambda *ids: F.coalesce(F.max(F.col("id").isin(*ids)), F.lit(False))
    hints = listed.groupBy("task_id").agg(
        named("frontend-design").alias("f"), named("documentation-and-adrs", "doc-coauthoring").alias("d"), F.count("*").alias("n"))
    text = lower_strip(F.col("task"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    front = (F.col("primary") == "frontend-design") | yes("f")
    infra = text.rlike(P.ROUTE_INFRA_PATTERN)
    memory = text.rlike(P.ROUTE_MEMORY_PATTERN) | (F.col("primary") == "documentation-and-adrs") | yes("d")
    rules = pick((front, "frontend"), (infra, "agent-infrastructure"), (memory, "memory-note-routing"))
    why = F.array_distinct(F.concat("p.reasons", "p.policy_reasons"))
    # The umbrella entry stands in for a task that matches nothing, with the reasons of its tier.
    umbrella = catalog.filter(F.col("id") == P.ROUTE_FALLBACK).select("tier").first()
    gates = {"explicit": ["explicit tier gating"], "quiet": ["quiet activation gate"]}
    if umbrella is not None:
        why = F.when(F.col("p").isNull(), strings(gates.get(umbrella["tier"], []))).otherwise(why)
    rationale = F.array(
        F.when(F.col("p").isNull() & F.lit(umbrella is None), "No strong metadata match surfaced, so the umbrella workflow stays primary.").otherwise(
            F.concat(F.lit("Primary skill `"), "primary", F.lit("` won from "),
                     F.when(F.size(why) > 0, F.array_join(why, ", ")).otherwise("evidence and tier policy"), F.lit("."))),
        F.lit("Secondary skills come from the primary skill profile and the next strongest registry matches."))
    routes = chosen.join(hints, "task_id", "left").select(
        "task_id", "mode",
        F.when(F.col("evidence") >= 20, "high").when(F.col("evidence") >= 8, "medium").otherwise("low").alias("confidence"),
        "primary", "evidence", F.coalesce("n", F.lit(0)).alias("n_secondary"),
        strings(["repo-workflow"]).alias("always_rules"), rules.alias("extra_rules"),
        F.transform(rules, lambda r: lookup(P.ROUTE_NOTES, r)).alias("notes"), rationale.alias("rationale"))
    return routes, secondary


# --- CAT6: prefix and fuzzy search --------------------------------------------

# Our documented score.  A query term matches a catalog term exactly (weight
# 1), as a prefix (0.375, less the longer the rest) or within an edit distance
# of a fifth of its length (0.45, less per edit).  Each match adds weight x
# field boost x a BM25-style term score; the sum is multiplied by the number
# of query terms that matched.
PREFIX_WEIGHT, FUZZY_WEIGHT, MAX_EDITS = 0.375, 0.45, 6
K1, B, DELTA = 1.2, 0.7, 0.5


def search_terms(c) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s\p{P}]+"), lambda t: t != "")


def _postings(catalog: DataFrame) -> DataFrame:
    texts = {
        "id": F.col("id"), "display_name": F.col("display_name"), "description": F.col("description"),
        "tags": F.array_join("tags", " "), "triggers": F.array_join("triggers", " "),
    }
    def packed(field: str) -> Column:
        t = search_terms(texts[field])
        return F.transform(t, lambda x: F.struct(F.lit(field).alias("field"), F.size(t).alias("len"), x.alias("term")))

    # Dealt by entry once; all sums per entry then stay inside a task.
    rows = catalog.repartition(_parts(catalog), "id").select("id", F.explode(F.flatten(F.array(*[packed(f) for f in texts]))).alias("x")).select("id", "x.*")
    return rows.groupBy("term", "id", "field").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def term_matches(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(q, term, weight)``: exact, prefix and fuzzy matches by equi-joins.

    Fuzzy: a word within d edits keeps at least one of d + 1 segments of the
    query term, shifted by at most d; vocabulary pieces have
    the lengths of the segments asked for.
    """
    q = terms.select("q").distinct()
    length = F.length("q")
    exact = q.join(vocabulary, F.col("q") == F.col("term")).select("q", "term", F.lit(1.0).alias("weight"))
    heads = vocabulary.select("term", F.explode(F.transform(
        F.when(F.length("term") > 1, F.sequence(F.lit(1), F.length("term") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(F.col("term"), F.lit(1), i))).alias("q"))
    n = F.length("term")
    prefix = heads.join(small(q), "q").select(
        "q", "term", (PREFIX_WEIGHT * n / (n + 0.3 * (n - length))).alias("weight"))
    edits = F.least(F.lit(MAX_EDITS), F.round(length * P.CATALOG_FUZZY).cast("int"))
    pieces = q.withColumn("d", edits).filter("d > 0").select("q", "d", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("d")),
        lambda j: F.struct(
            (F.floor(j * length / (F.col("d") + 1)) + 1).cast("int").alias("at"),
            F.substring(
                F.col("q"), (F.floor(j * length / (F.col("d") + 1)) + 1).cast("int"),
                (F.floor((j + 1) * length / (F.col("d") + 1)) - F.floor(j * length / (F.col("d") + 1))).cast("int")).alias("seg"),
        ))).alias("x")).select("q", "d", "x.at", "x.seg")
    sizes = pieces.select(F.length("seg").alias("k")).distinct()  # a seventh of the longest query term at most
    cuts = vocabulary.join(F.broadcast(sizes), F.length("term") >= F.col("k")).select("term", "k", F.explode(
        F.sequence(F.lit(1), F.length("term") - F.col("k") + 1)).alias("pos")).select(
        "term", "pos", F.substring("term", F.col("pos"), F.col("k")).alias("seg"))
    near = (
        cuts.join(small(pieces), "seg")
        .filter((F.abs(F.col("pos") - F.col("at")) <= F.col("d")) & (F.abs(n - length) <= F.col("d")))
        .select("q", "term", "d").distinct()
        .withColumn("edits", F.levenshtein("q", "term")).filter((F.col("edits") > 0) & (F.col("edits") <= F.col("d")))
        .select("q", "term", (FUZZY_WEIGHT * n / (n + F.col("edits"))).alias("weight"), F.lit(1).alias("order"))
    )
    # A term that is both a prefix match and close counts as a prefix match.
    both = prefix.withColumn("order", F.lit(0)).unionByName(near)
    once = both.groupBy("q", "term").agg(F.min_by("weight", "order").alias("weight"))
    return exact.unionByName(once)


def catalog_search(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """CAT6: ranked entries per query; entries of the explicit tier only on a name match.

    ``queries`` has ``query_id, query``.
    """
    expanded = expand_catalog_query(queries)
    asked = expanded.select("query_id", F.explode(F.array_distinct(search_terms(F.col("search_text")))).alias("q"))
    catalog = spread(catalog, ENTRIES_PER_TASK)
    posts = _postings(catalog)
    n_docs = catalog.count()
    means = {r["field"]: r["total"] / n_docs for r in posts.groupBy("field").agg(
        F.sum("tf").alias("total")).collect()}  # five rows
    dfs = posts.groupBy("term", "field").agg(F.count("*").alias("df"))
    matches = term_matches(asked, posts.select("term").distinct())
    wanted = materialise(asked.join(matches, "q").join(dfs, "term"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = lookup({k: float(v) for k, v in means.items()}, F.col("field"))
    tf = F.col("tf")
    part = idf * (DELTA + tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean)))
    boost = lookup(P.CATALOG_SEARCH_BOOSTS, F.col("field"))
    scored = (
        posts.join(small(wanted), ["term", "field"])
        .groupBy("query_id", "id", "q").agg(F.sum(F.col("weight") * boost * part).alias("s"))
        .groupBy("query_id", "id").agg((F.sum("s") * F.count("*")).alias("raw"))
        .withColumn("evidence", F.round("raw", 6)).drop("raw")
    )
    named = name_matches(queries, catalog).withColumn("name_match", F.lit(True))
    rows = (
        scored.join(named, ["query_id", "id"], "left").withColumn("name_match", F.coalesce("name_match", F.lit(False)))
        .join(catalog.select("id", "tier"), "id")
        .join(small(expanded.select("query_id", "has_synonym", "has_morphology"), like=queries), "query_id")
        .withColumn("reasons", pick(
            (F.col("name_match"), "name"), (F.lit(True), "minisearch"), (F.col("has_synonym"), "synonym"),
            (F.col("has_morphology"), "query expansion")))
        .filter((F.col("tier") != "explicit") | F.col("name_match"))
        .drop("has_synonym", "has_morphology")
    )
    return rank_catalog(activation(rows, by_score=False), "query_id")


def name_matches(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries whose id or display name contains the query text."""
    names = catalog.select("id", F.posexplode(F.array("id", "display_name")).alias("k", "name")).select(
        F.concat_ws("|", "id", F.col("k").cast("string")).alias("name_id"), "id", lower_strip(F.col("name")).alias("hay"))
    pairs = contains_pairs(
        names.select("name_id", "hay"), queries.select("query_id", lower_strip(F.col("query")).alias("needle")), "name_id", "query_id")
    return pairs.join(names.select("name_id", "id"), "name_id").select("query_id", "id").distinct()


# --- lists, reads, build ------------------------------------------------------


def list_catalog(catalog: DataFrame, group: str | None = None, daily_only: bool = False, include_all: bool = False) -> DataFrame:
    """FLT7: the daily tier only, unless all, a group or daily is asked for."""
    out = catalog
    if group:
        out = out.filter(F.col("group") == group)
    if daily_only or not (include_all or group):
        out = out.filter(F.col("tier") == "daily")
    return out.orderBy(tier_rank(F.col("tier")), "id")


def read_catalog_entries(catalog: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT8: ``(entries, unknown)`` for a table of names (id or display name, case ignored)."""
    keys = catalog.select("id", F.explode(F.array_distinct(F.array(F.lower("id"), F.lower("display_name")))).alias("key"))
    asked = names.select("name", lower_strip(F.col("name")).alias("key"))
    found = asked.join(keys, "key").groupBy("name").agg(F.min("id").alias("id"))
    return found, names.select("name").join(found, "name", "left_anti")


def content_fallback(queries: DataFrame, answered: DataFrame, sources: DataFrame) -> DataFrame:
    """FLT9: entries whose contents hold the text of a query no search answered."""
    open_queries = queries.join(answered.select("query_id").distinct(), "query_id", "left_anti")
    return contains_pairs(
        sources.select("id", F.lower("contents").alias("hay")),
        open_queries.select("query_id", lower_strip(F.col("query")).alias("needle")), "id", "query_id")


def clean_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, strings([])), lambda v: strip(v) != ""))


def join_catalog(sources: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JON9: ``(joined, errors)``: every source needs valid metadata.

    ``sources`` has ``id, name, description, source_dir, path``; ``metadata``
    has ``id, tags, triggers, anti_triggers, group, tier``.
    """
    m = metadata.withColumn("known", F.lit(True))
    rows = sources.join(m, "id", "left")
    group = F.coalesce("group", F.lit(P.CATALOG_DEFAULT_GROUP))
    tier = F.coalesce("tier", F.lit(P.CATALOG_DEFAULT_TIER))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    rows = rows.withColumn("error", F.when(F.col("known").isNull(), "missing_metadata")
                           .when(blank("name"), "missing_name").when(blank("description"), "missing_description")
                           .when(~group.isin(P.CATALOG_GROUPS), "invalid_group").when(~tier.isin(P.CATALOG_TIERS), "invalid_tier"))
    good = rows.filter("error IS NULL").select(
        "id", strip("name").alias("display_name"), strip("description").alias("description"), "source_dir", "path",
        clean_list(F.col("tags")).alias("tags"), clean_list(F.col("triggers")).alias("triggers"),
        clean_list(F.col("anti_triggers")).alias("anti_triggers"), group.alias("group"), tier.alias("tier"))
    return good, rows.filter("error IS NOT NULL").select("id", "error")


def build_catalog(sources: DataFrame, metadata: DataFrame) -> DataFrame:
    """CAT7: the catalog in id order."""
    return join_catalog(sources, metadata)[0].orderBy("id")


def catalog_drift(current: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """CAT7: rows in only one of two catalogs; no rows means current."""
    return current.exceptAll(rebuilt).withColumn("side", F.lit("stale")).unionByName(
        rebuilt.exceptAll(current).withColumn("side", F.lit("missing")))


def check_entries(entries: DataFrame) -> DataFrame:
    """Field and enum checks of loaded entries: add ``errors``."""
    texts = ["id", "display_name", "description", "source_dir", "path", "group", "tier"]
    lists = ["tags", "triggers", "anti_triggers"]
    return entries.withColumn("errors", pick(
        *[(strip(F.coalesce(c, F.lit(""))) == "", f"empty_{c}") for c in texts],
        *[(F.col(c).isNull() | F.exists(F.coalesce(c, strings([])), lambda v: v.isNull()), f"invalid_{c}") for c in lists],
        (~F.coalesce(F.col("group").isin(P.CATALOG_GROUPS), F.lit(False)), "unknown_group"),
        (~F.coalesce(F.col("tier").isin(P.CATALOG_TIERS), F.lit(False)), "unknown_tier"),
    ))
