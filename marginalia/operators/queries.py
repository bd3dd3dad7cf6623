"""Query understanding as columns over a table of queries (QRY1-QRY5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.text import (
    blank_to_null, catalog_tokens, lookup, pick, strings, strip, tokenize,
)


def _says(name: str) -> Column:
    return F.lower("query").rlike(P.INTENT_PATTERNS[name])


def classify_queries(df: DataFrame) -> DataFrame:
    """QRY1: normalized text, keywords, intent, preferred types, excluded statuses."""
    recent, build, task, ref = _says("recent"), _says("build"), _says("task"), _says("reference")
    # Later groups win only where they are allowed to override.
    before_task = F.when(recent, "session").when(build, "implementation").otherwise("general")
    after_task = F.when(task & (before_task != "session"), "task").otherwise(before_task)
    after_ref = F.when(ref & (after_task == "general"), "reference").otherwise(after_task)
    intent = F.when(
        (after_ref == "general") & _says("ownership"), "architecture"
    ).otherwise(after_ref)
    preferred = F.array_distinct(
        pick(
            (_says("overview"), "repo-home"),
            (_says("overview"), "architecture-record"),
            (build, "spec"),
            (build, "todo"),
            (recent, "session"),
            (task, "todo"),
            (ref, "reference"),
        )
    )
    excluded = F.when(_says("history"), strings([])).otherwise(strings(P.EXCLUDED_STATUSES))
    return (
        df.withColumn("normalized", F.lower("query"))
        .withColumn("keywords", F.array_distinct(tokenize("query")))
        .withColumn("intent", intent)
        .withColumn("preferred_types", preferred)
        .withColumn("excluded_statuses", excluded)
    )


def expand_queries(classified: DataFrame) -> DataFrame:
    """QRY2: variants, the keyword phrase first, then one per preferred type."""
    phrase = F.array_join("keywords", " ")
    suffixed = F.transform(
        "preferred_types", lambda t: F.concat(phrase, F.lit(" "), lookup(P.VARIANT_SUFFIX, t))
    )
    raw = F.when(
        phrase == "", strings([])
    ).otherwise(F.array_distinct(F.concat(F.array(phrase), suffixed)))
    return classified.withColumn(
        "variants",
        F.filter(raw, lambda v: (v != F.col("query")) & (v != F.col("normalized"))),
    )


def plan_queries(df: DataFrame) -> DataFrame:
    """QRY3: full plan rows; ``terms`` are the distinct tokens of every planned text."""
    planned = expand_queries(classify_queries(df))
    texts = F.concat(F.array(strip("query"), F.col("normalized")), F.col("variants"))
    return (
        planned.withColumn("allow_archived", F.size("excluded_statuses") == 0)
        .withColumn("use_graph", F.col("intent") != "reference")
        .withColumn("needle", F.lower(strip("query")))
        .withColumn("terms", F.array_distinct(F.flatten(F.transform(texts, tokenize))))
    )


def classify_inputs(df: DataFrame, text_col: str = "input") -> DataFrame:
    """QRY4: workflow class of free text; the first matching rule wins."""
    text = F.lower(strip(text_col))

    def answer(intent: str, note_type: str, reason: str, types: list[str]) -> Column:
        return F.struct(
            F.lit(intent).alias("request_intent"),
            F.lit(note_type).alias("expected_note_type"),
            F.lit(reason).alias("reason"),
            strings(types).alias("retrieval_types"),
        )

    chosen = F.coalesce(
        *[F.when(text.rlike(pattern), answer(*rest)) for pattern, *rest in P.INPUT_RULES],
        answer(*P.INPUT_DEFAULT),
    )
    return df.withColumn("c", chosen).select("*", "c.*").drop("c")


def _stripped(token: Column) -> Column:
    """The token without its inflection endings, one entry per ending that applies."""
    n = F.length(token)

    def cut(ending: str, longer_than: int) -> Column:
        return F.when(
            F.endswith(token, F.lit(ending)) & (n > longer_than),
            F.substring(token, F.lit(1), n - len(ending)),
        )

    return F.array_compact(F.array(cut("ing", 5), cut("ers", 5), cut("ed", 4), cut("s", 3)))


# Synonym entries are phrases; their tokens are fixed, so they are listed once.
SYNONYM_TOKENS = {
    key: list(dict.fromkeys(w for phrase in phrases for w in phrase.split()))
    for key, phrases in P.CATALOG_SYNONYMS.items()
}


def expand_catalog_query(df: DataFrame, query_col: str = "query") -> DataFrame:
    """QRY5: tokens, expanded tokens, and which kinds of expansion took place."""
    synonyms = F.create_map(
        *[x for k, v in SYNONYM_TOKENS.items() for x in (F.lit(k), strings(v))]
    )

    def widen(token: Column) -> Column:
        return F.concat(
            F.array(token),
            F.coalesce(F.try_element_at(synonyms, token), strings([])),
            _stripped(token),
        )

    has_synonym = F.exists("tokens", lambda t: F.try_element_at(synonyms, t).isNotNull())
    has_morph = F.exists(
        "tokens",
        lambda t: F.try_element_at(synonyms, t).isNull() & (F.size(_stripped(t)) > 0),
    )
    return (
        df.withColumn("normalized", F.lower(strip(query_col)))
        .withColumn("tokens", catalog_tokens(query_col))
        .withColumn(
            "expanded_tokens",
            F.array_distinct(
                F.array_except(
                    F.filter(F.flatten(F.transform("tokens", widen)), lambda w: F.length(w) >= 2),
                    strings(P.CATALOG_STOP_WORDS),
                )
            ),
        )
        .withColumn("has_synonym", has_synonym)
        .withColumn("has_morphology", has_morph)
        .withColumn("search_text", F.coalesce(
            blank_to_null(F.array_join("expanded_tokens", " ")), F.col("normalized")))
    )
