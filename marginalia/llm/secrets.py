"""Secret scans through a trigram inverted index, in DataFrame functions only.

A Boolean trigram query is derived from every rule's expression: an AND of
clauses, each an OR of literal strings, each an AND of its trigrams.  The index
holds postings of the trigrams that the queries name; intersecting them gives the
rules that can match a text, and only those are verified on the whole text.  Rules
without mandatory trigrams scan every text.

Postings are keyed by a hash of the text: copies share them, and a collision could
only add a candidate.  Positions are code points, ends exclusive.

Defined results.  Null text counts as empty and has no spans; rows repeat as given;
ids may be null; extra columns are ignored by ``scan``, kept by ``redact``.  A match
that fails its length is dropped but its characters stay consumed.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``value`` is the group that must have ``least`` characters or more; 0 is the whole match.

    ``quick`` is an expression that every text with a span matches, by default ``regex``.
    """

    kind: str
    regex: str
    value: int = 0
    least: int = 1
    quick: str | None = None


# The three base kinds in their order, then the kinds added here.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + ADDED
_MOST = 64  # literal strings of a clause


def _exact(items) -> set[str] | None:
    """The lower-case strings that a parsed part matches, if they are few; else None."""
    out = {""}
    for op, arg in items:
        if op is rc.LITERAL:
            part = {chr(arg).lower()}
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is rc.SUBPATTERN:
            part = _exact(arg[3])
        elif op is rc.BRANCH:
            each = [_exact(x) for x in arg[1]]
            part = None if None in each else set().union(*each)
        elif op is rc.MAX_REPEAT and arg[:2] == (0, 1):
            inner = _exact(arg[2])
            part = None if inner is None else inner | {""}
        elif op is rc.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
            part = _exact(list(arg[2]) * arg[0])
        else:
            part = None
        if part is None or len(out) * len(part) > _MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(regex: str) -> list[list[list[str]]]:
    """AND of clauses, OR of strings, AND of trigrams; empty when nothing is mandatory."""
    clauses: list[list[list[str]]] = []

    def flush(strings: set[str]) -> None:
        grams = [sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(strings)]
        if all(grams):
            clauses.append(grams)

    def walk(items) -> None:
        run: set[str] = {""}
        for item in items:
            part = _exact([item])
            if part is not None and len(run) * len(part) <= _MOST:
                run = {a + b for a in run for b in part}
                continue
            flush(run)
            run = {""} if part is None else part
            op, arg = item
            if op is rc.SUBPATTERN:
                walk(arg[3])
            elif op is rc.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        flush(run)

    walk(rp.parse(regex))
    return clauses


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key, trigram`` over the distinct texts for every trigram that a rule's query names."""
    needed = sorted({g for r in rules for clause in trigram_query(r.regex) for s in clause for g in s})
    low = F.lower("text")
    found = F.filter(F.array(*[F.lit(g) for g in needed]), lambda g: F.contains(F.col("low"), g))
    return texts.select("key", low.alias("low")).select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key, rules``: the rules whose trigram query the postings of a text satisfy."""
    have = index.groupBy("key").agg(F.collect_set("trigram").alias("have"))

    def satisfied(rule: Rule) -> Column:
        out = F.lit(True)
        for clause in trigram_query(rule.regex):
            any_of = F.lit(False)
            for grams in clause:
                every = F.lit(True)
                for g in grams:
                    every &= F.array_contains("have", g)
                any_of |= every
            out &= any_of
        return out

    indexed = [r for r in rules if trigram_query(r.regex)]
    return have.select("key", F.array_compact(F.array(*[F.when(satisfied(r), r.kind) for r in indexed])).alias("rules")).filter(F.size("rules") > 0)


def _starts(lengths: Column) -> Column:
    """Running sums before each element, by chunks so that long arrays stay linear."""
    size = 256
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / size) - 1, F.lit(0)).cast("int")), lambda c: F.slice(lengths, c * size + 1, size))

    def running(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, zero, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")))["out"]

    total = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.flatten(F.zip_with(chunks, running(total), lambda c, base: F.transform(running(c), lambda x: x + base)))


def spans_of(rule: Rule, text: str) -> Column:
    """Array of ``start, end`` of the rule's matches in the column ``text``."""
    flags = "(?is)" if rule.regex.startswith("(?i)") else "(?s)"
    body = rule.regex.removeprefix("(?i)")
    # Each find continues where the last match ended: the gap before it, then the match.
    whole = F.lit(f"{flags}\\G(.*?)({body})")
    part = lambda k: F.regexp_extract_all(F.col(text), whole, F.lit(k))
    size = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    gap, match = size(part(1)), size(part(2))
    value = size(part(rule.value + 2)) if rule.value else match
    start = F.zip_with(_starts(F.zip_with(gap, match, lambda a, b: a + b)), gap, lambda a, b: a + b)
    rows = F.arrays_zip(start.alias("s"), match.alias("n"), value.alias("v"))
    good = F.filter(rows, lambda r: r["v"] >= rule.least)
    return F.transform(good, lambda r: F.struct(r["s"].alias("start"), F.lit(rule.kind).alias("kind"), (r["s"] + r["n"]).alias("end")))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``_spans``: array of ``start, kind, end`` by start, then order of ``rules``."""
    keyed = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_key", F.xxhash64("_text"))
    texts = keyed.select(F.col("_key").alias("key"), F.col("_text").alias("text"))
    maybe = candidates(postings(texts, rules), rules).select(F.col("key").alias("_key"), F.col("rules").alias("_rules"))
    rows = keyed.join(maybe, "_key", "left")
    none = F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")
    found = []
    for i, rule in enumerate(rules):
        wanted = F.array_contains("_rules", rule.kind) if trigram_query(rule.regex) else F.lit(True)
        hit = wanted & F.col("_text").rlike(rule.quick or rule.regex)
        ordered = F.transform(spans_of(rule, "_text"), lambda s, i=i: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))
        found.append(F.when(hit, ordered).otherwise(F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")))
    spans = F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.withColumn("_spans", F.coalesce(spans, none)).drop("_key", "_rules")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    rows = find_spans(docs.select("doc_id", "text"))
    base = [r.kind for r in BASE]
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in base],
                       F.sha2(text(F.filter("_spans", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"), text(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and ``n_chars`` counted anew."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("_text"), (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        mark = F.when(x["start"] >= s["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap, mark).alias("out"))

    done = F.aggregate("_spans", zero, step, lambda s: F.concat(s["out"], F.substring(F.col("_text"), (s["at"] + 1).cast("int"), F.length("_text"))))
    rows = find_spans(docs)
    clean = F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))
    count = {"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")} if "n_chars" in docs.columns else {}
    return rows.withColumn("text", clean).withColumns(count).select(docs.columns)
