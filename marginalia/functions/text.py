"""Text column expressions: whitespace, tokens, slugs, estimates, excerpts.

All of them are built-in Spark expressions; none leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import policy as P


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of white space at both ends (``F.trim`` cuts blanks only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def collapse(c) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def blank_to_null(c) -> Column:
    return F.when(col(c) != "", col(c))


def strings(values: list[str]) -> Column:
    """A literal array of strings (typed also when empty)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup; NULL when the key is missing."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def pick(*flagged: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in flagged]))


# --- tokens -------------------------------------------------------------------


def tokenize(c) -> Column:
    """Search tokens: lower-case runs of ``a-z 0-9 / . _ -`` (repeats kept)."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([a-z0-9/._-]+)"))


def words(c) -> Column:
    """Maximal runs of ``a-z 0-9`` of the lower-cased text (repeats kept)."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([a-z0-9]+)"))


def catalog_tokens(c) -> Column:
    """Distinct catalog tokens: words of two or more characters, stop words out."""
    return F.array_distinct(
        F.array_except(
            F.filter(words(c), lambda w: F.length(w) >= 2), strings(P.CATALOG_STOP_WORDS)
        )
    )


def trigrams(c) -> Column:
    """Character trigrams of a token; the token itself when it is short."""
    token = col(c)
    return F.when(F.length(token) <= 3, F.array(token)).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substring(token, i, 3)
        )
    )


def estimate_tokens(c) -> Column:
    """A quarter of the length, rounded up; 0 for empty text."""
    n = F.length(col(c))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.ceil(n / 4)).cast("long")


# --- slugs --------------------------------------------------------------------


def slugify(c, style: str = "governance") -> Column:
    """Slug in one of four styles: governance, board, story, comparable."""
    low = F.lower(col(c))
    if style == "governance":
        return F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    if style == "story":
        dashed = F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
        return F.substring(dashed, 1, 64)
    if style == "board":
        bare = F.regexp_replace(low, "[`'\"“”‘’().,:/]", "")
        dashed = F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), r"-+", "-")
        return F.regexp_replace(dashed, r"^-|-$", "")
    if style == "comparable":
        return F.lower(collapse(F.regexp_replace(col(c), "[—–-]", " ")))
    raise ValueError(f"unknown slug style: {style}")


# --- note text ----------------------------------------------------------------


def content_only(c) -> Column:
    """Text after the first blank line, trimmed; the whole text if there is none."""
    text = col(c)
    at = F.locate("\n\n", text)
    return F.when(at == 0, text).otherwise(strip(F.substring(text, at + 2, F.length(text))))


def is_substantive(c) -> Column:
    """At least 40 characters left once heading lines are dropped."""
    bare = F.regexp_replace(content_only(c), r"(?md)^#+\s+.+$", "")
    return F.length(collapse(bare)) >= 40


def excerpt(content, query, max_length: int = 240) -> Column:
    """Window of the content round the earliest query token longer than two characters."""
    text = collapse(content)
    low = F.lower(text)
    found = F.filter(
        F.transform(
            F.filter(tokenize(query), lambda t: F.length(t) > 2),
            lambda t: F.call_function("instr", low, t),
        ),
        lambda i: i > 0,
    )
    first = F.array_min(found) - 1
    start = F.greatest(F.lit(0), first - max_length // 3)
    end = F.least(F.length(text), start + max_length)
    window = F.concat(
        F.when(start > 0, F.lit("... ")).otherwise(F.lit("")),
        strip(F.substring(text, start + 1, end - start)),
        F.when(end < F.length(text), F.lit(" ...")).otherwise(F.lit("")),
    )
    trimmed = F.concat(
        F.regexp_replace(F.substring(text, 1, max_length - 20), r"\s+$", ""),
        F.lit("\n...[truncated]"),
    )
    return (
        F.when(F.length(text) <= max_length, text)
        .when(first.isNull(), trimmed)
        .otherwise(window)
    )


# --- hashes -------------------------------------------------------------------


def hash32(c, seed: int) -> Column:
    """Unsigned 32-bit multiplicative hash of a lower-case ASCII token, as bigint."""
    return F.aggregate(
        F.filter(F.split(col(c), ""), lambda ch: ch != ""),
        F.lit(seed).cast("long"),
        lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(P.FNV_PRIME).cast("long"))
        .bitwiseAND(F.lit(0xFFFFFFFF).cast("long")),
    )


def path_hash(c) -> Column:
    """Eight hex digits of the 32-bit ``h * 31 + code`` hash of a path."""
    h = F.aggregate(
        F.filter(F.split(col(c), ""), lambda ch: ch != ""),
        F.lit(0).cast("long"),
        lambda h, ch: (h * 31 + F.ascii(ch)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")),
    )
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def days_between(date_text, as_of: str) -> Column:
    """Whole days from a ``YYYY-MM-DD`` text to ``as_of``; NULL when it is no date."""
    return F.datediff(F.lit(as_of).cast("date"), F.try_to_timestamp(col(date_text)).cast("date"))


def is_date(c) -> Column:
    """Shape check only: ``2026-99-99`` passes."""
    return F.coalesce(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
