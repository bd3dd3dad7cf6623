"""Benchmark decontamination by template windows, in DataFrame functions only.

Words become a template: numbers, names (capitalised inside a sentence) and units
after a number turn into typed placeholders.  Items and documents have their windows
twice, with the names as placeholders and as words.  Windows of five template words are
hash-joined with those of the benchmark items.  Matches on one diagonal (document
position minus item position) belong to one passage; its slots must be filled
consistently, one document value per item value and back, which admits
re-parameterised questions and turns away chance hits on placeholders.  A document
leaks an item when its consistent passages cover at least ``similarity`` of the
item's windows, of both kinds together or of those with placeholders for names.  Windows
with fewer than two literal words count only where a document has the same words.
Every window has an anchor, its rarest literal word; windows are made only of
documents that hold the anchors of enough windows of an item.

Defined results.  Null and empty texts and items have no windows and match
nothing.  Items or documents of fewer than five words are one window, so they only
match each other whole.  Item windows of numbers alone are not counted; an item left
without windows matches nothing.  Repeated rows give the
same result once per distinct ``(doc_id, text)``; ids may be null.  Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stage

WINDOW = 5
SIMILARITY = 0.8
# Item windows are sent to every task up to this many rows (at most 25 MB); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000

# A word, with the sentence mark before it if there is one; measure words.
TOKEN = r"(?:[.!?:\n][\s\"']*)?(?:[\p{L}\p{M}]+|\p{N}+)"
WORD = r"[\p{L}\p{M}]+|\p{N}+"
MARKS = " .!?:\n\r\t\"'\u000b\f"
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
         "kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter "
         "liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year "
         "years cent cents dollar dollars euro euros usd eur gbp percent degrees mph kph").split()
PLACEHOLDERS = ("<number>", "<unit>", "<name>")


def _word(raw: Column) -> Column:
    return F.lower(F.ltrim(raw, F.lit(MARKS)))


def _numeric(t: Column) -> Column:  # words are all letters or all digits
    return F.substring(t, -1, 1).between("0", "9")


def _template(raw: str) -> Column:
    """The template words of the array column ``raw``, names as words."""
    units = F.array(*[F.lit(u) for u in UNITS])

    def one(t: Column, i: Column) -> Column:
        w = _word(t)
        unit = (i > 0) & _numeric(F.get(F.col(raw), i - 1)) & F.array_contains(units, w)
        return F.when(_numeric(t), "<number>").when(unit, "<unit>").otherwise(w)

    return F.transform(F.col(raw), one)


def _named(raw: str, plain: str) -> Column:
    """The template ``plain`` of ``raw`` with the names as placeholders."""

    def one(t: Column, i: Column) -> Column:
        first = F.substring(t, 1, 1)
        name = (i > 0) & (first != F.lower(first)) & (t != F.upper(t)) & ~_numeric(t)
        return F.when(name, "<name>").otherwise(F.get(F.col(plain), i))

    return F.transform(F.col(raw), one)


def _joint(hashes: str, at: Column) -> Column:
    """Hash of the window at ``at``; places beyond the end are not hashed."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(WINDOW)])


def windows(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep, raw, plain, named, at, hash``: each window start once per hash of its two templates; the arrays are whole."""
    words = rows.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("raw"))
    tpl = words.filter(F.size("raw") > 0).withColumn("plain", _template("raw")).withColumn("named", _named("raw", "plain"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("raw") - WINDOW, F.lit(0)))
    each = tpl.withColumns({f"{x}_hash": F.transform(x, lambda w: F.xxhash64(w)) for x in ("plain", "named")})
    both = each.withColumns({f"{x}_hash": F.transform(starts, lambda i: _joint(f"{x}_hash", i)) for x in ("plain", "named")})  # noqa: B023
    spot = lambda x, i: F.struct(i.alias("at"), F.get(f"{x}_hash", i).alias("hash"))
    spots = F.flatten(F.transform(starts, lambda i: F.when(F.get("plain_hash", i) == F.get("named_hash", i), F.array(spot("plain", i))).otherwise(F.array(spot("plain", i), spot("named", i)))))
    # One generator only, so that the whole arrays are not copied for each window.
    return both.select(*keep, "raw", "plain", "named", F.explode(spots).alias("e")).select(*keep, "raw", "plain", "named", F.col("e.at").alias("at"), F.col("e.hash").alias("hash"))


def _short(df: DataFrame, like: str) -> DataFrame:
    """Stage a table that is small beside the documents in a sixteenth of the usual number of files."""
    return stage(df.coalesce(1 + int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16), like)


def _cut(array: str, at: str) -> Column:
    return F.slice(F.col(array), F.col(at) + 1, WINDOW)


def candidates(docs: DataFrame, items: DataFrame, totals: DataFrame, similarity: float) -> DataFrame:
    """``_id, _key`` of the documents that hold the anchor words of enough windows of an item.

    The anchor of a window is the literal word of its template that the fewest items
    have, the longest of these; a document without it cannot match the window.  So the
    anchors a document holds bound what it can cover, and no leak is left out.
    """
    words = F.when(F.col("kind") == "same", F.filter(F.transform("item_raw", _word), lambda w: ~_numeric(w))).otherwise(
        F.filter("item_tpl", lambda w: ~w.isin(*PLACEHOLDERS)))
    rank = F.when(F.col("kind") == "named", 0).when(F.col("kind") == "plain", 1).otherwise(2)
    # The literal words without names are literal in both kinds of a window.
    spots = items.groupBy("item_id", "item_at", "item_raw").agg(
        F.min_by(words, rank).alias("words"), F.max(F.col("kind") == "named").alias("named"), F.max(F.col("kind") != "same").alias("strong"))
    literal = spots.select("item_id", "item_at", "item_raw", "named", "strong", F.explode("words").alias("word"))
    common = literal.groupBy("word").agg(F.count_distinct("item_id").alias("items"))
    anchors = literal.join(common, "word").groupBy("item_id", "item_at", "item_raw", "named", "strong").agg(
        F.min(F.struct("items", (-F.length("word")).alias("short"), "word")).alias("a")).select("item_id", "item_at", "named", "strong", "a.word").distinct()
    anchors = _short(anchors.groupBy("word", "item_id").agg(
        F.sum(F.col("named").cast("int")).alias("n_named"), F.sum(F.col("strong").cast("int")).alias("n"), F.count("*").alias("n_all")), "anchors")
    side = F.broadcast(anchors) if anchors.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else anchors
    every = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)))
    held = (docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.array_distinct(F.transform(every, F.lower))).alias("word"))
            .join(side, "word").groupBy("doc_id", "text_key", "item_id").agg(*[F.sum(c).alias(c) for c in ("n_named", "n", "n_all")]))
    enough = lambda n, total: (F.col(total) > 0) & (F.col(n) / F.col(total) >= similarity)
    found = held.join(totals, "item_id").filter(enough("n_named", "total_named") | enough("n", "total") | enough("n_all", "total_all"))
    return _short(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "anchored")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_key, item_id, coverage, exact`` of every leaked item.

    ``text_key`` is ``xxhash64(text)``; ``exact`` tells whether no slot was refilled.
    """
    literal = F.size(F.filter("item_tpl", lambda w: ~w.isin(*PLACEHOLDERS)))
    cut = windows(benchmark.select("item_id", F.col("text").alias("item_text")), ["item_id"], "item_text")
    kinds = [cut.select("item_id", F.lit(x).alias("kind"), F.col("at").alias("item_at"), _cut("raw", "at").alias("item_raw"), _cut(x, "at").alias("item_tpl")) for x in ("named", "plain")]
    each = kinds[0].union(kinds[1]).distinct().withColumn("_h", F.transform("item_tpl", lambda w: F.xxhash64(w))).withColumn("hash", _joint("_h", F.lit(0))).drop("_h")
    strong = literal >= F.least(F.lit(2), F.size("item_tpl"))
    same = F.lit("same")  # of weak windows, only those with the same words count
    items = _short(each.withColumn("kind", F.when(strong, F.col("kind")).when((F.col("kind") == "plain") & F.exists("item_raw", lambda t: ~_numeric(t)), same)).filter("kind IS NOT NULL"), "item-windows")
    at = lambda *of: F.count_distinct(F.when(F.col("kind").isin(*of), F.col("item_at")))
    totals = items.groupBy("item_id").agg(at("named").alias("total_named"), at("named", "plain").alias("total"), at("named", "plain", "same").alias("total_all"))
    # Windows are made of the documents that can reach an item at all.
    near = candidates(docs, items, totals, similarity)
    docs = stage(docs.select("doc_id", "text").join(near, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_semi"), "near-items")
    known = items.limit(BROADCAST_WINDOWS + 1).count()
    side = F.broadcast(items) if known <= BROADCAST_WINDOWS else items
    doc_tpl = F.when(F.col("kind") == "named", _cut("named", "at")).otherwise(_cut("plain", "at"))
    lower = lambda x: F.transform(x, _word)
    hits = (windows(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), ["doc_id", "text_key"], "text")
            .join(side, "hash").filter(F.col("item_tpl") == doc_tpl)
            .select("doc_id", "text_key", "item_id", "kind", "item_at", "at", "item_tpl", "item_raw", _cut("raw", "at").alias("doc_raw"))
            .filter((F.col("kind") != "same") | (lower(F.col("item_raw")) == lower(F.col("doc_raw")))))
    slots = F.filter(F.arrays_zip("item_tpl", "item_raw", "doc_raw"), lambda s: s["item_tpl"].isin(*PLACEHOLDERS))
    pair = F.transform(slots, lambda s: F.struct(_word(s["item_raw"]).alias("i"), _word(s["doc_raw"]).alias("d")))
    per = lambda kind, c: F.collect_set(F.when(F.col("kind") == kind, F.col(c)))
    flat = lambda kind: F.array_distinct(F.flatten(per(kind, "pair"))).alias(f"pair_{kind}")
    passages = (hits.select("doc_id", "text_key", "item_id", "kind", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", pair.alias("pair"))
                .groupBy("doc_id", "text_key", "item_id", "diagonal")
                .agg(*[per(k, "item_at").alias(k) for k in ("named", "plain", "same")], flat("named"), flat("plain"))
                .withColumn("pair_both", F.array_union("pair_named", "pair_plain")))

    def steady(pairs: str) -> Column:
        fills = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda p: p[side])))
        return (fills("i") == F.size(pairs)) & (fills("d") == F.size(pairs))

    # A passage counts with both kinds of windows, or else with the kind whose slots are filled consistently.
    state = passages.withColumn("both", steady("pair_both")).withColumns({f"ok_{k}": F.col("both") | steady(f"pair_{k}") for k in ("named", "plain")})

    def counted(kind: str, ok: Column, pairs: str) -> Column:
        exact = F.forall(pairs, lambda p: p["i"] == p["d"]).alias("exact")
        return F.when(ok, F.transform(kind, lambda w: F.struct(w.alias("w"), F.lit(kind).alias("kind"), exact))).otherwise(F.array())

    found = [counted("named", F.col("ok_named"), "pair_named"), counted("plain", F.col("ok_plain"), "pair_plain"), counted("same", F.lit(True), "pair_plain")]
    of = lambda *kinds: F.count_distinct(F.when(F.col("f.kind").isin(*kinds), F.col("f.w")))
    covered = (state.select("doc_id", "text_key", "item_id", F.explode(F.concat(*found)).alias("f")).groupBy("doc_id", "text_key", "item_id")
               .agg(of("named").alias("named"), of("named", "plain").alias("n"), of("named", "plain", "same").alias("all"), F.min("f.exact").alias("exact")))
    part = lambda n, total: F.when(F.col(total) > 0, F.col(n) / F.col(total)).otherwise(F.lit(0.0))
    share = F.greatest(part("named", "total_named"), part("n", "total"), part("all", "total_all"))
    return covered.join(totals, "item_id").filter(share >= similarity).select("doc_id", "text_key", "item_id", share.alias("coverage"), "exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    found = leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
