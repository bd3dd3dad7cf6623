"""Filter interaction audit by forward-backward path counting on the subset lattice.

A set of filters applied so far is a state; applying one more filter is an edge.
Every document is reduced to the set of filters it fails, and documents are
counted per part and failure set, so what an edge removes, finds removed already
or keeps is a sum over failure sets.  ``forward`` counts the orders that reach a
state, ``backward`` the orders that leave it for the full set; an edge lies on
``forward * backward`` orders, which weighs its removals for the Shapley sums.
The steps of each single order are read from the same edges.

The lattice depends on the filters alone (``2^n`` states, ``n 2^(n-1)`` edges, at
most ``MOST`` filters), so its tables have a fixed size.  Documents shuffle as
digests of about 60 bytes: once by document, once by text and part after partial
sums, and once by text with at most one row per text and part.

Defined results.  A null text is empty, a null part is the empty string.  Texts
are compared by their SHA-256.  A row fails ``repeats`` when another row anywhere
in the table holds the same text under a smaller id, removed or not; rows without
an id never fail it.  Repeated rows of one id count as often as they occur.
Labels of one id that differ count as good or toxic if one of them is.  Tables
without rows give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST = 7  # filters; 5,040 orders
REPEATS = "repeats"  # stands for the table-wide test in a list of filters
SALTS = 4096
SPACE = r"[\x20\x09-\x0D]+"


def standard_filters(text: Column, words: Column) -> dict[str, Column | str]:
    """The failure conditions by letter: short, repetitive, shouting, marked up, repeated text."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        "C": F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(2) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": REPEATS,
    }


def lattice(spark: SparkSession, letters: list[str]) -> tuple[DataFrame, DataFrame]:
    """``edges`` (state, letter, bit, after, weight) and ``steps`` (filter_order, step, state, letter)."""
    if len(letters) > MOST:
        raise ValueError(f"at most {MOST} filters")
    bits = {x: 1 << i for i, x in enumerate(letters)}
    full = (1 << len(letters)) - 1
    forward, backward = {0: 1}, {full: 1}
    for state in range(1, full + 1):
        forward[state] = sum(forward[state & ~b] for b in bits.values() if state & b)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | b] for b in bits.values() if not state & b)
    edges = [(s, x, b, s | b, forward[s] * backward[s | b]) for s in range(full + 1) for x, b in bits.items() if not s & b]
    steps = []
    for order in permutations(letters):
        state = 0
        for i, x in enumerate(order):
            steps.append(("".join(order), i + 1, state, x))
            state |= bits[x]
    return (spark.createDataFrame(edges, "state int, letter string, bit int, after int, weight long"),
            spark.createDataFrame(steps, "filter_order string, step int, state int, letter string"))


def failure_counts(docs: DataFrame, labels: DataFrame, filters=standard_filters, part: str = "source") -> tuple[DataFrame, list[str]]:
    """``part, mask, n, good, toxic``: documents per part and failure set (bit i: the i-th letter)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tests = filters(F.col("text"), F.col("words"))
    letters = list(tests)
    mask = F.lit(0)
    repeat_bit = 0
    for i, (_, test) in enumerate(tests.items()):
        if isinstance(test, str):
            repeat_bit = 1 << i
        else:
            mask = mask + F.when(F.coalesce(test, F.lit(False)), 1 << i).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("body"), mask.cast("int").alias("mask"))
    rows = rows.groupBy("doc_id", "part", "body", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
             .withColumn("salt", F.lit(0)))
    # Rows without an id have no label; a salt keeps them apart.
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("body", "part"), F.lit(SALTS)).cast("int")).otherwise(0))
    rows = (rows.join(marks, ["doc_id", "salt"], "left")
            .select("part", "body", "mask", "doc_id", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]))
    kinds = ["n", "good", "toxic"]
    if not repeat_bit:
        return rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in kinds]), letters
    # One row per text and part: all rows with an id, those of the smallest id, those without one.
    named = F.col("doc_id").isNotNull()
    per = rows.groupBy("body", "part", "mask").agg(
        F.min("doc_id").alias("first_id"),
        *[F.sum(F.when(named, F.col(c)).otherwise(0)).alias(c) for c in kinds],
        *[F.sum(F.when(named, 0).otherwise(F.col(c))).alias(f"{c}_unnamed") for c in kinds],
        *[F.min_by(F.when(named, F.col(c)), F.col("doc_id")).alias(f"{c}_first") for c in kinds])
    leads = F.col("first_id") == F.min("first_id").over(Window.partitionBy("body"))
    passing = {c: F.when(leads, F.coalesce(F.col(f"{c}_first"), F.lit(0))).otherwise(0) for c in kinds}
    split = per.select("part", "mask", *[passing[c].alias(f"{c}_pass") for c in kinds], *kinds, *[f"{c}_unnamed" for c in kinds])
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *[(F.col(f"{c}_pass") + F.col(f"{c}_unnamed")).alias(c) for c in kinds]),
        F.struct((F.col("mask") + repeat_bit).alias("mask"), *[(F.col(c) - F.col(f"{c}_pass")).alias(c) for c in kinds]))
    return (split.select("part", F.inline(both)).groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in kinds])), letters


def edge_table(counts: DataFrame, edges: DataFrame, n_filters: int) -> DataFrame:
    """Per part and edge: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (the filter's)."""
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    before = F.col("mask").bitwiseAND(F.col("state")) != 0
    # Fixed size: failure sets times edges, at most 57,344 rows of flags.
    meets = (edges.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))).alias("mask"))
             .select("mask", "state", "letter", "weight", (F.col("mask").bitwiseAND(F.col("after")) == 0).cast("int").alias("stays"),
                     (fails & ~before).cast("int").alias("goes"), (fails & before).cast("int").alias("gone"), (F.col("mask") == F.col("bit")).cast("int").alias("alone")))
    total = lambda flag, c="n": F.sum(F.col(flag) * F.col(c)).cast("long")
    table = (counts.join(F.broadcast(meets), "mask").groupBy("part", "state", "letter", "weight")
             .agg(total("stays").alias("kept"), total("goes").alias("removed"), total("gone").alias("redundant"), total("alone").alias("unique_fails"),
                  total("goes", "good").alias("good_lost"), total("goes", "toxic").alias("toxic_lost")))
    of_filter = Window.partitionBy("part", "letter")
    return table.withColumn("shapley", F.sum(F.col("weight") * F.col("removed")).over(of_filter)).drop("weight")


def audit(docs: DataFrame, labels: DataFrame, filters=standard_filters, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; see the module."""
    counts, letters = failure_counts(docs, labels, filters, part)
    edges, steps = lattice(docs.sparkSession, letters)
    return (edge_table(counts, edges, len(letters)).join(F.broadcast(steps), ["state", "letter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
