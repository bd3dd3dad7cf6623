"""Join helpers that stay safe when sides or keys grow.

* ``small`` broadcasts a side only after its row count has been checked;
* ``contains_pairs`` finds substring matches with equi-joins, so neither side
  is ever paired with the whole of the other.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import words

# A side of at most this many rows is sent to every task.
BROADCAST_ROWS = 200_000


def known_rows(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> int:
    """Row count of ``df``, read no further than one row beyond the bound; remembered."""
    if getattr(df, "_known_rows", None) is None:
        df._known_rows = df.limit(max_rows + 1).count()
    return df._known_rows


def small(df: DataFrame, like: DataFrame | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``max_rows`` rows.

    ``like`` names a frame that has at least as many rows and may already have
    been counted.  A larger side is returned as it is: the join then shuffles,
    and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if known_rows(df if like is None else like, max_rows) <= max_rows else df


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Give a scan of fewer splits than cores one partition per core.

    A cluster-sized input has more splits than cores and is left alone.  With
    ``rows_per_task``, for steps that cost much per row of a compact table, it gets
    as many partitions as its rows ask for; a scan's rows are counted from its footers.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task is not None:
        n = max(n, -(-df.count() // rows_per_task))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: the one the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine that names neither gets a scratch folder; a
    cluster without a shared folder is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    folder = named or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    Cuts the lineage, survives lost executors, and unlike a checkpointed RDD it
    can be read column by column and has a known size.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_rows(df: DataFrame, key: str, *order: Column | str, name: str = "rank", rows_per_task: int = 500_000) -> DataFrame:
    """Number the rows of each ``key`` from 1 in ``order``; no task sorts more than about ``rows_per_task`` rows.

    Rows are dealt to ranges of (key, order), numbered inside each range, and moved up
    by the rows of the key in the ranges before: a hot key is many ranges.
    """
    staged = materialise(df)
    parts = -(-staged.count() // rows_per_task)
    if parts <= 1:
        return staged.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    ranged = materialise(staged.repartitionByRange(parts, key, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy(key, "range").agg(F.count("*").alias("n")).select(key, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    # As many rows as ranges and keys.
    inside = F.row_number().over(Window.partitionBy("range", key).orderBy(*order))
    return (ranged.repartition(parts, "range", key).withColumn(name, inside).join(small(ahead), [key, "range"])
            .withColumn(name, (F.col(name) + F.col("ahead")).cast("int")).drop("range", "ahead"))


def lower_strip(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _anchors(needles: DataFrame) -> DataFrame:
    """One anchor per needle: the word by which its matches can be found.

    A word with a separator on both sides inside the needle must occur in the
    haystack as a whole word.  Otherwise the first or last word may be the end
    (``tail``), the beginning (``head``) or any part (``part``) of a haystack
    word.  A needle without any word is found by its first character.
    """
    w = words("needle")
    n = F.size(w)
    left_closed = F.substring("needle", 1, 1).rlike("[^a-z0-9]")
    right_closed = F.expr("substring(needle, length(needle), 1)").rlike("[^a-z0-9]")
    closed = F.slice(
        w,
        F.when(left_closed, F.lit(1)).otherwise(F.lit(2)),
        F.greatest(
            F.lit(0),
            n - F.when(left_closed, 0).otherwise(1) - F.when(right_closed, 0).otherwise(1),
        ),
    )
    longest = F.aggregate(
        F.col("closed"), F.lit(""),
        lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best),
    )
    first, last = F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(-1))
    first_longer = F.length(first) >= F.length(last)
    return (
        needles.filter(F.col("needle") != "")
        .withColumn("closed", F.when(n > 0, closed).otherwise(F.array().cast("array<string>")))
        .withColumn(
            "how",
            F.when(n == 0, "mark")
            .when(F.size("closed") > 0, "whole")
            .when((n == 1) & left_closed, "head")
            .when((n == 1) & right_closed, "tail")
            .when(n == 1, "part")
            .when(first_longer, "tail")
            .otherwise("head"),
        )
        .withColumn(
            "anchor",
            F.when(F.col("how") == "mark", F.substring("needle", 1, 1))
            .when(F.col("how") == "whole", longest)
            .when(n == 1, first)
            .when(F.col("how") == "tail", first)
            .otherwise(last),
        )
        .drop("closed")
    )


def candidate_pairs(
    haystacks: DataFrame, needles: DataFrame, hay_id: str, needle_id: str,
) -> DataFrame:
    """``(hay_id, needle_id)`` of every haystack that may contain the needle.

    ``haystacks`` has columns ``hay_id, hay``; ``needles`` has ``needle_id,
    needle``; both lower-case.  No match is missed: each needle is looked up by
    one anchor word that all of its matches must have.
    """
    anchored = materialise(_anchors(needles.select(needle_id, "needle")))
    kinds = {r["how"] for r in anchored.select("how").distinct().collect()}  # at most five
    if not kinds:
        return haystacks.sparkSession.createDataFrame([], T.StructType([haystacks.schema[hay_id], needles.schema[needle_id]]))

    hay_words = haystacks.select(
        hay_id, F.explode(F.array_distinct(words("hay"))).alias("anchor")
    )
    keys = anchored.filter(F.col("how") == "whole").select(needle_id, "anchor")
    partial = anchored.filter(F.col("how").isin("head", "tail", "part"))
    if kinds & {"head", "tail", "part"}:
        keys = keys.unionByName(_partial_words(hay_words, partial, needle_id))
    found = hay_words.join(small(keys), "anchor").select(hay_id, needle_id).distinct()
    if "mark" in kinds:
        marks = anchored.filter(F.col("how") == "mark").select(needle_id, "anchor")
        hay_marks = haystacks.select(
            hay_id,
            F.explode(
                F.array_distinct(F.regexp_extract_all("hay", F.lit(r"([^a-z0-9])")))
            ).alias("anchor"),
        )
        found = found.unionByName(
            hay_marks.join(small(marks), "anchor").select(hay_id, needle_id).distinct()
        )
    return found


def contains_pairs(
    haystacks: DataFrame, needles: DataFrame, hay_id: str, needle_id: str,
) -> DataFrame:
    """All ``(hay_id, needle_id)`` with ``needle`` inside ``hay``, verified on the text."""
    return (
        candidate_pairs(haystacks, needles, hay_id, needle_id)
        .join(small(needles.select(needle_id, "needle")), needle_id)
        .join(haystacks, hay_id)
        .filter(F.expr("instr(hay, needle) > 0"))
        .select(hay_id, needle_id)
    )


def anchored_rows(haystacks: DataFrame, needles: DataFrame, needle_id: str) -> DataFrame:
    """Rows of ``haystacks`` (with their columns and ``hay``) beside each ``needle_id, needle`` whose anchor they hold.

    For needles that can be sent to every task: texts are verified where an anchor
    is found, so no text is shuffled, and equal needles are looked up once.  A row may
    come more than once for a needle that is part of several words.
    """
    anchored = materialise(_anchors(needles.select(needle_id, "needle")))
    whole = anchored.filter(F.col("how") == "whole").select(needle_id, "anchor")
    marks = anchored.filter(F.col("how") == "mark").select(needle_id, "anchor")
    partial = anchored.filter(F.col("how").isin("head", "tail", "part"))
    keys, every = whole.unionByName(marks), words("hay")
    if known_rows(partial):
        vocabulary = haystacks.select(F.explode(F.array_distinct(every)).alias("anchor"))
        keys = keys.unionByName(_partial_words(vocabulary, partial, needle_id))
    if known_rows(marks):
        # Single characters: a few are looked for, many are taken from the text.
        signs = [r[0] for r in marks.select("anchor").distinct().limit(33).collect()]
        every = F.concat(every, F.regexp_extract_all("hay", F.lit(r"([^a-z0-9])")) if len(signs) > 32 else
                         F.array_compact(F.array(*[F.when(F.contains("hay", F.lit(x)), F.lit(x)) for x in signs])))
    texts = needles.select(needle_id, "needle")
    by_anchor = materialise(keys.join(F.broadcast(texts), needle_id))
    return haystacks.withColumn("anchor", F.explode(F.array_distinct(every))).join(small(by_anchor), "anchor").drop("anchor")


def short_contains_pairs(
    haystacks: DataFrame, needles: DataFrame, hay_id: str, needle_id: str, parts: int,
) -> DataFrame:
    """``contains_pairs`` for many short haystacks and few needles.

    A word carries its haystack, so a match is verified where its anchor is found and
    no haystack is shuffled; pairs are dealt by haystack to ``parts`` partitions.
    """
    if known_rows(needles) > BROADCAST_ROWS:
        return contains_pairs(haystacks, needles, hay_id, needle_id)
    anchored = materialise(_anchors(needles.select(needle_id, "needle")))
    hay_words = haystacks.select(hay_id, "hay", F.explode(F.array_distinct(F.concat(
        words("hay"), F.regexp_extract_all("hay", F.lit(r"([^a-z0-9])"))))).alias("anchor"))
    keys = anchored.filter(F.col("how").isin("whole", "mark")).select(needle_id, "anchor")
    partial = anchored.filter(F.col("how").isin("head", "tail", "part"))
    if known_rows(partial):
        keys = keys.unionByName(_partial_words(hay_words.filter(F.col("anchor").rlike("^[a-z0-9]")), partial, needle_id))
    keys = materialise(keys.join(F.broadcast(needles.select(needle_id, "needle")), needle_id))
    found = hay_words.join(small(keys), "anchor").filter(F.expr("instr(hay, needle) > 0")).select(hay_id, needle_id)
    # A word that holds part of a needle may stand beside another one that does.
    return found.repartition(parts, hay_id).distinct()


def _partial_words(hay_words: DataFrame, partial: DataFrame, needle_id: str) -> DataFrame:
    """Expand head, tail and part anchors to the whole words that carry them.

    Words of the vocabulary are keyed by their grams of one to three characters
    and joined to the first gram of each anchor, then checked.
    """
    keyed = partial.select(
        needle_id, "how", F.col("anchor").alias("piece"),
        F.substring("anchor", 1, 3).alias("gram"),
    )
    vocabulary = hay_words.select("anchor").distinct()
    grams = vocabulary.select(
        "anchor",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.length("anchor")),
                        lambda i: F.array(
                            F.substring(F.col("anchor"), i, 1),
                            F.substring(F.col("anchor"), i, 2),
                            F.substring(F.col("anchor"), i, 3),
                        ),
                    )
                )
            )
        ).alias("gram"),
    )
    fits = (
        F.when(F.col("how") == "head", F.expr("startswith(anchor, piece)"))
        .when(F.col("how") == "tail", F.expr("endswith(anchor, piece)"))
        .otherwise(F.expr("contains(anchor, piece)"))
    )
    return grams.join(small(keyed), "gram").filter(fits).select(needle_id, "anchor").distinct()
