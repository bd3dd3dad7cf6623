"""Mixing sources to target weights by a low-discrepancy schedule.

Targets.  Sources in code-point order take the weights in turn; a target is the
share of its weight in the mix, at most ``REPEATS`` times the source's size, and
what a full source leaves over goes to the others by weight.

Stream.  The documents of a source are shuffled by a keyed digest, laid end to
end and cut into blocks of ``BLOCK`` words (the last one may be shorter).  Every
pass over a source shuffles its blocks anew, the short one last.

Schedule.  Slot ``k`` of the mix has the van der Corput point of ``k``; the
cumulative targets map the point to a source, and the slots of a source are
ranked.  The block with the same rank in the source's passes joins the slot.  The
points leave a source at most a few slots short of its blocks; these close the
mix.  The last block of a source is cut so that its words meet the target, so the
words a source gives are the whole part of its target.

Everything is a column expression.  Running numbers (of documents, blocks, slots)
are formed in buckets of about ``CHUNK`` rows and offset by the sums of earlier
buckets, so that no source is ordered in one task; only tables of one row per
source or bucket are windowed whole.  Nothing is broadcast by hand.

Defined results.  A null text has size 0 and an empty or wordless one too; such
documents are returned with ``taken`` 0.  A null source is a source of its own,
the last one.  Rows without an id, repeated rows and rows that share an id are
documents of their own; equal ones may trade places.  Order and result depend on
ids, sizes and sources alone, so a second run agrees.  An empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stage

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 512  # words
CHUNK = 8_192  # rows that are numbered in one task, about
BITS = 48  # of a point
CELLS = 10  # 2^10 cells in which points meet the sources that cover them
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    sources: DataFrame  # si, source, weight, words, docs, target, quota, blocks, needed, low, high
    placed: DataFrame  # si, source, pos, doc_id, size, start: documents in the order of their stream
    schedule: DataFrame  # position, si, rank, epoch, block, take: the blocks of the mix


def _numbered(rows: DataFrame, by: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """``number`` (from 0) of every row in its group by bucket and ``order``, and running sums before it.

    ``by`` names the group's columns; rows hold their ``bucket``, whose order agrees with ``order``.
    """
    totals = rows.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{out}") for out, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", *(f"_{o}" for o in sums))])
    inside = Window.partitionBy(*by, "bucket").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({"_at": F.row_number().over(inside) - 1, **{f"_{o}_at": F.coalesce(F.sum(c).over(before), F.lit(0)) for o, c in sums.items()}})
    # Written tables are small while packed: sides that grow with the documents are never sent whole.
    return (local.join(offsets.hint("merge"), [*by, "bucket"])
            .withColumns({"number": F.col("_n_before") + F.col("_at"), **{o: F.col(f"_{o}_before") + F.col(f"_{o}_at") for o in sums}})
            .select(*rows.columns, "number", *sums))


def _bucket(digest: Column, buckets: Column) -> Column:
    """Bucket of a hexadecimal digest: its leading bits as a fraction of all buckets."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * buckets).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """``si, source, weight, words, docs, target`` of every source; one row each."""
    every = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    per = per.withColumn("si", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("si") % len(weights) + 1).cast("int")).cast("double")
    per = per.select("si", "source", weight.alias("weight"), "words", "docs", (F.col("words") * repeats).alias("most"))
    budget = F.sum("words").over(every) * F.lit(float(share))
    # In the order of most / weight the full sources come first.
    fullest = every.orderBy(F.col("most") / F.col("weight"), "si")
    left = budget - F.coalesce(F.sum("most").over(fullest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fullest.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("full", left * F.col("weight") >= F.col("most") * rest)
    spare = budget - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    per = per.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * spare / open_weight))
    return per.select("si", "source", "weight", "words", "docs", "target", F.least(F.floor("target"), F.col("most")).cast("long").alias("quota"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, repeats: int = REPEATS, block: int = BLOCK, seed: int = 0) -> Mix:
    """Targets, streams and schedule of a mix of all ``docs``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    t = targets(sizes, weights, share, repeats)
    cum = Window.partitionBy().orderBy("si")
    t = t.withColumns({
        "blocks": F.expr(f"(words + {block - 1}) div {block}"),
        "needed": F.expr(f"CASE WHEN quota > 0 THEN (quota div words) * ((words + {block - 1}) div {block}) + (quota % words + {block - 1}) div {block} ELSE 0L END"),
        "_up": F.sum("target").over(cum), "_all": F.sum("target").over(Window.partitionBy())})
    point = lambda x: F.coalesce(F.floor(F.try_divide(x, F.col("_all")) * F.lit(2.0**BITS)), F.lit(0)).cast("long")
    t = t.withColumns({"low": point(F.coalesce(F.lag("_up").over(cum), F.lit(0.0))), "high": point(F.col("_up"))}).drop("_up", "_all")
    sources = stage(t, "mix-sources")
    return Mix(sources, _placed(sizes, sources, seed), _schedule(sources, block, seed))


def _placed(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = (sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
            .select("s.si", "d.source", "doc_id", "size", digest.alias("digest"), "docs"))
    rows = rows.withColumn("bucket", _bucket(F.col("digest"), F.ceil(F.col("docs") / F.lit(CHUNK)))).drop("docs")
    return stage(_numbered(rows, ["si"], ["digest", "doc_id", "size"], {"start": "size"})
                 .select("si", "source", F.col("number").alias("pos"), "doc_id", "size", "start"), "mix-placed")


def _schedule(sources: DataFrame, block: int, seed: int) -> DataFrame:
    spark = sources.sparkSession
    # Blocks of every pass that the quota reaches, in chunks so that a large source is not generated in one task.
    passes = (sources.filter("quota > 0").select("si", "words", "quota", "blocks", F.explode(F.expr("sequence(0L, (quota - 1) div words)")).alias("epoch"))
              .select("*", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {CHUNK})")).alias("chunk")).repartition("si", "epoch", "chunk")
              .select("*", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(blocks, (chunk + 1) * {CHUNK}) - 1)")).alias("block")).drop("chunk"))
    passes = passes.withColumns({
        "length": F.least(F.lit(block), F.col("words") - F.col("block") * block),
        "digest": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("si").cast("string"), F.col("epoch").cast("string"), F.col("block").cast("string")))})
    count = F.ceil(F.col("blocks") / F.lit(CHUNK))
    # The short block closes its pass.
    short = F.col("length") < block
    passes = passes.withColumns({"bucket": F.when(short, count).otherwise(_bucket(F.col("digest"), count)), "late": short})
    ranked = _numbered(passes, ["si", "epoch"], ["late", "digest", "block"], {"before": "length"})
    take = F.least(F.col("length"), F.col("quota") - F.col("epoch") * F.col("words") - F.col("before"))
    ranked = (ranked.select("si", (F.col("epoch") * F.col("blocks") + F.col("number")).alias("rank"), "epoch", "block", take.alias("take"))
              .filter("take > 0"))
    # Slots: the points of the sequence, each in the source whose part of the cumulative targets covers it.
    slots = int(sources.agg(F.sum("needed")).first()[0] or 0)
    point = F.conv(F.reverse(F.lpad(F.bin("k"), BITS, "0")), 2, 10).cast("long")
    shift = BITS - CELLS
    points = spark.range(slots).select(F.col("id").alias("k")).select("k", point.alias("u")).withColumn("cell", F.shiftright("u", shift))
    cover = (sources.filter("high > low").select("si", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell")))
    hits = (points.join(cover, "cell").filter("u >= low AND u < high")
            .select("si", "k", F.expr(f"k div {CHUNK}").alias("bucket")))
    dealt = _numbered(stage(hits, "mix-slots"), ["si"], ["k"], {}).select("si", F.col("number").alias("rank"), "k")
    return (ranked.join(dealt.hint("merge"), ["si", "rank"], "left")
            .select(F.coalesce("k", F.col("rank") + F.lit(slots)).alias("position"), "si", "rank", "epoch", "block", "take"))


def passages(m: Mix, block: int = BLOCK) -> DataFrame:
    """What each block of the mix reads: ``position, source, doc_id, first_word, n_words`` and the document's place."""
    pieces = _pieces(m, block)
    low, high = F.col("low"), F.least(F.col("high"), F.col("take"))
    return (pieces.join(m.schedule.hint("merge"), ["si", "block"]).filter(high > low)
            .select("position", "si", "source", "pos", "doc_id", (F.col("block") * block + low - F.col("start")).alias("first_word"), (high - low).alias("n_words")))


def _pieces(m: Mix, block: int) -> DataFrame:
    """Documents cut at the borders of blocks; one row without block for a document without words."""
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    return (m.placed.select("*", F.explode_outer(spans).alias("block"))
            .withColumns({"low": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)),
                          "high": F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))}))


def taken(m: Mix, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    words = F.greatest(F.lit(0), F.least(F.col("high"), F.coalesce("take", F.lit(0))) - F.col("low"))
    sums = (_pieces(m, block).join(m.schedule.select("si", "block", "take").hint("merge"), ["si", "block"], "left")
            .groupBy("si", "pos", "doc_id", "size").agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken")))
    return sums.join(m.sources.select("si", F.col("words").alias("source_size"), "target"), "si").select("doc_id", "size", "source_size", "target", "taken")
