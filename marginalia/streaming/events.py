"""Structured Streaming forms (STR1-STR4).

Every stream keeps its progress in a checkpoint folder the caller names, so a
lost executor or driver resumes where it stopped.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marginalia.functions.joins import materialise
from marginalia.operators.board import todo_state
from marginalia.operators.usage import _keys, searches, unfolds
from marginalia.sources.files import EVENT_SCHEMA


def stream_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, fmt: str = "json") -> DataFrame:
    """STR1: append-only event log as a stream."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """STR1: write what is there to parquet and stop."""
    return (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_SLICE_SECONDS = 3600
SIGNAL = "kind string, key string, slice long, event_id long, unfold_time long, search_id long, search_time long, rank long"


class SliceMatcher(StatefulProcessor):
    """Matches unfolds to searches inside one (key, time slice), in whatever order they arrive.

    List states keep the slice's searches and unfolds.  Rows out: ``match``, an
    unfold and the latest earlier search of the slice, again whenever a late
    search changes it; ``end``, the slice's last search, again when it moves;
    ``ask``, an unfold that no search of its slice precedes so far.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._searches = handle.getListState("searches", "time long, id long, rank long")
        self._unfolds = handle.getListState("unfolds", "time long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # The same key twice in one search: its first result counts.
        new: dict[tuple[int, int], int] = {}
        asked = []
        for r in rows:
            at = (r["time"], r["id"])
            if not r["search"]:
                asked.append(at)
            elif at not in new or r["rank"] < new[at]:
                new[at] = r["rank"]
        old = {(t, i): r for t, i, r in self._searches.get()}
        waiting = [(t, i) for t, i in self._unfolds.get()] if new else []
        every = old | new
        order = sorted(every)
        out = []

        def put(kind: str, unfold: tuple | None, search: tuple | None) -> None:
            out.append(Row(kind=kind, key=key[0], slice=key[1], event_id=unfold and unfold[1], unfold_time=unfold and unfold[0],
                           search_id=search and search[1], search_time=search and search[0], rank=every[search] if search else None))

        for u in asked:
            at = bisect.bisect_left(order, u)
            put("match" if at else "ask", u, order[at - 1] if at else None)
        for u in waiting:
            at = bisect.bisect_left(order, u)
            if at and order[at - 1] in new:
                put("match", u, order[at - 1])
        if new and order[-1] in new:
            put("end", None, order[-1])
        if new:
            self._searches.appendList([(t, i, r) for (t, i), r in new.items()])
        if asked:
            self._unfolds.appendList(asked)
        yield from out

    def close(self) -> None:
        pass


def stream_use_signals(events: DataFrame, slice_seconds: int = STREAM_SLICE_SECONDS) -> DataFrame:
    """STR2: rows from which ``latest`` reads the search that each unfold used.

    State is keyed by (target key, time slice), so that a hot key is spread over
    its slices, and a task reads one slice at a time.  Events may come in any order
    and however late: a slice keeps its searches and unfolds, and says so when a
    later arrival changes a match.  What lies between slices is left to ``latest``.
    Sets the session's state store to RocksDB.  Times are microseconds.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    time = F.unix_micros("timestamp").alias("time")
    shown = searches(events).select("event_id", time, F.explode("results").alias("r")).select(
        F.explode(_keys(F.col("r.chunk_id"), F.col("r.source_path"))).alias("key"), "time", F.col("event_id").alias("id"),
        F.coalesce("r.rank", F.lit(0)).alias("rank"), F.lit(True).alias("search"))
    asked = unfolds(events).select(
        F.explode(_keys(F.col("target.chunk_id"), F.col("target.source_path"))).alias("key"), time, F.col("event_id").alias("id"),
        F.lit(0).cast("long").alias("rank"), F.lit(False).alias("search"))
    sliced = shown.union(asked).withColumn("slice", F.floor(F.col("time") / F.lit(slice_seconds * 1_000_000)).cast("long"))
    return sliced.groupBy("key", "slice").transformWithState(SliceMatcher(), SIGNAL, "append", "none")


def latest(signals: DataFrame) -> DataFrame:
    """The search each unfold used, over the rows ``stream_use_signals`` has written.

    Unfolds without a search in their slice take the last one of the nearest
    earlier slice: a window over one row per key and slice.
    """
    found = F.struct(F.col("search_time").alias("time"), F.col("search_id").alias("id"), (-F.col("rank")).alias("back"))
    ends = signals.filter("kind = 'end'").groupBy("key", "slice").agg(F.max(found).alias("end"))
    asks = signals.filter("kind = 'ask'").select("key", "slice", "event_id")
    marks = asks.select("key", "slice").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ends.unionByName(marks).groupBy("key", "slice").agg(F.max("end").alias("end"))
               .withColumn("best", F.last("end", ignorenulls=True).over(earlier)).filter("best IS NOT NULL").select("key", "slice", "best"))
    near = signals.filter("kind = 'match'").select("event_id", found.alias("best"))
    return (near.unionByName(asks.join(carried, ["key", "slice"]).select("event_id", "best"))
            .groupBy("event_id").agg(F.max("best").alias("b")).select("event_id", F.col("b.id").alias("search_id"), (-F.col("b.back")).alias("rank")))


COMPACT_EVERY = 16


def _live_items(spark: SparkSession, folder: str, upto: int, touched: DataFrame | None = None) -> DataFrame:
    """Items alive after batch ``upto``: each one's newest row, unless removed or older than its list's last reset.

    Reads the last compacted state and the changes after it; a missing one is an
    error.  With ``touched`` only those items are looked up.
    """
    base = max(0, upto) // COMPACT_EVERY * COMPACT_EVERY if upto >= COMPACT_EVERY else None
    first = 0 if base is None else base + 1
    read = lambda name, versions: spark.read.option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/version={v}" for v in versions])
    parts = []
    if base is not None:
        parts.append(read("base", [base]))
    if first <= upto:
        parts.append(read("items", range(first, upto + 1)))
    rows = functools.reduce(DataFrame.unionByName, parts)
    key = ["list_id", "item_id"]
    if touched is not None:
        rows = rows.join(touched, key, "left_semi")
    newest = rows.groupBy(*key).agg(F.max_by(F.struct("alive", "title", "completed", "added_seq"), "version").alias("s")).select(*key, "s.*").filter("alive")
    if first <= upto:
        resets = read("resets", range(first, upto + 1)).groupBy("list_id").agg(F.max("reset").alias("reset"))
        # What a reset itself puts in carries the reset's number.
        newest = newest.join(resets, "list_id", "left").filter("reset IS NULL OR added_seq >= reset")
    return newest.select(*key, "title", "completed", "added_seq")


def todo_state_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """STR3: fold each micro-batch of list events into changes under ``folder``.

    A batch writes ``items``, the new state of the items it touches (``alive``
    false for removed ones), and ``resets``, one marker per list that was cleared
    or replaced; items that a reset removes are not written again.  The state of
    the touched items before the batch comes from the changes so far, and every
    ``COMPACT_EVERY`` batches the live items are written as a base, so that a
    lookup reads at most that many changes.  All steps are joins and aggregates:
    no list is held in one task.  A batch that is run again writes the same again.
    Batches follow the order of the log.
    """
    key = ["list_id", "item_id"]

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialise(batch)
        kept = ["list_id", "seq", "kind", "item_id", "title", *(["items"] if "items" in batch.columns else [])]
        rows = batch.select(*kept, F.lit(False).alias("completed"))
        touched = rows.filter(F.col("kind").isin("added", "toggled", "deleted")).select(*key)
        if "items" in kept:
            touched = touched.union(rows.filter("kind = 'replaced'").select("list_id", F.explode("items.id")))
        touched = touched.distinct()
        if batch_id > 0:
            before = _live_items(spark, folder, batch_id - 1, touched)
            rows = before.select("list_id", F.col("added_seq").alias("seq"), F.lit("added").alias("kind"), "item_id", "title", "completed").unionByName(rows, allowMissingColumns=True)
        after = materialise(todo_state(rows))
        gone = touched.join(after, key, "left_anti").select(
            *key, F.lit(None).cast("string").alias("title"), F.lit(False).alias("completed"), F.lit(None).cast(after.schema["added_seq"].dataType).alias("added_seq"), F.lit(False).alias("alive"))
        after.withColumn("alive", F.lit(True)).unionByName(gone).write.mode("overwrite").parquet(f"{folder}/items/version={batch_id}")
        resets = batch.filter(F.col("kind").isin("cleared", "replaced")).groupBy("list_id").agg(F.max("seq").alias("reset"))
        resets.write.mode("overwrite").parquet(f"{folder}/resets/version={batch_id}")
        if batch_id and batch_id % COMPACT_EVERY == 0:
            _compact_items(spark, folder, batch_id)

    return (
        events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _compact_items(spark: SparkSession, folder: str, version: int) -> None:
    """Write the items alive after ``version`` as a base, from the base before it and the changes since."""
    before = _live_items(spark, folder, version - 1)
    last = spark.read.parquet(f"{folder}/items/version={version}")
    resets = spark.read.parquet(f"{folder}/resets/version={version}")
    key = ["list_id", "item_id"]
    old = before.join(last, key, "left_anti").join(resets, "list_id", "left").filter("reset IS NULL OR added_seq >= reset").drop("reset").withColumn("alive", F.lit(True))
    old.unionByName(last.filter("alive")).write.mode("overwrite").parquet(f"{folder}/base/version={version}")


def todo_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The state after the newest batch."""
    newest = spark.read.parquet(f"{folder}/items").agg(F.max("version").alias("v")).first()["v"]
    return _live_items(spark, folder, int(newest))


def stream_changes(notes: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """STR4: hand each batch of new or changed note rows to ``on_batch`` and stop at the end."""
    return (
        notes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_notes(spark: SparkSession, root: str) -> DataFrame:
    """New Markdown files under ``root`` as a stream of raw note rows."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    base = "/" + root.strip("/") + "/"
    return (
        spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.md")
        .option("recursiveFileLookup", "true").load(root)
        .select(F.substring_index("path", base, -1).alias("path"), F.decode("content", "UTF-8").alias("content"),
                F.unix_millis("modificationTime").cast("double").alias("mtime_ms"))
    )
