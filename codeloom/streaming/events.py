"""File-event streams: debounce, de-duplication, priority batches and their application to a collection.

Each operator takes a batch or streaming DataFrame of events; the streaming forms
only add watermarks, sinks and triggers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.partitions import spread
from codeloom.schema import EVENT_PRIORITY

EXPIRY_MINUTES, BATCH_SIZE, CAPACITY, CONFIRM_SECONDS, TOMBSTONE_SECONDS, MAX_RETRIES = 60, 10, 1000, 5, 600, 3


def priority_of(kind: Column) -> Column:
    """1 critical to 4 low, fixed by the kind of event."""
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), EVENT_PRIORITY.items(), F.when(F.lit(False), 4)).otherwise(4)


def with_priority(events: DataFrame) -> DataFrame:
    return events.withColumn("priority", priority_of(F.col("event_type")))


def moves_split(events: DataFrame) -> DataFrame:
    """A move becomes a delete of the old path and a create of the new one."""
    moved = (F.col("event_type") == "moved") & F.col("old_path").isNotNull()
    one = lambda kind, path: F.struct(F.lit(kind).alias("event_type"), path.alias("file_path"))
    parts = F.when(moved, F.array(one("deleted", F.col("old_path")), one("created", F.col("file_path")))).otherwise(F.array(F.struct(F.col("event_type").alias("event_type"), F.col("file_path").alias("file_path"))))
    return events.withColumn("__e", F.explode(parts)).withColumns({"event_type": F.col("__e.event_type"), "file_path": F.col("__e.file_path")}).drop("__e")


def converted(events: DataFrame, monitored: Callable[[Column], Column]) -> DataFrame:
    """Events on monitored paths; a move from or to an unmonitored path becomes a create or a delete."""
    here, before = monitored(F.col("file_path")), monitored(F.coalesce("old_path", F.lit("")))
    moved = F.col("event_type") == "moved"
    kind = F.when(moved & here & ~before, "created").when(moved & ~here & before, "deleted").otherwise(F.col("event_type"))
    path = F.when(moved & ~here & before, F.col("old_path")).otherwise(F.col("file_path"))
    return events.withColumns({"event_type": kind, "file_path": path}).where(here | (moved & before))


def debounced(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """file_path, session start and end, the last event of each burst, and how many there were."""
    return (
        events.groupBy("file_path", F.session_window("ts", gap).alias("w"))
        .agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"), F.count("*").alias("events"))
        .select("file_path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_id", "event_type", "ts", "events")
    )


def debounced_stream(events: DataFrame, gap: str = "500 milliseconds", delay: str = "60 minutes") -> DataFrame:
    return debounced(events.withWatermark("ts", delay), gap)


def once_pending(events: DataFrame, delay: str = "60 minutes") -> DataFrame:
    """On a stream: the first event of a path within the watermark delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_path"])


def pending(events: DataFrame) -> DataFrame:
    """On a batch: the last event of each path."""
    w = Window.partitionBy("file_path").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unexpired(events: DataFrame, now: Column, minutes: float = EXPIRY_MINUTES) -> DataFrame:
    return events.where((F.unix_micros(now) - F.unix_micros("ts")) / 60e6 <= minutes)


def batches(events: DataFrame, size: int = BATCH_SIZE, *by: str) -> DataFrame:
    """batch, place and the immediate flag: batches of `size` in order of priority, then time, within each of `by` (a project)."""
    w = Window.partitionBy(*by).orderBy("priority", "ts", "event_id")
    n = F.row_number().over(w) - 1
    out = events.withColumn("batch", F.floor(n / F.lit(size)).cast("int")).withColumn("place", (n % size).cast("int"))
    return out.withColumn("immediate", F.max((F.col("priority") == 1).cast("int")).over(Window.partitionBy(*by, "batch")) == 1)


def admitted(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The first `capacity` events by arrival."""
    return events.orderBy("ts", "event_id").limit(capacity)


def batch_stats(batched: DataFrame, *by: str) -> DataFrame:
    n = lambda p: F.count_if(F.col("priority") == p)
    return batched.groupBy(*by, "batch").agg(F.count("*").alias("events"), F.min("priority").alias("highest"), n(1).alias("critical"), n(2).alias("high"), n(3).alias("medium"), n(4).alias("low"), F.countDistinct("file_path").alias("paths"))


def queue_stats(events: DataFrame, now: Column) -> DataFrame:
    """priority, event_type, events and the average wait in seconds."""
    wait = (F.unix_micros(now) - F.unix_micros("ts")) / 1e6
    return events.groupBy("priority", "event_type").agg(F.count("*").alias("events"), F.round(F.avg(wait), 6).alias("avg_wait"))


def rolling_wait(events: DataFrame, now: Column, *by: str) -> DataFrame:
    wait = (F.unix_micros(now) - F.unix_micros("ts")) / 1e6
    w = Window.partitionBy(*by).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("rolling_wait", F.round(F.avg(wait).over(w), 6))


def last_state(events: DataFrame) -> DataFrame:
    """file_path, exists, changed_at, deleted_at after all events."""
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    out = events.groupBy("file_path").agg(last("event_type").alias("event_type"), F.max("ts").alias("changed_at"))
    gone = F.col("event_type") == "deleted"
    return out.select("file_path", (~gone).alias("exists"), "changed_at", F.when(gone, F.col("changed_at")).alias("deleted_at"))


def tombstones(states: DataFrame, now: Column, seconds: int = TOMBSTONE_SECONDS) -> DataFrame:
    """States without deletions older than the retention."""
    return states.where(F.col("exists") | ((F.unix_micros(now) - F.unix_micros("deleted_at")) / 1e6 <= seconds))


def retried(events: DataFrame) -> DataFrame:
    """Failed events that have a retry left, counted up."""
    return events.where(F.col("retry_count") < F.col("max_retries")).withColumn("retry_count", F.col("retry_count") + 1)


def unconfirmed(emitted: DataFrame, confirmed: DataFrame, now: Column, seconds: int = CONFIRM_SECONDS) -> DataFrame:
    """Events to emit again: no confirmation within the time."""
    late = (F.unix_micros(now) - F.unix_micros("ts")) / 1e6 > seconds
    return emitted.where(late).join(confirmed.select("event_id"), "event_id", "left_anti")


def failure_runs(runs: DataFrame, *by: str) -> DataFrame:
    """run_id and consecutive failures up to each run (ok, at), by gaps and islands."""
    w = Window.partitionBy(*by).orderBy("at", "run_id")
    island = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = runs.withColumn("island", island)
    fails = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(*by, "island").orderBy("at", "run_id").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("failures", F.when(F.col("ok"), F.lit(0)).otherwise(fails)).drop("island")


SHARES = 256


def project_of(events: DataFrame, projects: DataFrame) -> DataFrame:
    """event_id, project: the project with the longest folder that holds the path.

    A path is joined by equality on each of its leading folders, so neither side needs to be small; a folder that holds most paths is dealt out in SHARES.
    """
    parts = F.split("file_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    roots = projects.select("project", F.regexp_replace("root", "/+$", "").alias("folder"))
    roots = roots.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<bigint>")))
    inside = events.select("event_id", F.pmod(F.xxhash64("event_id"), F.lit(SHARES)).cast("bigint").alias("share"), F.explode(folders).alias("folder"))
    inside = spread(inside, "folder", "share").join(spread(roots, "folder", "share"), ["folder", "share"])
    return spread(inside, "event_id").groupBy("event_id").agg(F.max_by("project", F.struct(F.length("folder"), F.col("project"))).alias("project"))


def apply_changes(collection, changes: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> int:
    """One new version: entities of deleted, modified and created paths go, those that parse(paths) finds now come."""
    last = pending(moves_split(changes))
    present = parse(last.where("event_type <> 'deleted'").select("file_path"))
    current = collection.read()
    kept = current.join(last.select("file_path"), "file_path", "left_anti")
    names = collection.schema().names
    return collection._write(kept.select(*names).unionByName(present.select(*names)))


def run_sync(events: DataFrame, collection, parse: Callable[[DataFrame], DataFrame], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Applies each micro-batch to the collection, in order of priority and time; a replayed batch writes the same state again."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply_changes(collection, batch, parse)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
