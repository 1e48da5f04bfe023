"""Streams: debounced file events, files that really changed, incremental indexing and the activity feed."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstead.functions.text import skip_reason
from loomstead.operators import knowledge


def debounce(events: DataFrame, *, quiet: str = "300 milliseconds", late: str = "10 seconds", ignore: bool = True) -> DataFrame:
    """Bursts of ``(project_id, relative_path, at)`` events as one batch each: ``(project_id, started, ended, paths)``.

    A burst ends when nothing happens for ``quiet``; with ``ignore``, paths that a scan leaves out do not count. Works on a stream (append mode, with a watermark) and on a table.
    """
    wanted = events.where(skip_reason(F.col("relative_path"), F.lit(0)).isNull()) if ignore else events
    timed = wanted.withWatermark("at", late) if wanted.isStreaming else wanted
    return timed.groupBy("project_id", F.session_window("at", quiet).alias("w")).agg(F.array_sort(F.collect_set("relative_path")).alias("paths")).select(
        "project_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths"
    )


def changed_only(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``(project_id, relative_path, hash)`` whose hash differs from the known one; touched files drop out."""
    old = known.select("project_id", "relative_path", F.col("hash").alias("_old"))
    return batch.join(old, ["project_id", "relative_path"], "left").where(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def needs_full_scan(batch: DataFrame) -> DataFrame:
    """``(project_id, full_scan)``: a removal or another branch asks for a full scan. ``batch`` has ``(project_id, kind)``."""
    return batch.groupBy("project_id").agg(F.bool_or(F.col("kind").isin("removed", "branch")).alias("full_scan"))


def index_stream(files: DataFrame, publish: Callable[[DataFrame, int], None], *, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``publish(rows, batch number)`` on each micro-batch; batches are processed in order and retried as they were."""
    writer = files.writeStream.foreachBatch(lambda rows, number: publish(rows, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def open_tree(spark: SparkSession, root: str, project_id: str, *, max_files: int = 1000) -> DataFrame:
    """A stream of the files below a folder as they come or change: ``(project_id, relative_path, at, size, hash)``."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    local = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    return files.select(F.lit(project_id).alias("project_id"), local.alias("relative_path"), F.col("modificationTime").alias("at"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def changed_stream(files: DataFrame) -> DataFrame:
    """Of a stream of ``(project_id, relative_path, at, hash)`` only the rows whose hash differs from the last one of their path.

    The last hash of each path is kept as state, so that touched files do not come through after a restart either. Of several rows of a path in a
    batch the latest counts.
    """
    def last(key, frames, state: GroupState):
        row = max((r for frame in frames for r in frame[["at", "hash"]].itertuples(index=False)), key=lambda r: (r.at, r.hash))
        known = state.get[0] if state.exists else None
        state.update((row.hash,))
        if row.hash != known:
            yield pd.DataFrame({"project_id": [key[0]], "relative_path": [key[1]], "at": [row.at], "hash": [row.hash], "kind": ["changed" if known else "added"]})

    return files.groupBy("project_id", "relative_path").applyInPandasWithState(
        last, "project_id string, relative_path string, at timestamp, hash string, kind string", "hash string", "append", GroupStateTimeout.NoTimeout
    )


def classify(batch: DataFrame) -> DataFrame:
    """``(project_id, mode, paths)`` of a batch of ``(project_id, relative_path, kind)``: a removal or another branch asks for a ``full`` scan, else the changed paths for a ``partial`` one."""
    return batch.groupBy("project_id").agg(
        F.when(F.bool_or(F.col("kind").isin("removed", "branch")), "full").otherwise("partial").alias("mode"), F.array_sort(F.collect_set(F.when(F.col("kind").isin("changed", "added"), F.col("relative_path")))).alias("paths")
    )


def invalidating(publish: Callable[[DataFrame, int], None], read_cache: Callable[[], DataFrame], write_cache: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """``publish`` for :func:`index_stream` that then drops the cached contexts which hold a changed path."""
    def both(rows: DataFrame, number: int) -> None:
        publish(rows, number)
        write_cache(knowledge.invalidate(read_cache(), rows.select("project_id", "relative_path")))

    return both


class Watchers:
    """The streams of a set of projects: started for those that are wanted, stopped for the others."""

    def __init__(self, start: Callable[[str], StreamingQuery]) -> None:
        self.start, self.running = start, {}

    def sync(self, wanted: set[str]) -> tuple[list[str], list[str]]:
        """``(started, stopped)`` projects; a stream that has ended by itself is started again."""
        stopped = [p for p, q in self.running.items() if p not in wanted]
        for project in stopped:
            self.running.pop(project).stop()
        started = sorted(p for p in wanted if p not in self.running or not self.running[p].isActive)
        for project in started:
            self.running[project] = self.start(project)
        return started, sorted(stopped)


def maintenance(spark: SparkSession, task: Callable[[], None], *, every: str = "30 minutes") -> StreamingQuery:
    """Runs ``task`` (expiring records, syncing watchers) again and again until the query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda rows, number: task()).trigger(processingTime=every).start()
