"""Activity sessions: runs of events of one entity that no pause longer than a gap interrupts.

Method: occupancy bitmaps. Time is cut into ticks of a fraction of the gap and blocks of many ticks. Per entity and
block the occupied ticks form one bitmap, which is closed with a gap-sized element by doubling shifts (log2 of the
radius shift-or steps instead of one per tick); runs of the closed bitmap are joined with the counts and the first
and last event of their ticks. The element is the largest that can only join events at most a gap apart, so the
remaining decisions, between neighbouring runs, compare exact microsecond endpoints and the result is exact.

Scale: rows are pre-aggregated to (entity, tick) with a map-side combine before they meet, so the size of any group
follows the calendar (ticks per block), never the number of rows; a hot entity spreads over its blocks. Only runs
that touch a block border, at most two a block, meet in the window of their entity to be stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.session import utc_micros

HALF_HOUR_US = 30 * 60 * 1_000_000
TICKS_PER_GAP = 64
BLOCK_GAPS = 336  # a block of 336 gaps is a week at half an hour
SLICE = 512  # blocks that share a bitmap


def close_right(bits: int, reach: int) -> int:
    """``bits`` with every set bit spread ``reach`` places upwards, by doubling shifts."""
    covered = 0
    while covered < reach:
        step = min(covered + 1, reach - covered)
        bits |= bits << step
        covered += step
    return bits


def _places(bits: int) -> np.ndarray:
    """Places of the set bits; only words that are not zero are looked into."""
    words = np.frombuffer(bits.to_bytes((bits.bit_length() // 64 + 1) * 8, "little"), np.uint64)
    used = np.flatnonzero(words)
    word, bit = np.nonzero(np.unpackbits(words[used].view(np.uint8), bitorder="little").reshape(-1, 64))
    return used[word] * 64 + bit


def bitmap_runs(ticks: np.ndarray, reach: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last occupied tick of each run of the closed bitmap; ``ticks`` is sorted, distinct, below ``width``."""
    words = np.zeros(width // 64 + 1, np.uint64)
    word, first = np.unique(ticks >> 6, return_index=True)
    words[word] = np.bitwise_or.reduceat(np.uint64(1) << (ticks & 63).astype(np.uint64), first)
    closed = close_right(int.from_bytes(words.tobytes(), "little"), reach)
    starts = _places(closed & ~(closed << 1))
    last = np.append(np.searchsorted(ticks, starts)[1:], len(ticks)) - 1
    return starts, ticks[last]


def block_runs(block, ticks, first_us, last_us, counts, *, gap_us: int, reach: int, width: int):
    """Runs of many blocks as arrays (block, start_us, end_us, n_events); ``block`` numbers the block of each tick.

    The blocks lie side by side in one bitmap, further apart than the closing reaches.
    """
    stride = width + reach + 1
    key = block * stride + ticks
    order = np.argsort(key, kind="stable")
    key, block, first_us, last_us, counts = key[order], block[order], first_us[order], last_us[order], counts[order]
    starts, _ = bitmap_runs(key, reach, int(key[-1]) + 1)
    head = np.searchsorted(key, starts)
    tail = np.append(head[1:], len(key)) - 1
    start_us, end_us, of = first_us[head], last_us[tail], block[head]
    events = np.add.reduceat(counts, head)
    begin = np.flatnonzero(np.concatenate(([True], (start_us[1:] - end_us[:-1] > gap_us) | (of[1:] != of[:-1]))))
    finish = np.append(begin[1:], len(of)) - 1
    return of[begin], start_us[begin], end_us[finish], np.add.reduceat(events, begin)


def sessionize(
    events: DataFrame,
    *,
    at: str = "at",
    agent: str = "agent",
    project: str = "project_id",
    id: str = "id",
    gap_us: int = HALF_HOUR_US,
) -> DataFrame:
    """Sessions ``(agent, project_id, start_us, end_us, n_events)`` of each agent in each project.

    Rows with a null time, agent or project are left out; agents are lower-cased and trimmed (an agent of blanks
    stays, as the empty name). Each id counts once, at its earliest time; rows with a null id count once per distinct
    time, agent and project. Repeated rows change nothing, ties in time fall into one tick, an empty table gives an
    empty result, and other columns of the input, whatever their names, are not read.
    """
    if gap_us < 1:
        raise ValueError("gap_us must be positive")
    tick = max(1, gap_us // TICKS_PER_GAP)
    reach = max(0, (gap_us + 1) // tick - 2)  # joins ticks d apart only if (d + 1) * tick - 1 <= gap
    width = BLOCK_GAPS * max(1, gap_us // tick)

    rows = (
        events.select(
            F.col(id).alias("id"),
            utc_micros(F.col(at)).alias("us"),
            F.lower(F.trim(F.col(agent))).alias("agent"),
            F.col(project).alias("project_id"),
        )
        .where("us IS NOT NULL AND agent IS NOT NULL AND project_id IS NOT NULL")
        .withColumn("fact", F.struct("us", "agent", "project_id"))
    )
    once = (
        rows.groupBy("id", F.when(F.col("id").isNull(), F.col("fact")).alias("unnamed"))
        .agg(F.min("fact").alias("fact"))
        .select("fact.*")
    )
    cells = (
        once.withColumn("tick", F.expr(f"us div {tick} - if(us < 0 AND us % {tick} <> 0, 1, 0)"))
        .groupBy("agent", "project_id", "tick")
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))
        .withColumn("block", F.expr(f"tick div {width} - if(tick < 0 AND tick % {width} <> 0, 1, 0)"))
    )
    blocks = cells.groupBy("agent", "project_id", "block").agg(
        F.collect_list(F.struct((F.col("tick") - F.col("block") * width).alias("tick"), "first_us", "last_us", "n")).alias("cells")
    ).select(
        "agent", "project_id", "block",
        F.col("cells.tick").alias("ticks"), F.col("cells.first_us").alias("firsts"),
        F.col("cells.last_us").alias("lasts"), F.col("cells.n").alias("counts"),
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            sizes = np.diff(batch.column("ticks").offsets.to_numpy())
            flat = [batch.column(name).flatten().to_numpy() for name in ("ticks", "firsts", "lasts", "counts")]
            of, start, end, n = block_runs(np.repeat(np.arange(len(sizes)), sizes), *flat, gap_us=gap_us, reach=reach, width=width)
            low = batch.column("block").to_numpy()[of] * width * tick
            is_open = (start - gap_us < low) | (end + gap_us >= low + width * tick)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name).take(pa.array(of)) for name in ("agent", "project_id")], pa.array(start), pa.array(end), pa.array(n), pa.array(is_open)],
                ["agent", "project_id", "start_us", "end_us", "n_events", "open"],
            )

    found = blocks.mapInArrow(
        runs, "agent string, project_id string, start_us long, end_us long, n_events long, open boolean"
    )
    return stitch(found, gap_us)


def stitch(runs: DataFrame, gap_us: int) -> DataFrame:
    """Join runs that touch a block border with their neighbours; a closed run is a group of its own.

    Runs are read once: the window and the grouping share one exchange, by entity for open runs and by run for closed ones.
    """
    keys = ["agent", "project_id", "own"]
    entity = Window.partitionBy(*keys).orderBy("start_us")
    return (
        runs.withColumn("own", F.when(~F.col("open"), F.col("start_us")))
        .withColumn("apart", F.coalesce(F.col("start_us") - F.lag("end_us").over(entity) > gap_us, F.lit(True)))
        .withColumn("session", F.sum(F.col("apart").cast("long")).over(entity))
        .groupBy(*keys, "session")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"))
        .select("agent", "project_id", "start_us", "end_us", "n_events")
    )
