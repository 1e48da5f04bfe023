"""Filling containers of fixed capacity with whole items.

Method: Karmarkar-Karp multiway differencing. Each item starts as a partial partition with one filled slot; the two
partial partitions of the largest spread are merged with opposing imbalances (the fullest slot of one on the emptiest
of the other) until one is left, whose slots are near-equal windows. The number of windows starts at the lower bound and
rises by one whenever a window exceeds the capacity.

Scale: items are spread over buckets by a hash of their id; a bucket holds about ``windows_per_bucket`` capacities of
tokens and ``items_per_bucket`` items, so each task sees a bounded group whatever the size of the corpus and of its
items, and the number of buckets follows the totals.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import tokens
from loomstead.session import materialise

WINDOWS_PER_BUCKET = 256
ITEMS_PER_BUCKET = 1 << 16


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item after differencing into ``windows`` near-equal windows.

    A partial partition holds only the slots that have items, so that all of them together never have more slots than
    there are items. A slot is a chain of items; two slots are put together by linking their chains.
    """
    count = len(sizes)
    if windows <= 1 or count == 0:
        return np.zeros(count, np.int64)
    following = np.full(count, -1, np.int64)  # the next item of a chain
    end = np.arange(count)  # the last item of the chain that an item begins
    parts: list[tuple[np.ndarray, np.ndarray] | None] = [(sizes[i : i + 1], end[i : i + 1].copy()) for i in range(count)]  # loads in falling order, first items
    heap = [(-int(size), i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        (load, first), (other, second) = parts[i], parts[j]  # type: ignore[misc]
        parts[i] = parts[j] = None
        # the fullest slot of one lies on the emptiest of the other; only so many of them hold items in both
        shared = len(load) + len(other) - windows
        if shared > 0:
            put, onto = second[-shared:][::-1], first[-shared:]
            following[end[onto]] = put
            end[onto] = end[put]
            load = np.concatenate((load[:-shared], load[-shared:] + other[-shared:][::-1], other[:-shared]))
            first = np.concatenate((first, second[:-shared]))
        else:
            load, first = np.concatenate((load, other)), np.concatenate((first, second))
        order = np.argsort(-load, kind="stable")
        load, first = load[order], first[order]
        if len(load) == windows:
            load -= load[-1]
        parts.append((load, first))
        heapq.heappush(heap, (-int(load[0]), len(parts) - 1))
    place = np.zeros(count, np.int64)
    at = parts[-1][1].copy()  # type: ignore[index]
    slot = np.arange(len(at))
    while len(at):  # all chains at once, one link a step
        place[at] = slot
        at = following[at]
        slot, at = slot[at >= 0], at[at >= 0]
    return place


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item (none larger than the capacity); no window exceeds the capacity."""
    sizes = np.asarray(sizes, np.int64)
    full = np.flatnonzero(sizes == capacity)
    rest = np.flatnonzero(sizes != capacity)
    result = np.empty(len(sizes), np.int64)
    windows = 0
    if len(rest):
        own = sizes[rest]
        windows = max(1, -(-int(own.sum()) // capacity), int((own * 2 > capacity).sum()))
        while True:
            place = difference(own, windows)
            if np.bincount(place, weights=own, minlength=windows).max() <= capacity:
                break
            windows += 1
        result[rest] = place
    result[full] = windows + np.arange(len(full))
    return result


def pack_items(items: DataFrame, targets: list[tuple[int, int]], *, windows_per_bucket: int = WINDOWS_PER_BUCKET, items_per_bucket: int = ITEMS_PER_BUCKET) -> DataFrame:
    """Windows of ``(doc_id, n_tokens)`` rows for each ``(target_id, capacity)``.

    Gives ``(target_id, window_id, doc_id, piece, start_token, n_tokens)``. An item larger than the capacity is cut into
    full pieces and a rest, any other stays whole. Items without tokens get a row too (they fill nothing); a null size
    counts as 0; rows that repeat an id are items of their own. No items give an empty result.
    """
    schema = "target_id long, window_id string, doc_id {0}, piece int, start_token long, n_tokens long".format(
        items.schema["doc_id"].dataType.simpleString()
    )
    spark = items.sparkSession
    if not targets:
        return spark.createDataFrame([], schema)
    bad = [c for _, c in targets if c is None or c < 1]
    if bad:
        raise ValueError("capacities must be positive")
    total, rows = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    choices = F.array(*[
        F.struct(
            F.lit(t).cast("long").alias("target_id"), F.lit(c).cast("long").alias("capacity"),
            F.lit(max(1, -(-total // (c * windows_per_bucket)), -(-rows // items_per_bucket))).cast("long").alias("buckets"),
        )
        for t, c in targets
    ])
    sized = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size"), F.explode(choices).alias("t"))
    parts = (
        sized.select(
            "t.*", "doc_id", "size",
            F.explode(F.expr("sequence(0L, greatest(size - 1, 0L) div t.capacity)")).alias("piece"),
        )
        .withColumn("start_token", F.col("piece") * F.col("capacity"))
        .select(
            "target_id", "capacity", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")).alias("bucket"),
            "doc_id", F.col("piece").cast("int").alias("piece"), "start_token",
            F.least(F.col("size") - F.col("start_token"), F.col("capacity")).alias("n_tokens"),
        )
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        place = pack(group["n_tokens"].to_numpy(), int(group["capacity"].iloc[0]))
        group["window_id"] = [f"{group['bucket'].iloc[0]}-{w}" for w in place]
        return group[["target_id", "window_id", "doc_id", "piece", "start_token", "n_tokens"]]

    return parts.groupBy("target_id", "bucket").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, targets: DataFrame, *, vocabulary: str = tokens.VOCABULARY, **options) -> DataFrame:
    """Windows of documents, sized in tokens, for each row of ``targets`` (a fixed, small table of capacities)."""
    counts = materialise(tokens.token_counts(docs, vocabulary=vocabulary))
    rows = targets.where("target_id IS NOT NULL AND capacity_tokens IS NOT NULL").select("target_id", "capacity_tokens").distinct().collect()
    return pack_items(counts, sorted((r[0], r[1]) for r in rows), **options)


def fill(windows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target_id, windows, tokens, fill)``: how much of the capacity of the used windows is filled."""
    per_target = windows.groupBy("target_id", "window_id").agg(F.sum("n_tokens").alias("n")).where("n > 0").groupBy("target_id").agg(
        F.count("*").alias("windows"), F.sum("n").alias("tokens")
    )
    return per_target.join(F.broadcast(targets.select("target_id", "capacity_tokens")), "target_id").select(
        "target_id", "windows", "tokens", F.round(F.col("tokens") / (F.col("windows") * F.col("capacity_tokens")), 6).alias("fill")
    )
