"""Encoding of a corpus with a public byte-level BPE vocabulary, and decoding.

Boundaries come from :mod:`loomstead.llm.pretokenise`; the slices go through pair merging with a cache per worker.
One pass over the rows, no shuffle: the vocabulary (a fixed size of about a megabyte) is the only thing broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import pretokenise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 1 << 20
CHUNK_CHARS = 1 << 21
LONG_PIECE = 48


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging: always the pair of least rank, the leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > LONG_PIECE:
        return _merge_long(parts, ranks)
    found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, rank in enumerate(found):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del found[at]
        if at < len(found):
            found[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            found[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list: n log n for very long pieces."""
    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive = [True] * n

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, parts[i], parts[j]))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j] = a + b, False
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [ranks[parts[i]] for i in range(n) if alive[i]]


class PieceCache(dict):
    """Ids of each piece seen so far; emptied when it holds ``CACHE_ENTRIES``."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        ids = (rank,) if rank is not None else tuple(merge_pairs(raw, self.ranks))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(piece) <= 256:
            self[piece] = ids
        return ids


def encode_batch(texts: list[str | None], cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's ids begin and the last ones end."""
    ids: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < CHUNK_CHARS):
            size += len(texts[end] or "")
            end += 1
        pieces, per_text = pretokenise.pieces([t or "" for t in texts[begin:end]])
        found = list(map(cache.__getitem__, pieces))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = np.concatenate(([0], np.cumsum(sizes)))
        at = np.concatenate(([0], np.cumsum(per_text)))
        counts[begin:end] = total[at[1:]] - total[at[:-1]]
        ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(total[-1])))
        begin = end
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate(([0], np.cumsum(counts)))


_CACHES: dict[int, PieceCache] = {}


def _cache(shared) -> PieceCache:
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared.value)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = PieceCache(shared.value)
    return _CACHES[key]


def encode(docs: DataFrame, *, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """``(doc_id, ids)`` of every row: the tokens of the text, without special tokens.

    With ``offsets`` also the byte at which each token begins in the UTF-8 text. A null or empty text has an empty list.
    Repeated rows are encoded each, rows with a null id too; an empty table gives an empty result; other columns are
    not read. Texts of any length are encoded whole.
    """
    ranks = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key_type = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(shared)
        width = np.zeros(max(cache.ranks.values(), default=0) + 1, np.int64)
        if offsets:
            for token, rank in cache.ranks.items():
                width[rank] = len(token)
        for batch in batches:
            ids, bounds = encode_batch(batch.column(1).to_pylist(), cache)
            where = pa.array(bounds, pa.int32())
            columns = [batch.column(0), pa.ListArray.from_arrays(where, pa.array(ids, pa.int32()))]
            names = ["doc_id", "ids"]
            if offsets:
                place = np.concatenate(([0], np.cumsum(width[ids])))
                base = np.repeat(place[bounds[:-1]], np.diff(bounds))
                columns.append(pa.ListArray.from_arrays(where, pa.array((place[:-1] - base).astype(np.int32))))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {key_type}, ids array<int>" + (", offsets array<int>" if offsets else "")
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; the exact reverse of :func:`encode` for non-null texts."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(vocabulary).items()})
    key_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            texts = [None if ids is None else b"".join(map(token, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {key_type}, text string")


def token_counts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row; 0 for a null or empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    key_type = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(shared)
        for batch in batches:
            _, bounds = encode_batch(batch.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds))], ["doc_id", "n_tokens"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {key_type}, n_tokens long")
