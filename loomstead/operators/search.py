"""Ranked full-text search: BM25 over weighted columns.

No inverted index is shuffled: one scan computes, per document, its length and the frequency of each query term (at most
24, each exact and as a prefix); a combined aggregate gives document frequencies and average lengths, one row of figures
that the scoring scan carries as literals; the top k are taken per task before they meet.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from loomstead.functions import text as T
from loomstead.session import materialise

K1, B = 1.2, 0.75
# Rows of a project that requests are held against at once.
BLOCK = 65_536


def clauses(query: str) -> list[tuple[str, bool]]:
    """``(term, is_prefix)`` of a query: a term of four letters and more counts exactly and as a prefix."""
    return [c for term in T.query_terms(query) for c in ([(term, False), (term, True)] if len(term) >= 4 else [(term, False)])]


def _frequency(tokens: Column, term: str, prefix: bool) -> Column:
    match = (lambda w: w.startswith(term)) if prefix else (lambda w: w == term)
    return F.size(F.filter(tokens, match))


def search(docs: DataFrame, query: str, columns: dict[str, float], *, k: int = 25, key: str = "id", within: tuple[str, ...] = (), repeated: bool = False) -> DataFrame:
    """The ``k`` best rows for a query, per combination of the ``within`` columns: ``(key, ..., score, relevance)``.

    ``columns`` gives the weight of each searched text column. Relevance is the score stretched to 0..1 among the rows
    returned (1 if all are equal), to 4 digits. Null texts are empty; ties go by key; a query of stop words finds nothing.
    With ``repeated``, rows that repeat a key count once; only their frequencies are shuffled for that, never the texts.
    """
    terms = clauses(query)
    keep = [*within, key]
    if not terms:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0.0).alias("relevance")).limit(0)
    tokens = docs.select(*keep, *[T.words(F.col(c)).alias(f"_t{i}") for i, c in enumerate(columns)])
    weighted = [reduce(lambda a, b: a + b, [_frequency(F.col(f"_t{i}"), t, p) * float(w) for i, w in enumerate(columns.values())]) for t, p in terms]
    size = reduce(lambda a, b: a + b, [F.size(F.col(f"_t{i}")) for i in range(len(columns))])
    rows = tokens.select(*keep, size.alias("_size"), *[x.alias(f"_f{i}") for i, x in enumerate(weighted)])
    if repeated:
        rows = rows.dropDuplicates(keep)
    figures = rows.agg(
        F.count("*").alias("_n"), F.avg("_size").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))]
    ).first()
    hit = reduce(lambda a, b: a | b, [F.col(f"_f{i}") > 0 for i in range(len(terms))])
    saturation = lambda i: F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_size") / F.lit(float(figures["_avg"] or 1.0))))
    rarity = lambda i: F.greatest(F.lit(1e-6), F.lit(math.log((figures["_n"] - figures[f"_d{i}"] + 0.5) / (figures[f"_d{i}"] + 0.5))))
    scored = rows.select(*keep, hit.alias("_hit"), F.round(reduce(lambda a, b: a + b, [rarity(i) * saturation(i) for i in range(len(terms))]), 6).alias("score"))
    if within:
        order = Window.partitionBy(*within).orderBy(F.col("_hit").desc(), F.col("score").desc(), key)
        best = scored.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= k) & F.col("_hit")).drop("_r", "_hit")
        group = Window.partitionBy(*within)
    else:
        # hits are told apart after the limit: a filter below it would have the tokens cut again for every term
        best = scored.orderBy(F.col("_hit").desc(), F.col("score").desc(), key).limit(k).where("_hit").drop("_hit")
        group = Window.partitionBy(F.lit(1))
    low, high = F.min("score").over(group), F.max("score").over(group)
    return best.withColumn("relevance", F.round(F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)), 4))


def _best_of_block(k: int, cap: float | None, shape: pa.Schema, weigh):
    """The function of one block: the ``k`` best sums of each request, to 6 digits, ties by key."""
    def best(posted: pa.Table, asked: pa.Table) -> pa.Table:
        if not posted.num_rows or not asked.num_rows:
            return shape.empty_table()
        order = pc.sort_indices(posted["key"].combine_chunks(), null_placement="at_start").to_numpy()  # strings in binary order
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        held = posted["terms"].combine_chunks()
        owner = pc.list_parent_indices(held).to_numpy()
        terms = held.flatten().dictionary_encode()
        codes = terms.indices.to_numpy(zero_copy_only=False)
        by_term = np.argsort(codes, kind="stable")
        rows = place[owner[by_term]]
        parts = np.ones(len(rows)) if weigh is None else weigh(posted, owner, asked)[by_term]
        ends = np.searchsorted(codes[by_term], np.arange(len(terms.dictionary) + 1))
        # what k rows have from a term alone is met by the k best of any request with it
        kth = [np.partition(parts[i:j], j - i - k)[j - i - k] if j - i >= k else 0.0 for i, j in zip(ends, ends[1:], strict=False)]
        lists = asked["terms"].combine_chunks()
        wanted = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms.dictionary), -1).to_numpy(zero_copy_only=False)
        until = np.searchsorted(pc.list_parent_indices(lists).to_numpy(), np.arange(len(lists) + 1))
        total, most = np.zeros(len(order)), np.inf if cap is None else cap
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in range(len(lists)):
            own = [c for c in wanted[until[n] : until[n + 1]] if c >= 0]
            if not own:
                continue
            total.fill(0.0)
            for c in own:
                total[rows[ends[c] : ends[c + 1]]] += parts[ends[c] : ends[c + 1]]
            least = min(max(kth[c] for c in own), most) - 1e-5
            at = np.flatnonzero(total >= least) if least > 0 else np.flatnonzero(total)
            sums = np.floor(np.minimum(total[at], most) * 1e6 + 0.5)
            if len(at) > k:
                last = np.partition(sums, len(sums) - k)[len(sums) - k]
                above = sums > last
                few = np.sort(np.concatenate([np.flatnonzero(above), np.flatnonzero(sums == last)[: k - above.sum()]]))
                at, sums = at[few], sums[few]
            found.append((n, at, sums / 1e6))
        if not found:
            return shape.empty_table()
        each = pa.array(np.repeat([n for n, _, _ in found], [len(at) for _, at, _ in found]))
        at = pa.array(order[np.concatenate([at for _, at, _ in found])])
        mine = [asked[n].combine_chunks().take(each) for n in ("request_id", "project_id")]
        theirs = [posted[n].combine_chunks().take(at) for n in ("key", *shape.names[3:-1])]
        return pa.Table.from_arrays([*mine, *theirs, pa.array(np.concatenate([x for _, _, x in found]))], schema=shape)

    return best


def best_sums(posted: DataFrame, asks: DataFrame, sizes: DataFrame, key: str, *, k: int, keep: tuple[str, ...] = (), cap: float | None = None, weigh=None) -> DataFrame:
    """``(request_id, project_id, key, ..., sum)``: the ``k`` rows of each request with the largest sums over its terms, to 6 digits and ``cap`` at most, ties by key.

    ``posted`` has ``(project_id, key, terms)``, each key once a project, and the ``keep`` columns; ``asks`` has ``(request_id, project_id, terms)``, ``sizes`` the
    number of rows ``_n`` of each project. A term counts 1, or what ``weigh(posted, owner, asked)`` gives for each term of the tables of a block, ``owner`` being
    the rows of the terms; that is over 0. Requests meet the rows of their project in blocks, where sums are made in memory: no pair is shuffled but the ``k`` best of each block.
    """
    parts = F.broadcast(sizes.select("project_id", F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK)).cast("int").alias("_blocks")))
    rows = posted.where(F.size("terms") > 0).join(parts, "project_id").withColumn("_block", F.pmod(F.hash(key), F.col("_blocks"))).drop("_blocks").withColumnRenamed(key, "key")
    asked = asks.join(parts, "project_id").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    kinds = [(n, asks.schema[n].dataType) for n in ("request_id", "project_id")] + [(n, posted.schema[n].dataType) for n in (key, *keep)] + [("sum", DoubleType())]
    shape = StructType([StructField(*x) for x in kinds])
    blocks = rows.groupBy("project_id", "_block").cogroup(asked.groupBy("project_id", "_block")).applyInArrow(_best_of_block(k, cap, to_arrow_schema(shape), weigh), shape)
    order = Window.partitionBy("request_id").orderBy(F.col("sum").desc(), key)
    return blocks.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _told(posted: pa.Table, owner: np.ndarray, asked: pa.Table) -> np.ndarray:
    """What each term of each row adds to the score: exact and as a prefix."""
    flat = lambda table, name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    terms, known = flat(posted, "terms"), flat(asked, "terms")
    size, average = posted["_size"].to_numpy()[owner], asked["_avg"][0].as_py()
    told = np.zeros(len(terms))
    for i in (0, 1):
        rarity = np.zeros(max(terms.max(), known.max()) + 1)
        rarity[known] = flat(asked, f"_r{i}")
        f = flat(posted, f"_f{i}")
        told += np.where(f > 0, rarity[terms] * (f * (K1 + 1) / (f + K1 * (1 - B + B * size / average))), 0.0)
    return told


def search_many(asks: DataFrame, docs: DataFrame, columns: dict[str, float], *, k: int = 20, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``search`` for many requests at once, each within its project: ``(request_id, project_id, key, ..., score, relevance)``.

    ``asks`` has ``(request_id, project_id, task)``, ``docs`` ``project_id``, the key, the searched columns and those to ``keep``, which the key settles.
    Terms are those of ``clauses``; figures are those of the project. The terms are broadcast; only tokens that some request asks for are shuffled, and
    no pairs of requests and rows but the best (``best_sums``). The texts are cut once; the result is computed at the call and kept.
    """
    tokens = F.regexp_extract_all(F.lower("task"), F.lit("([a-z0-9_$]{2,})"), 1)
    parts = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.filter(F.split(t, r"[_$]+"), lambda p: F.length(p) >= 3))))
    terms = F.slice(F.array_distinct(F.filter(parts, lambda t: ~t.isin(sorted(T.STOPWORDS)))), 1, 24)
    asked = asks.where("project_id IS NOT NULL").select("request_id", "project_id", F.explode(terms).alias("term"))
    # the terms of a project have numbers; every row holds the empty word once beside its own, so that the figures of a project come from the same pass
    named = asked.groupBy("project_id").agg(F.array_sort(F.collect_set("term")).alias("_all")).select("project_id", F.posexplode("_all").alias("_id", "term"))
    wanted = named.withColumn("prefix", F.explode(F.when(F.length("term") >= 4, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    wanted = wanted.unionByName(named.select("project_id", F.lit(-1).alias("_id"), F.lit("").alias("term"), F.lit(False).alias("prefix")).distinct())
    cut = docs.select("project_id", key, *keep, *[T.words(F.col(c)).alias(f"_t{i}") for i, c in enumerate(columns)])
    weigh = lambda x: lambda w: F.struct(w.alias("word"), F.lit(float(x)).alias("w"))
    cut = cut.select("project_id", key, *keep, F.flatten(F.array(*[F.transform(f"_t{i}", weigh(x)) for i, x in enumerate(columns.values())])).alias("_each"))
    size = F.size("_each")
    spread = cut.select("project_id", key, *keep, size.alias("_size"), F.explode(F.concat("_each", F.array(F.struct(F.lit("").alias("word"), size.cast("double").alias("w"))))).alias("_x"))
    # the head of a term of under four letters is the term, so that it meets only the equal word
    heads = F.broadcast(wanted.withColumn("_head", F.substring("term", 1, 4)))
    met = spread.select("project_id", key, *keep, "_size", "_x.word", "_x.w").withColumn("_head", F.substring("word", 1, 4)).join(heads, ["project_id", "_head"])
    met = met.where(F.when(F.col("prefix"), F.col("word").startswith(F.col("term"))).otherwise(F.col("word") == F.col("term")))
    sums = [F.coalesce(F.sum(F.when(F.col("prefix") == p, F.col("w"))), F.lit(0.0)) for p in (False, True)]
    hits = met.groupBy("project_id", key, *keep, "_id").agg(sums[0].alias("_f0"), sums[1].alias("_f1"), F.first("_size").alias("_size"), F.count("*").alias("_rows"))
    listed = F.collect_list(F.when(F.col("_id") >= 0, F.struct("_id", "_f0", "_f1")))
    own = lambda c: F.sum(F.when(F.col("_id") < 0, F.col(c))).alias(c)
    hits = hits.groupBy("project_id", key, *keep).agg(listed.alias("_t"), F.first("_size").alias("_size"), own("_rows"), own("_f0")).persist(StorageLevel.DISK_ONLY)
    try:
        figures = hits.groupBy("project_id").agg(F.sum("_rows").alias("_n"), (F.sum("_f0") / F.sum("_rows")).alias("_avg"))
        counts = hits.select("project_id", F.inline("_t")).groupBy("project_id", "_id").agg(F.count_if(F.col("_f0") > 0).alias("_d0"), F.count_if(F.col("_f1") > 0).alias("_d1"))
        rarity = lambda i: F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))).alias(f"_r{i}")
        rare = counts.join(F.broadcast(named), ["project_id", "_id"]).join(F.broadcast(figures), "project_id").select("project_id", "term", "_id", "_avg", rarity(0), rarity(1))
        asked = asked.join(F.broadcast(rare), ["project_id", "term"]).groupBy("request_id", "project_id").agg(
            F.first("_avg").alias("_avg"), *[F.collect_list(c).alias(n) for c, n in (("_id", "terms"), ("_r0", "_r0"), ("_r1", "_r1"))]
        )
        posted = hits.select("project_id", key, *keep, "_size", F.col("_t._id").alias("terms"), "_t._f0", "_t._f1")
        best = materialise(best_sums(posted, asked, figures, key, k=k, keep=keep, weigh=_told).withColumnRenamed("sum", "score"))
    finally:
        hits.unpersist()
    group = Window.partitionBy("request_id")
    low, high = F.min("score").over(group), F.max("score").over(group)
    return best.withColumn("relevance", F.round(F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)), 4))


def merge_ranked(first: DataFrame, second: DataFrame, *, k: int = 25) -> DataFrame:
    """Two ranked lists of ``(kind, id, relevance)`` as one; the first list wins ties."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    return both.orderBy(F.col("relevance").desc(), "_o", "id").limit(k).drop("_o")
