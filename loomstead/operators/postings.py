"""A search index that is kept: postings of terms and sizes of documents, built, updated and searched as tables.

``postings`` has ``(project_id, head, term, key, weight)``, a row for each term of a document with its weighted frequency;
``head`` is the first four letters, by which a stored index is bucketed and sorted, so that a search reads the heads it asks for.
``sizes`` has ``(project_id, key, size)``. Figures of a project follow from them, so that an update touches changed documents only.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators.search import B, K1

HEAD = 4


def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks with marks, and the letters below the marks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)) if unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))]
    pairs = [(a, b) for a, b in pairs if a.islower() and b != a]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _plain_letters()


def terms_of(text: Column) -> Column:
    """Terms of a text: runs of letters and digits in lower case, without marks on letters."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _BARE), F.lit(r"([\p{L}\p{N}]+)"), 1)


def build(docs: DataFrame, columns: dict[str, float], *, key: str = "id", project: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """``(postings, sizes)`` of documents; ``columns`` gives the weight of each text column.

    Null texts are empty; a document without terms has a size only. Rows that repeat a key count once. Texts stay where they are: only
    terms, combined per task, are shuffled.
    """
    cut = docs.select(F.col(project).alias("project_id"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("_row"), *[terms_of(F.col(c)).alias(f"_t{i}") for i, c in enumerate(columns)])
    size = reduce(lambda a, b: a + b, [F.size(f"_t{i}") for i in range(len(columns))])
    sizes = cut.groupBy("project_id", "key").agg(F.max(size).cast("long").alias("size"))
    weigh = lambda x: lambda w: F.struct(w.alias("term"), F.lit(float(x)).alias("w"))
    each = F.flatten(F.array(*[F.transform(f"_t{i}", weigh(x)) for i, x in enumerate(columns.values())]))
    spread = cut.select("project_id", "key", "_row", F.explode(each).alias("_x")).select("project_id", "key", "_row", "_x.term", "_x.w")
    postings = spread.groupBy("project_id", "term", "key").agg((F.sum("w") / F.countDistinct("_row")).alias("weight"))
    return postings.select("project_id", F.substring("term", 1, HEAD).alias("head"), "term", "key", "weight"), sizes


def update(index: tuple[DataFrame, DataFrame], changed: DataFrame, columns: dict[str, float], *, key: str = "id", project: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """The index after documents came, changed or went: ``changed`` has their rows as they are now, of a document that went all texts null and ``gone`` true.

    A project that is not named stays as it is; without a ``gone`` column nothing goes.
    """
    touched = changed.select(F.col(project).alias("project_id"), F.col(key).alias("key")).distinct()
    rest = [old.join(touched, ["project_id", "key"], "left_anti") for old in index]
    now = build(changed.where("gone IS NULL OR NOT gone") if "gone" in changed.columns else changed, columns, key=key, project=project)
    return rest[0].unionByName(now[0]), rest[1].unionByName(now[1])


def asked_terms(asks: DataFrame) -> DataFrame:
    """``(request_id, project_id, term, prefix)`` of ``(request_id, project_id, task)`` rows: 24 terms at most, those of four letters and more also as prefixes."""
    tokens = F.regexp_extract_all(F.lower("task"), F.lit("([a-z0-9_$]{2,})"), 1)
    parts = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.filter(F.split(t, r"[_$]+"), lambda p: F.length(p) >= 3))))
    terms = F.slice(F.array_distinct(F.filter(parts, lambda t: ~t.isin(sorted(T.STOPWORDS)))), 1, 24)
    asked = asks.select("request_id", "project_id", F.explode(terms).alias("term"))
    return asked.withColumn("prefix", F.explode(F.when(F.length("term") >= HEAD, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))


def search(index: tuple[DataFrame, DataFrame], asks: DataFrame, *, k: int = 25) -> DataFrame:
    """The ``k`` best documents of each request, within its project: ``(request_id, project_id, key, score, relevance)``.

    Many requests are one plan. A posting meets a request through its head, an exact term through its full length. Relevance is
    the score stretched to 0..1 among the rows of the request, 1 if all are equal, to 4 digits; ties go by key.
    """
    postings, sizes = index
    asked = asked_terms(asks)
    wanted = asked.select("project_id", "term", "prefix").distinct().withColumnRenamed("term", "asked").withColumn("head", F.substring("asked", 1, HEAD))
    met = postings.join(wanted, ["project_id", "head"]).where(F.when(F.col("prefix"), F.col("term").startswith(F.col("asked"))).otherwise(F.col("term") == F.col("asked")))
    hits = met.groupBy("project_id", F.col("asked").alias("term"), "prefix", "key").agg(F.sum("weight").alias("_f"))
    counts = hits.groupBy("project_id", "term", "prefix").agg(F.count("*").alias("_d"))
    figures = sizes.groupBy("project_id").agg(F.count("*").alias("_n"), F.avg("size").alias("_avg"))
    rarity = F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col("_d") + 0.5) / (F.col("_d") + 0.5)))
    saturation = F.col("_f") * (K1 + 1) / (F.col("_f") + K1 * (1 - B + B * F.col("size") / F.col("_avg")))
    weighed = counts.join(figures, "project_id").select("project_id", "term", "prefix", rarity.alias("_rarity"), "_avg")
    scored = hits.join(weighed, ["project_id", "term", "prefix"]).join(sizes, ["project_id", "key"]).select("project_id", "key", "term", "prefix", (F.col("_rarity") * saturation).alias("_s"))
    found = asked.join(scored, ["project_id", "term", "prefix"]).groupBy("request_id", "project_id", "key").agg(F.round(F.sum("_s"), 6).alias("score"))
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "key")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    group = Window.partitionBy("request_id")
    low, high = F.min("score").over(group), F.max("score").over(group)
    return best.withColumn("relevance", F.round(F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)), 4))


def save(index: tuple[DataFrame, DataFrame], folder: str, *, buckets: int = 64) -> None:
    """Write an index into a shared folder: postings in ranges of heads, sorted, so that a search skips what it does not ask for."""
    postings, sizes = index
    postings.repartitionByRange(buckets, "project_id", "head", "term", "key").sortWithinPartitions("project_id", "head", "term").write.mode("overwrite").parquet(f"{folder}/postings")
    sizes.write.mode("overwrite").parquet(f"{folder}/sizes")


def load(spark, folder: str, asks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A stored index; with ``asks`` (a bounded set of requests), only the postings whose heads they ask for are read."""
    postings, sizes = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/sizes")
    if asks is not None:
        heads = sorted(r[0] for r in asked_terms(asks).select(F.substring("term", 1, HEAD)).distinct().limit(2001).collect())
        if len(heads) <= 2000:  # beyond that the join alone picks them
            postings = postings.where(F.col("head").isin(heads))
    return postings, sizes
