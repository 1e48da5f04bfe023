"""Token-budgeted context for requests: evidence, graph expansion, ranking and the budget fill.

A batch of requests is one DataFrame: every frame carries ``request_id``, so that a thousand requests over many
projects are one plan. Contents join only after ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import detect_intent, estimate_tokens, looks_like_test, redact, request_paths, request_symbols, request_terms
from loomstead.operators.search import best_sums, search_many

# The weight of each kind of evidence.
WEIGHTS = {"explicit": 1.0, "symbol": 0.9, "pathMatch": 0.85, "search": 0.7, "memory": 0.6, "dependency": 0.4, "recent": 0.3, "test": 0.25}


def rank_decay(strength_order: Column) -> Column:
    """Strength of the n-th hit of a ranked list, counted from 0."""
    return F.greatest(F.lit(0.0), 1 - strength_order * 0.08)


def combine(evidence: DataFrame) -> DataFrame:
    """``(request_id, path, score, reasons)`` of ``(request_id, path, component, strength, reason)`` rows.

    The strongest evidence of each kind counts, weighted; at most four reasons are kept.
    """
    best = evidence.groupBy("request_id", "path", "component").agg(F.max("strength").alias("strength"), F.max_by("reason", F.struct("strength", "reason")).alias("reason"))
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    part = weight[F.col("component")] * F.col("strength")
    return best.groupBy("request_id", "path").agg(
        F.round(F.sum(part), 6).alias("score"),
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct(part.alias("s"), "reason")), asc=False), lambda x: x["reason"]), 1, 4).alias("reasons"),
    )


def expand(scored: DataFrame, edges: DataFrame, *, seeds: int = 6, depth: int = 1) -> DataFrame:
    """Evidence from the neighbours of the best seeds: strength 1 / (level + 1) at each level.

    ``edges`` has ``(source, target)`` paths; both directions count.
    """
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "path")
    front = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seeds).select("request_id", "path")
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    found = None
    for level in range(1, max(0, min(3, depth)) + 1):
        front = front.join(both, front["path"] == both["source"]).select("request_id", F.col("target").alias("path")).distinct()
        rows = front.select("request_id", "path", F.lit("dependency").alias("component"), F.lit(1.0 / (level + 1)).alias("strength"), F.lit("close in the import graph").alias("reason"))
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else scored.select("request_id", "path", F.lit("dependency").alias("component"), F.lit(0.0).alias("strength"), F.lit("").alias("reason")).limit(0)


# The best files of a request, whose neighbours are looked at.
SEEDS = 6


def neighbours(scored: DataFrame, edges: DataFrame, *, seeds: int = SEEDS) -> DataFrame:
    """Evidence from the direct neighbours of the best seeds, within the project of each request.

    ``scored`` has ``(request_id, project_id, intent, path, score)``, ``edges`` ``(project_id, source, target)`` paths, the source importing
    the target. A test that imports a seed counts as ``test``, and only for requests about tests or bugs.
    """
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "path")
    front = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seeds).select("request_id", "project_id", "intent", "path")
    imported = front.join(edges.withColumnRenamed("source", "path"), ["project_id", "path"]).select("request_id", F.col("target").alias("path"), F.lit("dependency").alias("component"), F.lit("imported by a file found").alias("reason"))
    importing = front.join(edges.withColumnRenamed("target", "path"), ["project_id", "path"]).withColumn("_test", looks_like_test(F.col("source"))).where(~F.col("_test") | F.col("intent").isin("test", "debug")).select(
        "request_id", F.col("source").alias("path"), F.when(F.col("_test"), "test").otherwise("dependency").alias("component"), F.when(F.col("_test"), "tests a file found").otherwise("imports a file found").alias("reason")
    )
    return imported.unionByName(importing).distinct().select("request_id", "path", "component", F.lit(0.5).alias("strength"), "reason")


def named_symbols(asks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Evidence from symbols that a request names, five a name: 1 where the name is equal, 0.7 where it is but for case or the qualifier."""
    names = asks.select("request_id", "project_id", F.explode(request_symbols(F.col("task"))).alias("wanted")).withColumn("_low", F.lower("wanted"))
    held = symbols.select("project_id", "id", "path", "name", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("_low"))
    order = Window.partitionBy("request_id", "wanted").orderBy((F.col("name") == F.col("wanted")).desc(), "id")
    best = names.join(held, ["project_id", "_low"]).withColumn("_r", F.row_number().over(order)).where("_r <= 5")
    return best.select("request_id", "path", F.lit("symbol").alias("component"), F.when(F.col("name") == F.col("wanted"), 1.0).otherwise(0.7).alias("strength"), F.concat(F.lit("defines "), F.col("name")).alias("reason"))


def named_paths(asks: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence from files of the project whose path a request spells out."""
    found = asks.select("request_id", "project_id", F.explode(F.transform(request_paths(F.col("task")), lambda p: F.regexp_replace(p, r"^\./", ""))).alias("path"))
    return found.join(files.select("project_id", "path").distinct(), ["project_id", "path"]).select("request_id", "path", F.lit("explicit").alias("component"), F.lit(1.0).alias("strength"), F.lit("named in the request").alias("reason"))


def words_in_paths(asks: DataFrame, files: DataFrame, *, per_term: int = 6) -> DataFrame:
    """Evidence from files whose path holds a word of a request of four letters and more: of each word the ``per_term`` shortest paths, with falling strength.

    The paths of a word are ranked once a project, before requests come to them, so that a word that stands everywhere stays as short as any other.
    """
    terms = asks.select("request_id", "project_id", F.explode(F.filter(request_terms(F.col("task")), lambda w: F.length(w) >= 4)).alias("word"))
    held = files.select("project_id", "path", F.explode(F.array_distinct(F.split(F.lower("path"), "[^a-z0-9]+"))).alias("word")).distinct()
    order = Window.partitionBy("project_id", "word").orderBy(F.length("path"), "path")
    few = held.join(terms.select("project_id", "word").distinct(), ["project_id", "word"], "left_semi").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_term)
    return terms.join(few, ["project_id", "word"]).select("request_id", "path", F.lit("pathMatch").alias("component"), rank_decay(F.col("_r") - 1).alias("strength"), F.concat(F.lit("path holds "), "word").alias("reason"))


# Requests of more distinct words than this, and those of several projects, have their pairs with paths grouped.
WIDE = 24


def request_words(task: Column) -> Column:
    """Words of four letters and more of a request that paths are held against."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(task), F.lit("([a-z0-9_$]{2,})"), 1), lambda w: F.length(w) >= 4))


def path_words(path: Column) -> Column:
    """Words of four letters and more of a path."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(path), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 4))


def worded(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(plain, other)`` of ``(request_id, project_id, task)`` rows: ``(request_id, project_id, words)``, each plain request once and in one project."""
    known = asks.where("project_id IS NOT NULL").select("request_id", "project_id", request_words(F.col("task")).alias("words"))
    whole = known.groupBy("request_id").agg(F.min("project_id").alias("project_id"), F.max("project_id").alias("_last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))
    plain = (F.col("project_id") == F.col("_last")) & (F.size("words") <= WIDE)
    return whole.where(plain).drop("_last"), known.join(whole.where(~plain).select("request_id"), "request_id", "left_semi")


def asked_words(asks: DataFrame, files: DataFrame) -> DataFrame:
    """``(project_id, path, held)``: the words of each path that some request of its project holds, sorted; paths without one are left out.

    The paths alone are shuffled, once; they stand in order, so that those shuffled on from here pack well.
    """
    wanted = asks.select("project_id", F.explode("words").alias("word")).distinct()
    each = files.select("project_id", "path").distinct().select("project_id", "path", F.explode(path_words(F.col("path"))).alias("word"))
    return each.join(F.broadcast(wanted), ["project_id", "word"], "left_semi").groupBy("project_id", "path").agg(F.array_sort(F.collect_set("word")).alias("held")).sortWithinPartitions("project_id", "path")


# Pairs are many more than the rows that they are made of tell: parts of the paths of a word (a power of two), and the least number of tasks a core.
SALTS, TASKS = 4, 8


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS * df.sparkSession.sparkContext.defaultParallelism)


def _bits(words: Column) -> Column:
    """A bit of 64 for each word; two words may have the same."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda all, w: all.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(w), F.lit(64)))))


def _salt() -> Column:
    return F.hash("path").bitwiseAND(F.lit(SALTS - 1))


def path_hits(plain: DataFrame, held: DataFrame, *, but: DataFrame | None = None) -> DataFrame:
    """``(request_id, ..., path, n)``: every path that holds ``n`` words of a request of its project, each pair once; other columns of ``plain`` are kept.

    A pair is made at the first word that both hold and nowhere else, so only the words of requests and of paths are shuffled, never
    their pairs. The ``(request_id, word, path)`` of ``but``, ``word`` being a pair's first one, are left out.
    """
    kept = [c for c in plain.columns if c not in ("project_id", "words")]
    asked = plain.select(*kept, "project_id", "words", F.explode("words").alias("word")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    if but is not None:
        asked = asked.join(but.groupBy("request_id", "word", _salt().alias("_salt")).agg(F.collect_set("path").alias("_but")), ["request_id", "word", "_salt"], "left")
    posted = held.select("project_id", "path", "held", F.explode("held").alias("word"), _salt().alias("_salt"))
    split = lambda df: df.repartition(_tasks(df), "project_id", "word", "_salt")
    asked = split(asked).withColumn("_asked", _bits(F.col("words"))).withColumn("_apart", F.bit_count("_asked") == F.size("words"))
    pairs = split(posted).withColumn("_bits", _bits(F.col("held"))).join(asked, ["project_id", "word", "_salt"])
    # the words of the request have bits of their own and only one is met: that is the word at hand, and there is no other
    single = F.col("_apart") & (F.bit_count(F.col("_bits").bitwiseAND(F.col("_asked"))) == 1)
    both = F.array_intersect("held", "words")
    pairs = pairs.where(F.when(single, True).otherwise(F.get(both, F.lit(0)) == F.col("word")))
    if but is not None:
        pairs = pairs.where(~F.coalesce(F.array_contains("_but", F.col("path")), F.lit(False)))
    return pairs.select(*kept, "path", F.when(single, 1).otherwise(F.size(both)).alias("n"))


def best_path_hits(plain: DataFrame, held: DataFrame, *, k: int) -> DataFrame:
    """The rows of ``path_hits`` of two words and more, and of those of one word the first ``k`` paths of each word.

    So the ``k`` best paths of a request are all there, by words and then by path, whatever else speaks for some paths, if the paths for
    which something else speaks are added. Pairs are met by two words at once.
    """
    order = Window.partitionBy("project_id", "word").orderBy("path")
    first = held.select("project_id", "path", F.explode("held").alias("word")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    both = F.array_intersect(path_words(F.col("path")), F.col("words"))
    one = first.join(plain.select("request_id", "project_id", "words", F.explode("words").alias("word")), ["project_id", "word"]).where(F.size(both) == 1)
    twos = lambda c: F.explode(F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    split = lambda df: df.select("*", "_w.a", "_w.b").drop("_w").repartition(_tasks(df), "project_id", "a", "b")
    posted = split(held.where(F.size("held") > 1).select("project_id", "path", "held", twos(F.col("held")).alias("_w")))
    asked = split(plain.where(F.size("words") > 1).select("request_id", "project_id", "words", twos(F.col("words")).alias("_w")))
    common = F.array_intersect("held", "words")
    more = posted.join(asked, ["project_id", "a", "b"]).where((F.get(common, F.lit(0)) == F.col("a")) & (F.get(common, F.lit(1)) == F.col("b")))
    return one.select("request_id", "path", F.lit(1).alias("n")).unionByName(more.select("request_id", "path", F.size(common).alias("n")))


def top_path_hits(plain: DataFrame, held: DataFrame, *, k: int) -> DataFrame:
    """``(request_id, path, n)``: the ``k`` best paths of each request, by words (3 count as many as more) and then by path. No other pairs are shuffled."""
    sizes = held.groupBy("project_id").agg(F.count("*").alias("_n"))
    best = best_sums(held.withColumnRenamed("held", "terms"), plain.select("request_id", "project_id", F.col("words").alias("terms")), sizes, "path", k=k, cap=3.0)
    return best.select("request_id", "path", F.col("sum").cast("int").alias("n"))


def most_hits(plain: DataFrame, held: DataFrame) -> DataFrame:
    """``(request_id, n)``: the most words, 3 at most, that a path of the project shares with a request. Groups of words are held against each other, not paths."""
    def groups(c):
        later = lambda i: F.slice(c, i + 2, F.size(c))
        ones = F.transform(c, lambda a: F.array(a))
        twos = F.flatten(F.transform(c, lambda a, i: F.transform(later(i), lambda b: F.array(a, b))))
        threes = F.flatten(F.flatten(F.transform(c, lambda a, i: F.transform(c, lambda b, j: F.when(j > i, F.transform(later(j), lambda d: F.array(a, b, d))).otherwise(F.array().cast("array<array<string>>"))))))
        return F.explode(F.concat(ones, twos, threes))

    there = held.select("project_id", groups(F.col("held")).alias("_g")).select("project_id", F.array_join("_g", " ").alias("_g")).distinct()
    asked = plain.select("request_id", "project_id", groups(F.col("words")).alias("_g")).select("request_id", "project_id", F.size("_g").alias("n"), F.array_join("_g", " ").alias("_g"))
    return asked.join(there, ["project_id", "_g"]).groupBy("request_id").agg(F.max("n").alias("n"))


def hits_of(pairs: DataFrame, plain: DataFrame) -> DataFrame:
    """``(request_id, path, n, word)`` of the given ``(request_id, path)``, paths of the request's project, that share words with their plain request; ``word`` is the first one."""
    both = F.array_sort(F.array_intersect(path_words(F.col("path")), F.col("words")))
    found = pairs.select("request_id", "path").distinct().join(plain.select("request_id", "words"), "request_id").select("request_id", "path", both.alias("_both"))
    return found.where(F.size("_both") > 0).select("request_id", "path", F.size("_both").alias("n"), F.get("_both", F.lit(0)).alias("word"))


def grouped_hits(other: DataFrame, files: DataFrame) -> DataFrame:
    """``(request_id, path, n)`` as ``path_hits``, of requests that are not plain."""
    wanted = other.select("request_id", "project_id", F.explode("words").alias("word"))
    held = files.select("project_id", "path", F.explode(path_words(F.col("path"))).alias("word"))
    held = held.join(F.broadcast(wanted.select("project_id", "word").distinct()), ["project_id", "word"], "left_semi").distinct()
    return wanted.join(held, ["project_id", "word"]).groupBy("request_id", "path").agg(F.countDistinct("word").alias("n"))


WORDS_REASON = "words of the request in the path"


def words_strength(n: Column) -> Column:
    return F.least(F.lit(1.0), n / 3.0)


def words_evidence(hits: DataFrame) -> DataFrame:
    """Evidence of ``(request_id, path, n)`` rows."""
    return hits.select("request_id", "path", F.lit("pathMatch").alias("component"), words_strength(F.col("n")).alias("strength"), F.lit(WORDS_REASON).alias("reason"))


def words_score(n: Column) -> Column:
    """The score of a file for which nothing but its words speaks, as ``combine`` gives it."""
    return F.round(WEIGHTS["pathMatch"] * words_strength(n), 6)


def recent_changes(asks: DataFrame, files: DataFrame, *, k: int = 10) -> DataFrame:
    """Evidence from the files of the project that changed last."""
    order = Window.partitionBy("project_id").orderBy(F.col("last_modified").desc(), "path")
    last = files.select("project_id", "path", "last_modified").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("project_id", "path").distinct()
    return asks.select("request_id", "project_id").join(last, "project_id").select("request_id", "path", F.lit("recent").alias("component"), F.lit(1.0).alias("strength"), F.lit("changed lately").alias("reason"))


def remembered(asks: DataFrame, records: DataFrame, files: DataFrame, *, k: int = 6) -> DataFrame:
    """Evidence from files that the records recalled for a request speak of. ``records`` has ``(project_id, id, text, importance)``."""
    hits = search_many(asks, records, {"text": 1}, k=k).select("request_id", "project_id", "id")
    told = records.select("project_id", "id", "importance", F.explode(paths_in(F.col("text"))).alias("path"))
    return hits.join(told, ["project_id", "id"]).join(files.select("project_id", "path").distinct(), ["project_id", "path"]).select(
        "request_id", "path", F.lit("memory").alias("component"), F.col("importance").alias("strength"), F.lit("a record speaks of it").alias("reason")
    )


def paths_in(text: Column) -> Column:
    """Paths that a text spells out, with ``/`` between folders."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\\", "/"), r"(?<![\w./-])\./", ""), F.lit(r"(?<![\w@./-])([\w@.-]+(?:/[\w@.()\[\]-]+)*\.\w+)"), 1))


def rank(scored: DataFrame) -> DataFrame:
    """``relevance``: the score as a share of the request's best, to 3 digits."""
    return scored.withColumn("relevance", share_of(F.col("score"), F.max("score").over(Window.partitionBy("request_id"))))


def share_of(score: Column, top: Column) -> Column:
    return F.when(top > 0, F.round(score / top, 3)).otherwise(0.0)


def fill_budget(ranked: DataFrame, *, budget: int = 6000, max_files: int = 12, sources: int | None = None) -> DataFrame:
    """Which files of each request fit: a greedy prefix that stops at the first file that does not fit even as an outline.

    ``ranked`` has ``(request_id, path, relevance, full_tokens, outline_tokens)`` and, if there is one, ``header_tokens``, which every
    answer costs beside its files. A file whose full form does not fit, or that comes after the first ``sources`` files, is
    tried as an outline; a null full form means that there is only the outline. Result: ``(request_id, path, level, tokens, position,
    truncated)``, level 2 for full, 1 for outline; ``truncated`` tells whether some file of the request was left out.
    """
    order = Window.partitionBy("request_id").orderBy(F.col("relevance").desc(), "path")
    # files past the first max_files cannot be taken, and one more tells that some are left out: the fold sees a bounded list
    few = ranked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_files + 1)
    header = F.max("header_tokens") if "header_tokens" in ranked.columns else F.lit(0)
    listed = few.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("_r", "path", "full_tokens", "outline_tokens"))).alias("files"), F.coalesce(header, F.lit(0)).cast("long").alias("_header"))
    start = F.struct(F.col("_header").alias("used"), F.lit(False).alias("stop"), F.array().cast("array<struct<path:string,level:int,tokens:bigint>>").alias("taken"))

    def step(state, file):
        fits = lambda n: state["used"] + n <= F.lit(budget)
        take = lambda level, n: F.struct(
            (state["used"] + n).cast("long").alias("used"), F.lit(False).alias("stop"),
            F.concat(state["taken"], F.array(F.struct(file["path"].alias("path"), F.lit(level).alias("level"), n.cast("long").alias("tokens")))).alias("taken"),
        )
        halt = F.struct(state["used"].alias("used"), F.lit(True).alias("stop"), state["taken"].alias("taken"))
        with_source = file["full_tokens"].isNotNull() & (F.lit(True) if sources is None else F.size(state["taken"]) < sources)
        return (
            F.when(state["stop"], state).when(F.size(state["taken"]) >= max_files, halt)
            .when(with_source & fits(file["full_tokens"]), take(2, file["full_tokens"])).when(fits(file["outline_tokens"]), take(1, file["outline_tokens"])).otherwise(halt)
        )

    taken = listed.select("request_id", F.aggregate("files", start, step).alias("s"))
    return taken.select("request_id", F.col("s.stop").alias("truncated"), F.posexplode("s.taken").alias("position", "t")).select("request_id", "t.path", "t.level", "t.tokens", "position", "truncated")


# What kinds of symbols weigh in an outline.
SYMBOL_WEIGHTS = {"class": 2, "interface": 2, "component": 2, "function": 1, "method": 1, "hook": 1, "route": 1, "variable": -2, "property": -2}


def outlines(wanted: DataFrame, symbols: DataFrame, *, most: int = 12, within: int = 100) -> DataFrame:
    """``(request_id, project_id, path, symbols, target)`` of ranked files: their ``most`` weightiest symbols, of the first ``within`` by line, and where to read.

    ``wanted`` has ``(request_id, project_id, path, highlighted)``, names that weigh ten more; exported ones weigh three more, kinds as
    ``SYMBOL_WEIGHTS``; ties go by line. ``target`` is the first highlighted symbol's ``(line_start, line_end)``, else the first one's. Files without symbols have an empty list.
    """
    by_line = Window.partitionBy("request_id", "project_id", "path").orderBy("line_start", "id")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in SYMBOL_WEIGHTS.items() for x in pair])[F.col("type")], F.lit(0))
    held = wanted.join(symbols.select("project_id", "path", "id", "name", "qualified_name", "type", "signature", "exported", "line_start", "line_end"), ["project_id", "path"], "left")
    marked = F.coalesce(F.array_contains("highlighted", F.col("name")), F.lit(False))
    weight = F.when(marked, 10).otherwise(0) + F.when(F.col("exported"), 3).otherwise(0) + kind
    rows = held.withColumn("_n", F.row_number().over(by_line)).where(F.col("_n") <= within).withColumn("_w", weight).withColumn("_marked", marked)
    entry = F.struct(F.col("qualified_name").alias("name"), "type", F.array("line_start", "line_end").alias("lines"), "signature", F.when(F.col("exported"), True).alias("exported"))
    order = F.struct((-F.col("_w")).alias("w"), F.col("line_start").alias("l"), F.col("id").alias("i"))
    listed = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct(order.alias("o"), entry.alias("e")))))
    lines = F.struct("line_start", "line_end")
    return rows.groupBy("request_id", "project_id", "path").agg(
        F.transform(F.slice(listed, 1, most), lambda x: x["e"]).alias("symbols"),
        F.min_by(lines, F.when(F.col("id").isNotNull(), F.struct((~F.col("_marked")).alias("m"), "_n"))).alias("target"),
    )


def entries(ranked: DataFrame, files: DataFrame, symbols: DataFrame, texts: DataFrame, *, max_files: int = 12, source_lines: int = 80) -> DataFrame:
    """What each of the best files of a request costs: ``(request_id, project_id, path, relevance, outline_tokens, full_tokens, outline, source)``.

    ``ranked`` has ``(request_id, project_id, path, relevance, reasons, highlighted, with_source)``. An outline is JSON of the path, language, relevance,
    reasons and symbols; the full form holds the redacted lines of the target symbol too, or the first forty. Texts are joined for ``max_files + 1`` files of a request.
    """
    order = Window.partitionBy("request_id").orderBy(F.col("relevance").desc(), "path")
    few = ranked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_files + 1).drop("_r")
    shown = few.join(outlines(few.select("request_id", "project_id", "path", "highlighted"), symbols), ["request_id", "project_id", "path"], "left")
    shown = shown.join(files.groupBy("project_id", "path").agg(F.max("language").alias("language")), ["project_id", "path"], "left")
    held = texts.select("project_id", "path", "content").join(few.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi").groupBy("project_id", "path").agg(F.max("content").alias("content"))
    shown = shown.join(held, ["project_id", "path"], "left")
    first = F.coalesce(F.col("target.line_start"), F.lit(1)).cast("int")
    last = F.when(F.col("target").isNull(), 40).otherwise(F.least(F.col("target.line_end"), F.col("target.line_start") + source_lines - 1)).cast("int")
    text = F.array_join(F.slice(F.split("content", "\r?\n"), F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n")
    source = F.when(F.col("with_source") & F.col("content").isNotNull(), F.struct(F.array(first, last).alias("lines"), redact(text).alias("text")))
    parts = ["path", "language", "relevance", "reasons", "symbols"]
    rows = shown.withColumn("source", source)
    return rows.select(
        "request_id", "project_id", "path", "relevance", estimate_tokens(F.to_json(F.struct(*parts))).alias("outline_tokens"), F.when(F.col("source").isNotNull(), estimate_tokens(F.to_json(F.struct(*parts, "source")))).alias("full_tokens"),
        F.to_json(F.struct(*parts)).alias("outline"), "source",
    )


def answers(asks: DataFrame, ranked: DataFrame, filled: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each request: ``(request_id, intent, files, tests, token_estimate, considered, selected, avoided, truncated)``.

    ``files`` are the paths in order, ``tests`` those among them that look like tests, ``considered`` all candidates and ``avoided`` the files of the project that were left out.
    """
    considered = ranked.groupBy("request_id").agg(F.countDistinct("path").alias("considered"))
    chosen = filled.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]).alias("files"), F.sum("tokens").alias("_tokens"), F.count("*").alias("selected"), F.bool_or("truncated").alias("truncated"),
        F.array_sort(F.collect_set(F.when(looks_like_test(F.col("path")), F.col("path")))).alias("tests"),
    )
    held = files.groupBy("project_id").agg(F.count("*").alias("_held"))
    base = asks.select("request_id", "project_id", detect_intent(F.col("task")).alias("intent"), *(["header_tokens"] if "header_tokens" in asks.columns else []))
    joined = base.join(considered, "request_id", "left").join(chosen, "request_id", "left").join(held, "project_id", "left")
    none = F.array().cast("array<string>")
    cost = F.coalesce("_tokens", F.lit(0)) + (F.coalesce("header_tokens", F.lit(0)) if "header_tokens" in asks.columns else F.lit(0))
    return joined.select(
        "request_id", "project_id", "intent", F.coalesce("files", none).alias("files"), F.coalesce("tests", none).alias("tests"), cost.alias("token_estimate"), F.coalesce("considered", F.lit(0)).alias("considered"), F.coalesce("selected", F.lit(0)).alias("selected"),
        F.greatest(F.lit(0), F.coalesce("_held", F.lit(0)) - F.coalesce("selected", F.lit(0))).alias("avoided"), F.coalesce("truncated", F.coalesce("considered", F.lit(0)) > 0).alias("truncated"),
    )


def of_tasks(tasks: DataFrame) -> DataFrame:
    """Requests for the context of tasks: ``(request_id, project_id, task)`` from the title, what is left of the requirements, and the task's paths and symbols.

    ``tasks`` has ``(task_id, project_id, title, requirements, paths, symbols)``, requirements as ``stores.with_requirements`` gives them.
    """
    left = F.transform(F.filter("requirements", lambda r: ~r["done"]), lambda r: r["text"])
    named = F.concat(F.coalesce("paths", F.array().cast("array<string>")), F.transform(F.coalesce("symbols", F.array().cast("array<string>")), lambda x: F.concat(F.lit("`"), x, F.lit("`"))))
    return tasks.select(F.col("task_id").alias("request_id"), "project_id", F.concat_ws("\n", "title", F.array_join(left, "\n"), F.array_join(named, " ")).alias("task"))


def workspace_budget(total: int, projects: int) -> int:
    """Budget of each project of a workspace."""
    return max(800, total // max(1, projects))
