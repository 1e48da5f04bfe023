"""Knowledge records, tasks, work sessions, the context cache and the activity feed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import collapse, content_hash, redact
from loomstead.operators.search import search
from loomstead.session import normal_path

# Default importance by kind of record, days that a kind lasts, task statuses and what may follow each.
IMPORTANCE = {"DECISION": 0.9, "CONSTRAINT": 0.85, "BUG": 0.7, "PATTERN": 0.7, "DISCOVERY": 0.6, "FACT": 0.5, "HISTORY": 0.3}
LASTS_DAYS = {"HISTORY": 30}
TRANSITIONS = {
    "IDEA": ["PLANNING", "READY", "IN_PROGRESS"], "PLANNING": ["IDEA", "READY", "IN_PROGRESS"], "READY": ["PLANNING", "IN_PROGRESS", "BLOCKED"],
    "IN_PROGRESS": ["BLOCKED", "TESTING", "COMPLETED", "READY"], "BLOCKED": ["IN_PROGRESS", "READY", "COMPLETED"], "TESTING": ["IN_PROGRESS", "BLOCKED", "COMPLETED"],
    "COMPLETED": ["IN_PROGRESS", "TESTING"], "ARCHIVED": ["READY", "IDEA"],
}
OPEN = ["PLANNING", "READY", "IN_PROGRESS", "BLOCKED", "TESTING"]
STATUSES = ["IN_PROGRESS", "BLOCKED", "TESTING", "READY", "PLANNING", "IDEA", "COMPLETED", "ARCHIVED"]


def rank(column: Column, order: list[str]) -> Column:
    """Place of a value in a list, one past the end where it is none of it."""
    found = F.lit(len(order))
    for k, value in reversed(list(enumerate(order))):
        found = F.when(column == value, k).otherwise(found)
    return found


def remember(records: DataFrame) -> DataFrame:
    """One record per identical kind, title and content: greatest importance, merged tags, first and last time, times seen."""
    default = F.create_map(*[F.lit(x) for pair in IMPORTANCE.items() for x in pair])
    keyed = records.withColumn("content_hash", content_hash(F.col("type"), F.col("title"), F.col("content"))).withColumn(
        "importance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("importance", default[F.col("type")], F.lit(0.5))))
    )
    return keyed.groupBy("project_id", "content_hash").agg(
        F.min("type").alias("type"), F.max("importance").alias("importance"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("times"),
    )


def expiry(kind: Column, importance: Column, created_at: Column, days: Column) -> Column:
    """When a record expires: after the days it was given, else by its kind unless it is important; null for never."""
    default = F.create_map(*[F.lit(x) for pair in LASTS_DAYS.items() for x in pair])[kind]
    lasts = F.coalesce(days, F.when(importance < 0.7, default))
    return created_at + F.make_dt_interval(lasts)


def recency(age_days: Column) -> Column:
    """Halves every ninety days."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / 90)


def recall_score(relevance: Column, importance: Column, age_days: Column, confidence: Column, accesses: Column) -> Column:
    return 0.5 * relevance + 0.3 * importance + 0.1 * recency(age_days) + 0.05 * confidence + F.least(F.lit(0.1), 0.01 * accesses)


def expire(records: DataFrame, now: Column) -> DataFrame:
    """Records whose time has passed become archived."""
    return records.withColumn("status", F.when(F.col("expires_at") <= now, "archived").otherwise(F.col("status")))


def in_branch(branch: Column, scope: str | None) -> Column:
    """Records without a branch apply everywhere."""
    return branch.isNull() if scope is None else branch.isNull() | (branch == scope)


def progress(tasks: DataFrame, requirements: DataFrame) -> DataFrame:
    """``tasks`` with ``(done, total, percent)`` of their requirements; a completed task without any is at 100."""
    counts = requirements.groupBy("task_id").agg(F.count_if("done").alias("done"), F.count("*").alias("total"))
    joined = tasks.join(counts, "task_id", "left").fillna(0, ["done", "total"])
    percent = F.when(F.col("total") > 0, F.round(100 * F.col("done") / F.col("total"))).when(F.col("status") == "COMPLETED", 100).otherwise(0)
    return joined.withColumn("percent", percent.cast("long"))


def valid_transitions(events: DataFrame) -> DataFrame:
    """``(task_id, at, status, allowed)``: whether each status event may follow the one before it."""
    before = F.lag("status").over(Window.partitionBy("task_id").orderBy("at", "event_id"))
    table = F.create_map(*[x for a, b in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(y) for y in sorted(b)]))])
    return events.withColumn("before", before).select(
        "task_id", "at", "status", (F.col("before").isNull() | (F.col("before") == F.col("status")) | F.coalesce(F.array_contains(table[F.col("before")], F.col("status")), F.lit(False))).alias("allowed")
    )


def close_sessions(starts: DataFrame) -> DataFrame:
    """Work sessions with an end: an open one ends when the next of its project starts."""
    following = F.lead("started_at").over(Window.partitionBy("project_id").orderBy("started_at", "session_id"))
    return starts.withColumn("ended_at", F.coalesce("ended_at", following)).withColumn("status", F.when(F.col("ended_at").isNull(), "active").otherwise("ended"))


def handoff(sessions: DataFrame, tasks: DataFrame, requirements: DataFrame) -> DataFrame:
    """``(project_id, next_step)``: the last session's own, else the first open requirement, else the first open task."""
    last = sessions.groupBy("project_id").agg(F.max_by("next_step", F.struct("started_at", "session_id")).alias("own"))
    open_tasks = tasks.where(F.col("status").isin(OPEN))
    place = F.struct(rank(F.col("status"), STATUSES), "task_id")
    first_task = open_tasks.groupBy("project_id").agg(F.min_by("title", place).alias("task"))
    todo = requirements.where("NOT done").join(open_tasks.select("task_id", "project_id", "status"), "task_id")
    first_todo = todo.groupBy("project_id").agg(F.min_by("text", F.struct(rank(F.col("status"), STATUSES), "task_id", "position")).alias("todo"))
    return last.join(first_task, "project_id", "full_outer").join(first_todo, "project_id", "full_outer").select(
        "project_id", F.coalesce("own", "todo", "task", F.lit("no open tasks")).alias("next_step")
    )


def cache_state(cache: DataFrame, current: DataFrame) -> DataFrame:
    """``(id, project_id, stale, missing, state)`` of cache entries against the files as they are.

    Paths compare as :func:`loomstead.session.normal_path` reads them. ``stale`` and ``missing`` count the entry's files with another hash and without an active file. The state is
    ``hit`` if none is either, ``incremental`` for up to three stale files and none missing, else ``miss``.
    """
    wanted = cache.select("id", "project_id", F.explode_outer("files").alias("f")).select("id", "project_id", normal_path(F.col("f.path")).alias("relative_path"), F.col("f.hash").alias("hash"))
    now = current.groupBy("project_id", "relative_path").agg(F.max("hash").alias("now_hash"))
    joined = wanted.join(now, ["project_id", "relative_path"], "left")
    stale = F.count_if(F.col("now_hash").isNotNull() & ~F.col("now_hash").eqNullSafe(F.col("hash")))
    missing = F.count_if(F.col("relative_path").isNotNull() & F.col("now_hash").isNull())
    return joined.groupBy("id", "project_id").agg(stale.alias("stale"), missing.alias("missing")).withColumn(
        "state", F.when((F.col("stale") == 0) & (F.col("missing") == 0), "hit").when((F.col("stale") <= 3) & (F.col("missing") == 0), "incremental").otherwise("miss")
    )


def cache_differences(cache: DataFrame, current: DataFrame) -> DataFrame:
    """``(id, path, what)`` of each path of an entry that has another hash now (``stale``) or no active file (``missing``)."""
    wanted = cache.select("id", "project_id", F.explode("files").alias("f")).select("id", "project_id", normal_path(F.col("f.path")).alias("relative_path"), F.col("f.hash").alias("hash")).where("relative_path IS NOT NULL")
    now = current.groupBy("project_id", "relative_path").agg(F.max("hash").alias("now_hash"))
    joined = wanted.join(now, ["project_id", "relative_path"], "left").where(F.col("now_hash").isNull() | ~F.col("now_hash").eqNullSafe(F.col("hash")))
    return joined.select("id", F.col("relative_path").alias("path"), F.when(F.col("now_hash").isNull(), "missing").otherwise("stale").alias("what"))


def invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """``cache`` without the entries that hold a changed path of their project: ``changed`` has ``(project_id, relative_path)``."""
    held = cache.select("id", "project_id", F.explode("files").alias("f")).select("id", "project_id", normal_path(F.col("f.path")).alias("relative_path"))
    touched = held.join(changed.select("project_id", normal_path(F.col("relative_path")).alias("relative_path")).distinct(), ["project_id", "relative_path"], "left_semi")
    return cache.join(touched.select("id").distinct(), "id", "left_anti")


def evict(cache: DataFrame, keep: int = 200) -> DataFrame:
    """The ``keep`` entries of each project that were used last."""
    order = Window.partitionBy("project_id").orderBy(F.col("last_used_at").desc(), "id")
    return cache.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def cache_analytics(events: DataFrame) -> DataFrame:
    """Requests by kind, tokens and rates of ``(cache, tokens, files_avoided)`` events, one row; zero where there is none."""
    n = F.count("*")
    return events.agg(
        n.alias("requests"), F.count_if(F.col("cache") == "hit").alias("hits"), F.count_if(F.col("cache") == "incremental").alias("incremental"),
        F.count_if(F.col("cache") == "miss").alias("misses"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("files_avoided"), F.lit(0)).alias("avoided"),
        F.when(n > 0, F.round(F.count_if(F.col("cache").isin("hit", "incremental")) / n, 3)).otherwise(0.0).alias("hit_rate"),
        F.when(n > 0, F.round(F.avg("tokens"))).otherwise(0.0).alias("average_tokens"),
    )


def feed(activity: DataFrame, since: int, limit: int = 100) -> DataFrame:
    """The newest ``limit`` rows after a cursor, oldest first, each id once, texts redacted and shortened."""
    rows = activity.where(F.col("id") > since).dropDuplicates(["id"]).orderBy(F.col("id").desc()).limit(limit)
    return rows.select("id", "project_id", "source", "tool", collapse(redact(F.col("summary")), 200).alias("summary"), collapse(redact(F.col("detail")), 400).alias("detail"), "outcome").orderBy("id")


def prune(activity: DataFrame, keep: int = 2000) -> DataFrame:
    """The last ``keep`` ids."""
    last = activity.agg(F.max("id")).first()[0]
    return activity if last is None else activity.where(F.col("id") > last - keep)


def recall(records: DataFrame, now: Column, *, query: str | None = None, branch: str | None = None, kind: str | None = None, tag: str | None = None, path: str | None = None, least: float = 0.0, limit: int = 10) -> DataFrame:
    """The records that matter most for a query, or in general: ``(memory_id, score, relevance)``.

    ``records`` has ``(memory_id, type, title, content, tags, paths, branch, status, importance, confidence, accesses, updated_at, expires_at)``.
    A search looks four times further than the limit before the filters apply; where nothing is left, the filtered
    list stands in with relevance 0.2. Without a query every record has 0.5. Pure: accesses are appended by the caller.
    """
    live = expire(records, now).where("status = 'active'")
    wanted = in_branch(F.col("branch"), branch) & (F.col("importance") >= least)
    wanted = wanted & (F.col("type") == kind if kind else F.lit(True))
    wanted = wanted & (F.array_contains("tags", tag) if tag else F.lit(True)) & (F.array_contains("paths", path) if path else F.lit(True))
    age = F.datediff(now, F.col("updated_at"))
    scored = lambda rows: rows.withColumn("score", F.round(recall_score(F.col("relevance"), F.col("importance"), age, F.col("confidence"), F.col("accesses")), 4))
    top = lambda rows: scored(rows).orderBy(F.col("score").desc(), "memory_id").limit(limit).select("memory_id", "score", "relevance")
    if not query:
        return top(live.where(wanted).withColumn("relevance", F.lit(0.5)))
    texts = live.select("memory_id", "title", "content", F.array_join("tags", " ").alias("_tags"))
    hits = search(texts, query, {"title": 6, "content": 2, "_tags": 3}, k=limit * 4, key="memory_id").select("memory_id", "relevance")
    found = live.join(hits, "memory_id").where(wanted)
    return top(live.where(wanted).withColumn("relevance", F.lit(0.2)) if found.isEmpty() else found)


def cache_key(version: int, task: str, options: dict) -> str:
    """Key of a context request: the same for the same options in any order and any spacing of the task."""
    parts = [f"v{version}", " ".join(task.lower().split()), *(f"{k}={json.dumps(options[k], sort_keys=True)}" for k in sorted(options))]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]


def next_task_keys(tasks: DataFrame) -> DataFrame:
    """``tasks`` with keys ``TASK-n`` for those without one, after the greatest number of their project."""
    number = F.regexp_extract("key", r"^TASK-(\d+)$", 1).cast("long")
    last = F.coalesce(F.max(number).over(Window.partitionBy("project_id")), F.lit(0))
    place = F.sum(F.col("key").isNull().cast("long")).over(Window.partitionBy("project_id").orderBy("created_at", "task_id"))
    return tasks.withColumn("key", F.coalesce("key", F.concat(F.lit("TASK-"), last + place)))
