"""State of knowledge, tasks, sessions, projects, workspaces, index runs and cached contexts, folded from event logs.

Nothing is changed in place: a command appends rows to a log, and each function here gives the state after all rows, for all
projects at once. Every fold is a grouping with a map-side combine on the key of the entity; order is ``(at, seq)``, and a null field of
an event says nothing of that field. Repeated rows change nothing but counts of accesses, for which each ``seq`` counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import content_hash
from loomstead.operators.knowledge import IMPORTANCE, OPEN, STATUSES, TRANSITIONS, in_branch, rank

ORDER = ("at", "seq")


def last_known(field: str, when: Column | None = None) -> Column:
    """The latest value of a field that is not null, among the events of ``when``."""
    known = F.col(field).isNotNull() if when is None else F.col(field).isNotNull() & when
    return F.max_by(field, F.when(known, F.struct(*ORDER)))


def first_known(field: str) -> Column:
    return F.min_by(field, F.when(F.col(field).isNotNull(), F.struct(*ORDER)))


def _union(field: str) -> Column:
    """All values that a list ever had, in their own order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(field, F.array().cast("array<string>"))))))


def fold(log: DataFrame, keys: list[str], *, latest: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """State of each key: the latest known value of the ``latest`` fields, the first known value of the ``first`` ones."""
    return log.groupBy(*keys).agg(*[last_known(c).alias(c) for c in latest], *[first_known(c).alias(c) for c in first], F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


# ---------------------------------------------------------------- knowledge records

def memory_state(log: DataFrame) -> DataFrame:
    """Records after ``(project_id, memory_id, at, seq, event, type, title, content, importance, confidence, tags, paths, branch, expires_at, supersedes)`` events.

    Events: remembered, updated, reinforced, archived, restored, accessed, forgotten. The greatest importance and confidence count, lists
    are merged, the hash follows the text as it is, a record that another one supersedes is archived, a forgotten one is gone. Titles
    under 3 and contents under 8 characters, and unknown types, make no record. Times of access do not touch ``updated_at``.
    """
    said = F.col("event").isin("remembered", "updated", "reinforced")
    state = F.when(F.col("event") == "archived", "archived").when(said | (F.col("event") == "restored"), "active")
    folded = log.withColumn("_state", state).groupBy("project_id", "memory_id").agg(
        last_known("type").alias("type"), last_known("title").alias("title"), last_known("content").alias("content"), F.max("importance").alias("importance"), F.max("confidence").alias("confidence"),
        _union("tags").alias("tags"), _union("paths").alias("paths"), last_known("branch").alias("branch"), last_known("expires_at").alias("expires_at"), last_known("_state").alias("status"),
        F.min(F.when(said, F.col("at"))).alias("created_at"), F.max(F.when(F.col("event") != "accessed", F.col("at"))).alias("updated_at"),
        F.countDistinct(F.when(F.col("event") == "accessed", F.col("seq"))).alias("accesses"), F.max(F.when(F.col("event") == "accessed", F.col("at"))).alias("accessed_at"),
        F.bool_or(F.col("event") == "forgotten").alias("_gone"),
    )
    kept = folded.where("NOT _gone AND created_at IS NOT NULL").drop("_gone").where(F.col("type").isin(*IMPORTANCE) & (F.length(F.trim("title")) >= 3) & (F.length(F.trim("content")) >= 8))
    replaced = log.where("supersedes IS NOT NULL").select("project_id", F.col("supersedes").alias("memory_id"), F.lit(True).alias("_replaced")).distinct()
    default = F.create_map(*[F.lit(x) for pair in IMPORTANCE.items() for x in pair])
    return (
        kept.join(replaced, ["project_id", "memory_id"], "left")
        .withColumn("status", F.when(F.col("_replaced"), "archived").otherwise(F.col("status"))).drop("_replaced")
        .withColumn("importance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("importance", default[F.col("type")]))))
        .withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.8)))))
        .withColumn("content_hash", content_hash(F.col("type"), F.col("title"), F.col("content")))
    )


def memory_list(records: DataFrame, *, kind: str | None = None, status: str | None = "active", branch: str | None = None, any_branch: bool = True, tag: str | None = None, path: str | None = None, least: float | None = None, per_project: int = 50) -> DataFrame:
    """Records of each project that pass the filters, the most important first, then the latest: ``place`` counts from 1."""
    rows = records
    for value, name in ((kind, "type"), (status, "status")):
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows if any_branch else rows.where(in_branch(F.col("branch"), branch))
    rows = rows if tag is None else rows.where(F.array_contains("tags", tag))
    rows = rows if path is None else rows.where(F.array_contains("paths", path))
    rows = rows if least is None else rows.where(F.col("importance") >= least)
    order = Window.partitionBy("project_id").orderBy(F.col("importance").desc(), F.col("updated_at").desc(), "memory_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_project)


def memory_stats(records: DataFrame, now: Column) -> DataFrame:
    """Totals of each project: all, active, archived, expired but active, and the mean importance of active ones."""
    active = F.col("status") == "active"
    # sums of decimals do not depend on the order of rows
    total, count = F.sum(F.when(active, F.col("importance").cast("decimal(9,4)"))).cast("double"), F.count_if(active)
    return records.groupBy("project_id").agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(F.col("status") == "archived").alias("archived"),
        F.count_if(active & (F.col("expires_at") <= now)).alias("expired"), F.round(F.when(count > 0, total / count).otherwise(0.0), 3).alias("average_importance"),
    )


def find_by_hash(records: DataFrame, asked: DataFrame) -> DataFrame:
    """Records of the same project with the content of ``(ask_id, project_id, type, title, content)`` rows: ``(ask_id, memory_id)``, the earliest of each."""
    wanted = asked.select("ask_id", "project_id", content_hash(F.col("type"), F.col("title"), F.col("content")).alias("content_hash"))
    return wanted.join(records.select("project_id", "content_hash", "memory_id", "created_at"), ["project_id", "content_hash"]).groupBy("ask_id").agg(F.min_by("memory_id", F.struct("created_at", "memory_id")).alias("memory_id"))


def with_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with ``decision``, a struct of the latest ``(memory_id, at, seq, reason, alternatives, affected)`` row; null for other types."""
    latest = decisions.groupBy("memory_id").agg(F.max_by(F.struct("reason", "alternatives", "affected"), F.struct(*ORDER)).alias("_decision"))
    return records.join(latest, "memory_id", "left").withColumn("decision", F.when(F.col("type") == "DECISION", F.col("_decision"))).drop("_decision")


def files_of_records(records: DataFrame, live: DataFrame) -> DataFrame:
    """``(memory_id, file_id, relative_path)`` of the active files that records name."""
    named = records.select("memory_id", "project_id", F.explode("paths").alias("relative_path"))
    return named.join(live.select("project_id", "relative_path", "file_id"), ["project_id", "relative_path"]).select("memory_id", "file_id", "relative_path").distinct()


def timeline(log: DataFrame, keys: list[str], *, newest: int = 20) -> DataFrame:
    """The ``newest`` events of each key, the latest first: ``place`` counts from 1. A report with a length of its own."""
    order = Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("seq").desc())
    return log.withColumn("place", F.row_number().over(order)).where(F.col("place") <= newest)


# ---------------------------------------------------------------- tasks

def task_state(log: DataFrame) -> DataFrame:
    """Tasks after ``(project_id, task_id, at, seq, status, title, priority, blocked_reason, tags, paths, branch)`` events.

    A task starts when it is first in progress. It is completed since the first COMPLETED after the last status that is neither that nor
    ARCHIVED; a reason of blocking lasts while it is blocked. Changes of status that may not follow the one before are counted in ``refused``, and do not count otherwise.
    """
    changes = log.where("status IS NOT NULL").groupBy("project_id", "task_id").agg(F.array_sort(F.collect_set(F.struct("at", "seq", "status"))).alias("all"))
    table = F.create_map(*[x for a, b in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(y) for y in b]))])
    start = F.struct(
        F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("refused"), F.lit(None).cast(log.schema["at"].dataType).alias("started"), F.lit(None).cast(log.schema["at"].dataType).alias("completed"),
        F.lit(None).cast(log.schema["at"].dataType).alias("since"),
    )

    def step(state: Column, event: Column) -> Column:
        same = state["status"] == event["status"]
        allowed = state["status"].isNull() | same | F.coalesce(F.array_contains(table[state["status"]], event["status"]), F.lit(False))
        done = F.when(event["status"] == "COMPLETED", F.coalesce(state["completed"], event["at"])).when(event["status"] == "ARCHIVED", state["completed"])
        taken = F.struct(
            event["status"].alias("status"), state["refused"].alias("refused"), F.coalesce(state["started"], F.when(event["status"] == "IN_PROGRESS", event["at"])).alias("started"), done.alias("completed"),
            F.when(same, state["since"]).otherwise(event["at"]).alias("since"),
        )
        left = F.struct(state["status"].alias("status"), (state["refused"] + 1).alias("refused"), state["started"].alias("started"), state["completed"].alias("completed"), state["since"].alias("since"))
        return F.when(allowed, taken).otherwise(left)

    status = changes.select("project_id", "task_id", F.aggregate("all", start, step).alias("s")).select(
        "project_id", "task_id", "s.status", "s.refused", F.col("s.started").alias("started_at"), F.col("s.completed").alias("completed_at"), F.col("s.since").alias("_since")
    )
    rest = log.groupBy("project_id", "task_id").agg(
        last_known("title").alias("title"), last_known("priority").alias("priority"), _union("tags").alias("tags"), _union("paths").alias("paths"), last_known("branch").alias("branch"), F.max("at").alias("updated_at"),
        F.max_by(F.struct(F.col("at").alias("at"), F.col("blocked_reason").alias("reason")), F.when(F.col("blocked_reason").isNotNull(), F.struct(*ORDER))).alias("_reason"),
    )
    joined = rest.join(status, ["project_id", "task_id"])
    blocked = (F.col("status") == "BLOCKED") & (F.col("_reason.at") >= F.col("_since"))
    return joined.withColumn("blocked_reason", F.when(blocked, F.col("_reason.reason"))).drop("_reason", "_since")


def task_list(tasks: DataFrame, *, status: str | None = None, open_only: bool = False, branch: str | None = None, per_project: int = 50) -> DataFrame:
    """Tasks of each project by rank of their status, then the latest change: ``place`` counts from 1."""
    rows = tasks.where(F.col("status") == status) if status else tasks.where(F.col("status").isin(OPEN)) if open_only else tasks
    rows = rows.where(in_branch(F.col("branch"), branch)) if branch else rows
    order = Window.partitionBy("project_id").orderBy(rank(F.col("status"), STATUSES), F.col("updated_at").desc(), "task_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_project)


def current_tasks(tasks: DataFrame) -> DataFrame:
    """``(project_id, task_id)``: the first of the open tasks that are being worked on."""
    working = tasks.where(F.col("status").isin("IN_PROGRESS", "TESTING", "BLOCKED"))
    # the latest change wins within a status
    return working.groupBy("project_id", rank(F.col("status"), STATUSES).alias("_rank")).agg(F.max_by("task_id", F.struct("updated_at", "task_id")).alias("task_id")).groupBy("project_id").agg(F.min_by("task_id", "_rank").alias("task_id"))


def find_task(tasks: DataFrame, asked: str) -> DataFrame:
    """The task with that id, else with that key in any case."""
    return tasks.where((F.col("task_id").cast("string") == asked) | (F.lower("key") == asked.lower()))


def with_requirements(tasks: DataFrame, requirements: DataFrame) -> DataFrame:
    """Tasks with ``requirements``, a list of ``(position, text, done)`` in order, and ``next_position``."""
    listed = requirements.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("position", "text", "done"))).alias("requirements"), (F.max("position") + 1).alias("next_position"))
    return tasks.join(listed, "task_id", "left").withColumn("requirements", F.coalesce("requirements", F.array().cast(listed.schema["requirements"].dataType))).withColumn("next_position", F.coalesce("next_position", F.lit(0)))


def tick(requirements: DataFrame, ticks: DataFrame) -> DataFrame:
    """``requirements`` after ``(task_id, at, seq, position, text, done)`` ticks, by position or, where that is null, by text in any case."""
    by_place = ticks.where("position IS NOT NULL").groupBy("task_id", "position").agg(F.max(F.struct(*ORDER, F.col("done"))).alias("_a"))
    by_text = ticks.where("position IS NULL").groupBy("task_id", F.lower("text").alias("_text")).agg(F.max(F.struct(*ORDER, F.col("done"))).alias("_b"))
    joined = requirements.withColumn("_text", F.lower("text")).join(by_place, ["task_id", "position"], "left").join(by_text, ["task_id", "_text"], "left")
    return joined.withColumn("done", F.coalesce(F.greatest("_a", "_b")["done"], F.col("done"))).select(*requirements.columns)


def task_stats(tasks: DataFrame) -> DataFrame:
    """Tasks of each project: all, open, blocked and completed ones."""
    status = F.col("status")
    return tasks.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(status.isin(OPEN)).alias("open"), F.count_if(status == "BLOCKED").alias("blocked"), F.count_if(status == "COMPLETED").alias("completed"))


# ---------------------------------------------------------------- sessions

def session_state(log: DataFrame) -> DataFrame:
    """Work sessions after ``(project_id, session_id, at, seq, event, agent, task_id, summary, next_step, files)`` events.

    Events: started, ended. A session that is still open when the next of its project starts ends then; files are those of all
    events. ``status`` is active or ended. A second end changes nothing.
    """
    folded = log.groupBy("project_id", "session_id").agg(
        F.min(F.when(F.col("event") == "started", F.col("at"))).alias("started_at"), F.min(F.when(F.col("event") == "ended", F.col("at"))).alias("_ended"), first_known("agent").alias("agent"), last_known("task_id").alias("task_id"),
        last_known("summary").alias("summary"), last_known("next_step").alias("next_step"), _union("files").alias("files"),
    ).where("started_at IS NOT NULL")
    following = F.lead("started_at").over(Window.partitionBy("project_id").orderBy("started_at", "session_id"))
    closed = F.when(F.col("_ended") <= F.coalesce(following, F.col("_ended")), F.col("_ended")).otherwise(following)
    return folded.withColumn("ended_at", closed).drop("_ended").withColumn("status", F.when(F.col("ended_at").isNull(), "active").otherwise("ended"))


def session_heads(sessions: DataFrame) -> DataFrame:
    """``(project_id, active, last_ended, sessions)``: the open session of each project, the one that ended last, and how many there are."""
    return sessions.groupBy("project_id").agg(
        F.max_by("session_id", F.when(F.col("status") == "active", F.struct("started_at", "session_id"))).alias("active"),
        F.max_by("session_id", F.when(F.col("status") == "ended", F.struct("ended_at", "session_id"))).alias("last_ended"), F.count("*").alias("sessions"),
    )


# ---------------------------------------------------------------- projects and workspaces

def registry_state(connects: DataFrame) -> DataFrame:
    """Projects after ``(project_id, at, seq, name, path, framework, package_manager, status)`` rows: unknown fields keep what was known, the first name stays."""
    return fold(connects, ["project_id"], latest=("path", "framework", "package_manager", "status"), first=("name",)).withColumnsRenamed({"created_at": "first_seen_at", "updated_at": "last_seen_at"}).withColumn("status", F.coalesce("status", F.lit("active")))


def path_history(connects: DataFrame) -> DataFrame:
    """``(project_id, path, first_seen_at, last_seen_at)`` of every path a project was ever at."""
    return connects.where("path IS NOT NULL").groupBy("project_id", "path").agg(F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"))


def resolve(projects: DataFrame, history: DataFrame, asked: DataFrame) -> DataFrame:
    """``(ask, project_id, how)`` of ``(ask)`` rows: by id, else by name in any case, else by present path, else by the newest path of the past. No match has no row."""
    ways = [
        projects.select(F.col("project_id").alias("_key"), "project_id", F.lit("id").alias("how"), F.lit(0).alias("_way"), "last_seen_at"), projects.select(F.lower("name").alias("_key"), "project_id", F.lit("name").alias("how"), F.lit(1).alias("_way"), "last_seen_at"),
        projects.select(F.col("path").alias("_key"), "project_id", F.lit("path").alias("how"), F.lit(2).alias("_way"), "last_seen_at"), history.select(F.col("path").alias("_key"), "project_id", F.lit("history").alias("how"), F.lit(3).alias("_way"), "last_seen_at"),
    ]
    known = ways[0].unionByName(ways[1]).unionByName(ways[2]).unionByName(ways[3])
    wanted = asked.select("ask", F.explode(F.array_distinct(F.array(F.col("ask"), F.lower("ask")))).alias("_key"))
    best = wanted.join(known, "_key").groupBy("ask").agg(F.min_by(F.struct("project_id", "how"), F.struct("_way", -F.unix_micros(F.col("last_seen_at").cast("timestamp")), "project_id")).alias("_best"))
    return best.select("ask", "_best.*")


def workspace_members(log: DataFrame, projects: DataFrame) -> DataFrame:
    """``(workspace_id, project_id, role, added_at, place)`` of active members after ``(workspace_id, project_id, at, seq, event, role)`` rows, in the order they were added.

    Events: added, removed. A role that is not given stays; a member that comes back is added anew.
    """
    state = log.groupBy("workspace_id", "project_id").agg(F.max_by("event", F.struct(*ORDER)).alias("_event"), last_known("role").alias("role"), F.max(F.when(F.col("event") == "removed", F.struct(*ORDER))).alias("_removed"))
    additions = log.where("event = 'added'").join(state.select("workspace_id", "project_id", "_removed"), ["workspace_id", "project_id"]).where("_removed IS NULL OR struct(at, seq) > _removed")
    since = additions.groupBy("workspace_id", "project_id").agg(F.min("at").alias("added_at"))
    members = state.where("_event = 'added'").join(since, ["workspace_id", "project_id"]).join(projects.where("status = 'active'").select("project_id"), "project_id", "left_semi")
    order = Window.partitionBy("workspace_id").orderBy("added_at", "project_id")
    return members.select("workspace_id", "project_id", "role", "added_at", F.row_number().over(order).alias("place"))


def merge_workspace(parts: DataFrame, members: DataFrame, *, limit: int = 25) -> DataFrame:
    """Ranked rows ``(project_id, kind, id, relevance)`` of all members of each workspace as one list of ``limit`` rows: ``place`` counts from 1."""
    order = Window.partitionBy("workspace_id").orderBy(F.col("relevance").desc(), "member", "kind", "id")
    joined = parts.join(members.select("workspace_id", "project_id", F.col("place").alias("member")), "project_id")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("member")


def orphan_storage(folders: DataFrame, projects: DataFrame) -> DataFrame:
    """Storage folders ``(project_id, folder)`` of projects that the registry does not know."""
    return folders.join(projects.select("project_id"), "project_id", "left_anti")


# ---------------------------------------------------------------- index runs and cached contexts

def run_state(log: DataFrame) -> DataFrame:
    """Index runs after ``(project_id, run_id, at, seq, event, <counters>)`` rows: started, finished, failed; one that the next run of its project found unfinished is abandoned."""
    counters = [c for c in log.columns if c not in ("project_id", "run_id", "at", "seq", "event")]
    folded = log.groupBy("project_id", "run_id").agg(
        F.min("at").alias("started_at"), F.max(F.when(F.col("event") != "started", F.col("at"))).alias("finished_at"), F.max_by("event", F.struct(*ORDER)).alias("_event"), *[last_known(c).alias(c) for c in counters]
    )
    following = F.lead("started_at").over(Window.partitionBy("project_id").orderBy("started_at", "run_id"))
    status = F.when(F.col("_event") != "started", F.col("_event")).when(following.isNotNull(), "abandoned").otherwise("running")
    return folded.withColumn("status", status).drop("_event")


def cache_entries(log: DataFrame) -> DataFrame:
    """Cached contexts after ``(project_id, key, at, seq, event, token_estimate, files)`` rows: stored, used, cleared.

    Storing again keeps the first time and begins to count uses anew; what was stored before the last clearing of its project is gone.
    """
    cleared = log.where("event = 'cleared'").groupBy("project_id").agg(F.max(F.struct(*ORDER)).alias("_cleared"))
    kept = log.where("event <> 'cleared'").join(F.broadcast(cleared), "project_id", "left").where("_cleared IS NULL OR struct(at, seq) > _cleared")  # a row for each project
    stored = kept.where("event = 'stored'").groupBy("project_id", "key").agg(F.max(F.struct(*ORDER)).alias("_stored"), F.min("at").alias("created_at"), last_known("token_estimate").alias("token_estimate"), last_known("files").alias("files"))
    used = kept.where("event = 'used'").join(stored.select("project_id", "key", "_stored"), ["project_id", "key"]).where("struct(at, seq) > _stored").groupBy("project_id", "key").agg(F.countDistinct("seq").alias("hits"), F.max("at").alias("_used"))
    return stored.join(used, ["project_id", "key"], "left").select("project_id", "key", "token_estimate", "files", "created_at", F.coalesce("_used", "_stored.at").alias("last_used_at"), F.coalesce("hits", F.lit(0)).alias("hits"))


def status_bundle(projects: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``projects`` with the figures of each part ``(project_id, ...)``; a count without rows is 0, other figures are null."""
    joined = projects
    for part in parts:
        joined = joined.join(part, "project_id", "left")
    counts = [name for part in parts for name, kind in part.dtypes if name != "project_id" and not name.endswith("_us") and kind in ("bigint", "int")]
    return joined.fillna(0, counts)
