"""Queries of the event-sourced stores, over logs that are derived from the tables at hand, and their DuckDB counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import knowledge, sessions, stores
from loomstead.plans import data_quality
from loomstead.plans.reference_queries import live
from loomstead.session import table, utc_micros

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


HOUR, DAY = 3_600_000_000, 86_400_000_000
NOW = 1_464_739_200_000_000  # 2016-06-01


# ---------------------------------------------------------------- records: documents of kind memory begin with their type

def _memory_log(spark, root) -> DataFrame:
    notes = table(spark, root, "documents").where("kind = 'memory' AND text IS NOT NULL AND created_at IS NOT NULL AND source IS NOT NULL").select(
        F.col("source").alias("project_id"), F.col("doc_id").alias("memory_id"), utc_micros(F.col("created_at")).alias("at"), F.regexp_extract("text", r"^\s*([A-Z]+): ", 1).alias("type"), "text", "lang", "n_chars"
    )
    none = lambda kind: F.lit(None).cast(kind)
    event = lambda rows, name, after, seq: rows.select(
        "project_id", "memory_id", (F.col("at") + after).alias("at"), seq.alias("seq"), F.lit(name).alias("event"), none("string").alias("type"), none("string").alias("title"), none("string").alias("content"), none("double").alias("importance"),
        none("double").alias("confidence"), none("array<string>").alias("tags"), none("array<string>").alias("paths"), none("string").alias("branch"), none("long").alias("expires_at"), none("long").alias("supersedes"),
    )
    first = event(notes.drop("type"), "remembered", 0, F.col("memory_id") * 100)
    first = notes.select(
        "project_id", "memory_id", "at", (F.col("memory_id") * 100).alias("seq"), F.lit("remembered").alias("event"), "type", F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), none("double").alias("importance"), none("double").alias("confidence"),
        F.array("lang").alias("tags"), none("array<string>").alias("paths"), none("string").alias("branch"), F.when(F.col("type") == "HISTORY", F.col("at") + 30 * DAY).alias("expires_at"), F.when(F.col("memory_id") % 13 == 0, F.col("memory_id") - 1).alias("supersedes"),
    )
    seen = notes.join(table(spark, root, "subject_labels").select(F.col("doc_id").alias("memory_id"), F.length("subject").alias("_n")), "memory_id")
    parts = [
        first, event(notes.where("n_chars % 7 = 0"), "archived", HOUR, F.col("memory_id") * 100 + 1), event(seen, "accessed", 2 * HOUR, F.col("memory_id") * 100 + 2 + F.col("_n")), event(notes.where("n_chars % 11 = 0"), "forgotten", 3 * HOUR, F.col("memory_id") * 100 + 99),
    ]
    return reduce(DataFrame.unionByName, parts)


def _memories(spark, root) -> DataFrame:
    return stores.memory_state(_memory_log(spark, root))


_IMPORTANCE_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in knowledge.IMPORTANCE.items()) + " END"
_NOTES_SQL = r"""notes AS (SELECT source AS project_id, doc_id AS memory_id, epoch_us(created_at) AS at_us, regexp_extract(text, '^\s*([A-Z]+): ', 1) AS type, text, lang, n_chars
 FROM documents WHERE kind = 'memory' AND text IS NOT NULL AND created_at IS NOT NULL AND source IS NOT NULL)"""
_RECORDS_SQL = f"""{_NOTES_SQL}, kept AS (SELECT *, {_IMPORTANCE_SQL} AS importance FROM notes WHERE type IN ({', '.join(f"'{k}'" for k in knowledge.IMPORTANCE)}) AND length(trim(substr(text, 1, 60))) >= 3 AND length(trim(text)) >= 8 AND n_chars % 11 <> 0),
records AS (SELECT k.*, CASE WHEN EXISTS (SELECT 1 FROM notes s WHERE s.memory_id % 13 = 0 AND s.memory_id - 1 = k.memory_id AND s.project_id = k.project_id) OR n_chars % 7 = 0 THEN 'archived' ELSE 'active' END AS status,
 CASE WHEN n_chars % 7 = 0 THEN at_us + {HOUR} ELSE at_us END AS updated_at, coalesce(a.n, 0) AS accesses, CASE WHEN type = 'HISTORY' THEN at_us + {30 * DAY} END AS expires_at
 FROM kept k LEFT JOIN (SELECT doc_id, count(DISTINCT length(subject)) AS n FROM subject_labels GROUP BY ALL) a ON a.doc_id = k.memory_id)"""


@query(f"WITH {_RECORDS_SQL} SELECT project_id, memory_id, type, status, importance, accesses, updated_at, expires_at, lang AS tag FROM records")
def memory_records(spark, root):
    return _memories(spark, root).select("project_id", "memory_id", "type", "status", "importance", "accesses", "updated_at", "expires_at", F.get("tags", F.lit(0)).alias("tag"))


@query(f"WITH {_RECORDS_SQL} SELECT project_id, memory_id, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY importance DESC, updated_at DESC, memory_id) AS place FROM records WHERE status = 'active' AND importance >= 0.6) WHERE place <= 5")
def memory_list(spark, root):
    return stores.memory_list(_memories(spark, root), least=0.6, per_project=5).select("project_id", "memory_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_RECORDS_SQL} SELECT project_id, count(*) AS total, count(CASE WHEN status = 'active' THEN 1 END) AS active, count(CASE WHEN status = 'archived' THEN 1 END) AS archived, count(CASE WHEN status = 'active' AND expires_at <= {NOW} THEN 1 END) AS expired,
 round(coalesce(CAST(sum(CASE WHEN status = 'active' THEN CAST(importance AS DECIMAL(9, 4)) END) AS DOUBLE) / nullif(count(CASE WHEN status = 'active' THEN 1 END), 0), 0), 3) AS average_importance FROM records GROUP BY ALL""")
def memory_stats(spark, root):
    return stores.memory_stats(_memories(spark, root), F.lit(NOW))


@query(f"""WITH {_NOTES_SQL}, log AS (SELECT project_id, memory_id, at_us AS "at", memory_id * 100 AS seq, 'remembered' AS event FROM notes UNION ALL SELECT project_id, memory_id, at_us + {HOUR}, memory_id * 100 + 1, 'archived' FROM notes WHERE n_chars % 7 = 0
UNION ALL SELECT project_id, memory_id, at_us + {2 * HOUR}, memory_id * 100 + 2 + length(subject), 'accessed' FROM notes JOIN subject_labels ON doc_id = memory_id UNION ALL SELECT project_id, memory_id, at_us + {3 * HOUR}, memory_id * 100 + 99, 'forgotten' FROM notes WHERE n_chars % 11 = 0)
SELECT project_id, place, event, "at" FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "at" DESC, seq DESC) AS place FROM log) WHERE place <= 6""")
def memory_timeline(spark, root):
    return stores.timeline(_memory_log(spark, root), ["project_id"], newest=6).select("project_id", F.col("place").cast("long").alias("place"), "event", "at")


@query(f"""WITH {_RECORDS_SQL}, h AS (SELECT *, type || '|' || trim(regexp_replace(lower(substr(text, 1, 60)), '\\s+', ' ', 'g')) || '|' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS same FROM records)
SELECT n.memory_id AS ask_id, arg_min(h.memory_id, (h.at_us, h.memory_id)) AS memory_id FROM (SELECT *, type || '|' || trim(regexp_replace(lower(substr(text, 1, 60)), '\\s+', ' ', 'g')) || '|' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS same FROM notes) n JOIN h ON h.project_id = n.project_id AND h.same = n.same GROUP BY ALL""")
def memory_same(spark, root):
    asked = _memory_log(spark, root).where("event = 'remembered'").select(F.col("memory_id").alias("ask_id"), "project_id", "type", "title", "content")
    return stores.find_by_hash(_memories(spark, root), asked)


@query(f"""WITH {_RECORDS_SQL}, live AS (SELECT * FROM records WHERE status = 'active' AND (expires_at IS NULL OR expires_at > {NOW}))
SELECT memory_id, round(0.5 * 0.5 + 0.3 * importance + 0.1 * pow(0.5, greatest(0, date_diff('day', CAST(make_timestamp(updated_at) AS DATE), DATE '2016-06-01')) / 90.0) + 0.05 * 0.8 + least(0.1, 0.01 * accesses), 4) AS score FROM live ORDER BY score DESC, memory_id LIMIT 50""")
def recall_scored(spark, root):
    """The records that matter most, through the operator."""
    rows = _memories(spark, root).withColumn("updated_at", F.timestamp_micros("updated_at")).withColumn("expires_at", F.timestamp_micros("expires_at"))
    return knowledge.recall(rows, F.timestamp_micros(F.lit(NOW)), limit=50).select("memory_id", "score")


# ---------------------------------------------------------------- tasks: orders, which move by their status

def _task_log(spark, root) -> DataFrame:
    orders = table(spark, root, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 40).alias("project_id"), F.col("o_orderkey").alias("task_id"), utc_micros(F.col("o_orderdate")).alias("day"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("priority"))
    event = lambda rows, status, days, reason=None: rows.select(
        "project_id", "task_id", (F.col("day") + days * DAY).alias("at"), F.lit(days).alias("seq"), F.lit(status).alias("status"), F.concat(F.lit("order "), "task_id").alias("title"), F.col("priority") if status == "READY" else F.lit(None).cast("string").alias("priority"),
        F.lit(reason).cast("string").alias("blocked_reason"), F.array(F.lit(status)).alias("tags"), F.lit(None).cast("array<string>").alias("paths"), F.lit(None).cast("string").alias("branch"),
    )
    parts = [event(orders, "READY", 0), event(orders.where("s IN ('P', 'F')"), "IN_PROGRESS", 1), event(orders.where("s = 'F'"), "COMPLETED", 2), event(orders.where("task_id % 10 = 0"), "IDEA", 3), event(orders.where("task_id % 7 = 0"), "BLOCKED", 4, "waiting")]
    return reduce(DataFrame.unionByName, parts)


_TASKS_SQL = f"""o AS (SELECT 'p' || o_custkey % 40 AS project_id, o_orderkey AS task_id, epoch_us(o_orderdate) AS day, o_orderstatus AS s, o_orderpriority AS priority FROM orders),
tasks AS (SELECT project_id, task_id, priority, CASE WHEN task_id % 7 = 0 AND s <> 'F' THEN 'BLOCKED' WHEN s = 'F' THEN 'COMPLETED' WHEN s = 'P' THEN 'IN_PROGRESS' ELSE 'READY' END AS status,
 CAST((task_id % 10 = 0)::INT + (task_id % 7 = 0 AND s = 'F')::INT AS BIGINT) AS refused, CASE WHEN s IN ('P', 'F') THEN day + {DAY} END AS started_at, CASE WHEN s = 'F' THEN day + {2 * DAY} END AS completed_at, CASE WHEN task_id % 7 = 0 AND s <> 'F' THEN 'waiting' END AS blocked_reason,
 day + {DAY} * CASE WHEN task_id % 7 = 0 THEN 4 WHEN task_id % 10 = 0 THEN 3 WHEN s = 'F' THEN 2 WHEN s = 'P' THEN 1 ELSE 0 END AS updated_at FROM o)"""
_RANK_SQL = "CASE status " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(knowledge.STATUSES)) + " END"


@query(f"WITH {_TASKS_SQL} SELECT * FROM tasks")
def task_states(spark, root):
    return stores.task_state(_task_log(spark, root)).select("project_id", "task_id", "priority", "status", "refused", "started_at", "completed_at", "blocked_reason", "updated_at")


@query(f"WITH {_TASKS_SQL} SELECT project_id, task_id, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_RANK_SQL}, updated_at DESC, task_id) AS place FROM tasks WHERE status IN ({', '.join(repr(s) for s in knowledge.OPEN)})) WHERE place <= 10")
def task_list(spark, root):
    return stores.task_list(stores.task_state(_task_log(spark, root)), open_only=True, per_project=10).select("project_id", "task_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_TASKS_SQL} SELECT project_id, arg_min(task_id, ({_RANK_SQL}, -updated_at, -task_id)) AS task_id FROM tasks WHERE status IN ('IN_PROGRESS', 'BLOCKED', 'TESTING') GROUP BY ALL")
def task_current(spark, root):
    return stores.current_tasks(stores.task_state(_task_log(spark, root)))


@query(f"""WITH {_TASKS_SQL} SELECT project_id, count(*) AS total, count(CASE WHEN status IN ({', '.join(repr(s) for s in knowledge.OPEN)}) THEN 1 END) AS open, count(CASE WHEN status = 'BLOCKED' THEN 1 END) AS blocked, count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS completed FROM tasks GROUP BY ALL""")
def task_stats(spark, root):
    return stores.task_stats(stores.task_state(_task_log(spark, root)))


@query("""WITH r AS (SELECT l_orderkey AS task_id, l_linenumber AS position, l_returnflag || l_partkey AS text, l_linestatus = 'F' OR (bool_or(l_quantity > 25) OVER (PARTITION BY l_orderkey, l_linenumber) AND l_linenumber % 2 = 1) OR l_partkey % 5 = 0 AS done FROM lineitem)
SELECT o_orderkey AS task_id, coalesce(string_agg(position || ':' || text || ':' || CASE WHEN done THEN 'x' ELSE '-' END, ',' ORDER BY position, text, done), '') AS requirements, CAST(coalesce(max(position) + 1, 0) AS BIGINT) AS next_position FROM orders LEFT JOIN r ON task_id = o_orderkey GROUP BY ALL""")
def task_requirements(spark, root):
    """Requirements after ticks by place and by text, nested in their tasks."""
    lines = table(spark, root, "lineitem")
    own = lines.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("position"), F.concat("l_returnflag", "l_partkey").alias("text"), (F.col("l_linestatus") == "F").alias("done"))
    mark = lambda rows, position, text: rows.select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("at"), F.lit(0).alias("seq"), position.alias("position"), text.alias("text"), F.lit(True).alias("done"))
    by_place = mark(lines.where("l_quantity > 25 AND l_linenumber % 2 = 1"), F.col("l_linenumber"), F.lit(None).cast("string"))
    by_text = mark(lines.where("l_partkey % 5 = 0"), F.lit(None).cast("int"), F.lower(F.concat("l_returnflag", "l_partkey")))
    nested = stores.with_requirements(table(spark, root, "orders").select(F.col("o_orderkey").alias("task_id")), stores.tick(own, by_place.unionByName(by_text)))
    shown = F.array_join(F.transform("requirements", lambda x: F.concat_ws(":", x["position"], x["text"], F.when(x["done"], "x").otherwise("-"))), ",")
    return nested.select("task_id", shown.alias("requirements"), F.col("next_position").cast("long").alias("next_position"))


# ---------------------------------------------------------------- sessions: stretches of activity as started and ended events

def _session_log(spark, root) -> DataFrame:
    rows = sessions.sessionize(table(spark, root, "activity")).select("project_id", F.concat_ws("/", "agent", "start_us").alias("session_id"), "agent", "start_us", "end_us")
    none = F.lit(None).cast("string")
    event = lambda at, name, seq: rows.select("project_id", "session_id", F.col(at).alias("at"), F.lit(seq).alias("seq"), F.lit(name).alias("event"), "agent", none.alias("task_id"), none.alias("summary"), none.alias("next_step"), F.array().cast("array<string>").alias("files"))
    return event("start_us", "started", 0).unionByName(event("end_us", "ended", 1))


_WORK_SQL = f"""raw AS ({data_quality.SQL['p4_found']}), s AS (SELECT project_id, agent || '/' || start_us AS session_id, start_us AS started_at, end_us AS given FROM raw),
f AS (SELECT *, lead(started_at) OVER (PARTITION BY project_id ORDER BY started_at, session_id) AS following FROM s),
work AS (SELECT project_id, session_id, started_at, CASE WHEN given <= coalesce(following, given) THEN given ELSE following END AS ended_at FROM f)"""


@query(f"WITH {_WORK_SQL} SELECT *, CASE WHEN ended_at IS NULL THEN 'active' ELSE 'ended' END AS status FROM work")
def work_sessions(spark, root):
    return stores.session_state(_session_log(spark, root)).select("project_id", "session_id", "started_at", "ended_at", "status")


@query(f"WITH {_WORK_SQL} SELECT project_id, CAST(NULL AS VARCHAR) AS active, arg_max(session_id, (ended_at, session_id)) AS last_ended, count(*) AS sessions FROM work GROUP BY ALL")
def session_heads(spark, root):
    return stores.session_heads(stores.session_state(_session_log(spark, root)))


# ---------------------------------------------------------------- projects and workspaces

def _connects(spark, root) -> DataFrame:
    rows = table(spark, root, "activity").where("project_id IS NOT NULL AND at IS NOT NULL")
    return rows.select("project_id", utc_micros(F.col("at")).alias("at"), F.col("id").alias("seq"), F.col("project_name").alias("name"), F.concat(F.lit("/work/"), F.lower(F.trim("agent"))).alias("path"), F.col("tool").alias("framework"), F.col("outcome").alias("package_manager"), F.lit(None).cast("string").alias("status"))


_CONNECTS_SQL = """c AS (SELECT project_id, epoch_us("at") AS moment, id, project_name AS name, '/work/' || lower(trim(agent)) AS path, tool AS framework, outcome AS package_manager FROM activity WHERE project_id IS NOT NULL AND "at" IS NOT NULL)"""
_REGISTRY_SQL = f"""{_CONNECTS_SQL}, registry AS (SELECT project_id, arg_max(path, (moment, id)) FILTER (path IS NOT NULL) AS path, arg_max(framework, (moment, id)) FILTER (framework IS NOT NULL) AS framework,
 arg_max(package_manager, (moment, id)) FILTER (package_manager IS NOT NULL) AS package_manager, arg_min(name, (moment, id)) FILTER (name IS NOT NULL) AS name, min(moment) AS first_seen_at, max(moment) AS last_seen_at FROM c GROUP BY ALL),
history AS (SELECT project_id, path, min(moment) AS first_seen_at, max(moment) AS last_seen_at FROM c WHERE path IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_REGISTRY_SQL} SELECT *, 'active' AS status FROM registry")
def registry_states(spark, root):
    return stores.registry_state(_connects(spark, root))


@query(f"WITH {_REGISTRY_SQL} SELECT * FROM history")
def path_histories(spark, root):
    return stores.path_history(_connects(spark, root))


@query(f"""WITH {_REGISTRY_SQL}, asks AS (SELECT id AS ask FROM projects UNION SELECT upper(name) FROM projects UNION SELECT DISTINCT path FROM history UNION SELECT '/nowhere'),
ways AS (SELECT project_id AS k, project_id, 'id' AS how, 0 AS way, last_seen_at FROM registry UNION ALL SELECT lower(name), project_id, 'name', 1, last_seen_at FROM registry UNION ALL SELECT path, project_id, 'path', 2, last_seen_at FROM registry UNION ALL SELECT path, project_id, 'history', 3, last_seen_at FROM history)
SELECT ask, arg_min(project_id, (way, -last_seen_at, project_id)) AS project_id, arg_min(how, (way, -last_seen_at, project_id)) AS how FROM asks JOIN ways ON k = ask OR k = lower(ask) GROUP BY ALL""")
def resolved_projects(spark, root):
    connects = _connects(spark, root)
    times = lambda rows: rows.withColumn("last_seen_at", F.timestamp_micros("last_seen_at"))
    history = stores.path_history(connects)
    projects = table(spark, root, "projects")
    asked = projects.select(F.col("id").alias("ask")).union(projects.select(F.upper("name"))).union(history.select("path")).union(spark.sql("SELECT '/nowhere'")).distinct()
    return stores.resolve(times(stores.registry_state(connects)), times(history), asked)


def _members(spark, root) -> DataFrame:
    projects = table(spark, root, "projects").select(F.col("id").alias("project_id"), F.coalesce("primary_language", F.lit("none")).alias("workspace_id"), utc_micros(F.col("connected_at")).alias("at"), F.length("name").alias("n"), F.when(F.col("remote_url").isNotNull(), "main").alias("role"))
    event = lambda rows, name, hours, role: rows.select("workspace_id", "project_id", (F.col("at") + hours * HOUR).alias("at"), F.lit(hours).alias("seq"), F.lit(name).alias("event"), role.cast("string").alias("role"))
    log = event(projects, "added", 0, F.col("role")).unionByName(event(projects.where("n % 5 = 0"), "removed", 1, F.lit(None))).unionByName(event(projects.where("n % 10 = 0"), "added", 2, F.lit(None)))
    return stores.workspace_members(log, projects.select("project_id", F.lit("active").alias("status")))


_MEMBERS_SQL = f"""m AS (SELECT coalesce(primary_language, 'none') AS workspace_id, id AS project_id, CASE WHEN remote_url IS NOT NULL THEN 'main' END AS role, epoch_us(connected_at) + CASE WHEN length(name) % 10 = 0 THEN {2 * HOUR} ELSE 0 END AS added_at FROM projects WHERE length(name) % 5 <> 0 OR length(name) % 10 = 0),
members AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY added_at, project_id) AS place FROM m)"""


@query(f"WITH {_MEMBERS_SQL} SELECT * FROM members")
def workspace_members(spark, root):
    return _members(spark, root).withColumn("place", F.col("place").cast("long"))


_LIVE_SQL = "live AS (SELECT id AS file_id, arg_max(project_id, indexed_at) AS project_id, arg_max(relative_path, indexed_at) AS relative_path, arg_max(status, indexed_at) AS status FROM files GROUP BY id HAVING arg_max(status, indexed_at) = 'active')"


@query(f"""WITH {_MEMBERS_SQL}, {_LIVE_SQL}, p AS (SELECT workspace_id, m.project_id, file_id AS id, round(1.0 / length(relative_path), 4) AS relevance, place AS member FROM live JOIN members m ON m.project_id = live.project_id)
SELECT workspace_id, project_id, id, relevance, place FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY relevance DESC, member, id) AS place FROM p) WHERE place <= 20""")
def workspace_merged(spark, root):
    """Ranked rows of all members of each workspace as one list."""
    parts = live(spark, root).select("project_id", F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.round(1.0 / F.length("relative_path"), 4).alias("relevance"))
    return stores.merge_workspace(parts, _members(spark, root), limit=20).select("workspace_id", "project_id", "id", "relevance", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- index runs and cached contexts

@query(f"""WITH r AS (SELECT project_id, epoch_us(indexed_at) // {DAY} AS run_id, min(epoch_us(indexed_at)) AS started_at, max(epoch_us(indexed_at)) AS last_at, count(DISTINCT id) AS n FROM files WHERE indexed_at IS NOT NULL GROUP BY ALL),
f AS (SELECT *, n % 3 <> 0 AS done, lead(started_at) OVER (PARTITION BY project_id ORDER BY started_at, run_id) AS following FROM r)
SELECT project_id, run_id, started_at, CASE WHEN done THEN last_at + 1 END AS finished_at, CASE WHEN done THEN n END AS scanned, CASE WHEN done THEN 'finished' WHEN following IS NOT NULL THEN 'abandoned' ELSE 'running' END AS status FROM f""")
def index_runs(spark, root):
    rows = table(spark, root, "files").where("indexed_at IS NOT NULL").select("project_id", "id", utc_micros(F.col("indexed_at")).alias("us"))
    runs = rows.groupBy("project_id", F.expr(f"us div {DAY}").alias("run_id")).agg(F.min("us").alias("first"), F.max("us").alias("last"), F.countDistinct("id").alias("n"))
    log = runs.select("project_id", "run_id", F.col("first").alias("at"), F.lit(0).alias("seq"), F.lit("started").alias("event"), F.lit(None).cast("long").alias("scanned"))
    return stores.run_state(log.unionByName(runs.where("n % 3 <> 0").select("project_id", "run_id", (F.col("last") + 1).alias("at"), F.lit(1).alias("seq"), F.lit("finished").alias("event"), F.col("n").alias("scanned"))))


@query(f"""WITH c AS (SELECT DISTINCT ON (id) * FROM context_cache), k AS (SELECT project_id, min(epoch_us(created_at)) + {DAY} AS cleared FROM c GROUP BY ALL),
s AS (SELECT c.project_id, key, max(epoch_us(created_at)) AS stored, min(epoch_us(created_at)) AS created_at, arg_max(token_estimate, epoch_us(created_at)) AS token_estimate FROM c JOIN k USING (project_id) WHERE epoch_us(created_at) > cleared GROUP BY ALL),
u AS (SELECT s.project_id, s.key, count(DISTINCT c.id) AS hits, max(epoch_us(last_used_at)) AS used FROM s JOIN c ON c.project_id = s.project_id AND c.key = s.key JOIN k ON k.project_id = s.project_id WHERE c.hits > 0 AND epoch_us(last_used_at) > stored AND epoch_us(last_used_at) > cleared GROUP BY ALL)
SELECT project_id, key, token_estimate, created_at, coalesce(used, stored) AS last_used_at, coalesce(hits, 0) AS hits FROM s LEFT JOIN u USING (project_id, key)""")
def cache_entries(spark, root):
    rows = table(spark, root, "context_cache").dropDuplicates(["id"]).select("project_id", "key", utc_micros(F.col("created_at")).alias("created"), utc_micros(F.col("last_used_at")).alias("used"), "token_estimate", "hits", F.xxhash64("id").alias("seq"))
    none = F.lit(None)
    files = none.cast("array<string>").alias("files")
    log = rows.select("project_id", "key", F.col("created").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("stored").alias("event"), "token_estimate", files)
    log = log.unionByName(rows.where("hits > 0").select("project_id", "key", F.col("used").alias("at"), "seq", F.lit("used").alias("event"), none.cast("long").alias("token_estimate"), files))
    clear = rows.groupBy("project_id").agg((F.min("created") + DAY).alias("at")).select("project_id", none.cast("string").alias("key"), "at", F.lit(1 << 62).alias("seq"), F.lit("cleared").alias("event"), none.cast("long").alias("token_estimate"), files)
    return stores.cache_entries(log.unionByName(clear)).drop("files")


# ---------------------------------------------------------------- requests

_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(T.REQUEST_STOPWORDS)) + "]"


@query(f"""SELECT DISTINCT id AS request_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(task, '')), '[a-z0-9_$]{{2,}}'), lambda w, i: NOT list_contains({_STOP_SQL}, w) AND list_position(regexp_extract_all(lower(coalesce(task, '')), '[a-z0-9_$]{{2,}}'), w) = i)[1:24], ' ') AS terms,
 length(coalesce(task, '')) AS size FROM context_cache""")
def request_terms(spark, root):
    rows = table(spark, root, "context_cache")
    return rows.select(F.col("id").alias("request_id"), F.array_join(T.request_terms(F.col("task")), " ").alias("terms"), F.length(F.coalesce("task", F.lit(""))).cast("long").alias("size")).distinct()
