"""One object per data directory with the calls that a client of the index makes.

Calls give DataFrames. Those of names, searches, impact and context run small jobs of their own while they are built (counts, figures,
ranks); the others are lazy. What clients tell (records, tasks, sessions) is appended to logs in the ``state`` folder and folded on reading.
"""

from __future__ import annotations

import itertools
import os
import re
import time
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import context, contracts, graph, health, ingest, knowledge, postings, search, stores
from loomstead.session import materialise, table


class Index:
    """The tables of a data directory, optionally narrowed to some projects (a workspace)."""

    def __init__(self, spark: SparkSession, root: str, projects: list[str] | None = None, state: str | None = None) -> None:
        self.spark, self.root, self.projects, self.state = spark, root, projects, state

    def _table(self, name: str) -> DataFrame:
        rows = table(self.spark, self.root, name)
        return rows.where(F.col("project_id").isin(self.projects)) if self.projects is not None else rows

    @cached_property
    def files(self) -> DataFrame:
        """Active files as they are."""
        log = self._table("files").where("id IS NOT NULL")
        return ingest.latest(log, ["id"], [F.col("indexed_at")]).withColumnRenamed("id", "file_id").where("status = 'active'")

    @cached_property
    def texts(self) -> DataFrame:
        return self._table("file_search").dropDuplicates(["file_id"])

    @cached_property
    def symbols(self) -> DataFrame:
        return self._table("symbols").dropDuplicates(["id"]).join(self.files.select("file_id", "relative_path"), "file_id")

    @cached_property
    def imports(self) -> DataFrame:
        return self._table("imports").dropDuplicates(["id"])

    @cached_property
    def edges(self) -> DataFrame:
        return graph.import_edges(self.imports, self.files)

    # files
    def find_file(self, part: str, limit: int = 20) -> DataFrame:
        safe = re.sub(r"([\\%_])", r"\\\1", part)
        return self.files.where(F.col("relative_path").ilike(f"%{safe}%")).orderBy(F.length("relative_path"), "relative_path", "file_id").limit(limit)

    def recent_files(self, limit: int = 20) -> DataFrame:
        return self.files.orderBy(F.col("last_modified").desc(), "file_id").limit(limit)

    # symbols
    def find_symbol(self, name: str, *, kind: str | None = None, exported: bool | None = None, limit: int = 25) -> DataFrame:
        """Symbols of exactly that name in any case; where there is none, those that contain it."""
        rows = self.symbols.where(F.col("type") == kind) if kind else self.symbols
        rows = rows.where(F.col("exported") == exported) if exported is not None else rows
        same = (F.lower("name") == name.lower()) | (F.lower("qualified_name") == name.lower())
        hits = rows.where(F.col("name").ilike("%" + re.sub(r"([\\%_])", r"\\\1", name) + "%") | F.col("qualified_name").ilike("%" + re.sub(r"([\\%_])", r"\\\1", name) + "%"))
        tier = hits.agg(F.min(F.when(same, 0).otherwise(1))).first()[0]
        kept = hits.where(same) if tier == 0 else hits
        return kept.orderBy(F.col("exported").desc(), F.length("name"), "name", "id").limit(limit)

    def get_definition(self, name: str) -> DataFrame:
        """The likeliest definition of a name, with its lines of source, redacted."""
        score = (
            F.when(F.col("name") == name, 10).when(F.lower("name") == name.lower(), 4).otherwise(0) + F.when(F.col("qualified_name") == name, 8).otherwise(0) + F.col("exported").cast("int") * 3
            + F.when(F.col("type").isin("class", "interface", "function", "type", "component", "hook"), 2).when(F.col("type").isin("variable", "property"), -2).otherwise(0)
        )
        best = self.find_symbol(name, limit=10).withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(1)
        lines = F.slice(F.split("content", "\r?\n"), F.col("line_start").cast("int"), F.greatest(F.lit(1), (F.col("line_end") - F.col("line_start") + 1).cast("int")))
        return best.join(self.texts.select("file_id", "content"), "file_id", "left").select(
            "id", "name", "qualified_name", "type", "relative_path", "line_start", "line_end", "score", T.redact(F.array_join(lines, "\n")).alias("source")
        )

    def find_references(self, name: str) -> DataFrame:
        """References to a name per file: ``(relative_path, lines)``."""
        rows = self._table("symbol_references").dropDuplicates(["id"]).where(F.col("name") == name)
        return rows.join(self.files.select("file_id", "relative_path"), "file_id").groupBy("project_id", "relative_path").agg(F.array_sort(F.collect_set("line")).alias("lines"))

    def related_code(self, path: str) -> DataFrame:
        """Files that a file imports, that import it, or that define what it refers to: ``(relation, relative_path)``."""
        own = self.files.where(F.col("relative_path") == path).select("file_id", "project_id")
        names = self.files.select("file_id", "relative_path")
        side = lambda here, there, what: self.edges.join(own.select(F.col("file_id").alias(here)), here, "left_semi").select(F.col(there).alias("file_id"), F.lit(what).alias("relation"))
        refs = self._table("symbol_references").join(own.select("file_id"), "file_id", "left_semi").select("project_id", "name").distinct()
        defined = self.symbols.where("exported").join(refs, ["project_id", "name"], "left_semi").join(own.select("file_id"), "file_id", "left_anti").select("file_id", F.lit("defines").alias("relation"))
        return side("source", "target", "imports").unionByName(side("target", "source", "imported by")).unionByName(defined).distinct().join(names, "file_id").select("relation", "relative_path")

    def impact_analysis(self, path: str, depth: int = 3) -> DataFrame:
        origins = self.files.where(F.col("relative_path") == path).select(F.col("file_id").alias("origin"))
        return graph.impact(self.edges, self.files, origins, depth=depth)

    def affected_tests(self, paths: list[str], depth: int = 3) -> DataFrame:
        """Tests that the files reach; a test among them counts itself."""
        chosen = self.files.where(F.col("relative_path").isin(paths))
        reached = graph.impact(self.edges, self.files, chosen.select(F.col("file_id").alias("origin")), depth=depth).where("is_test").select("relative_path")
        return reached.unionByName(chosen.where(T.looks_like_test(F.col("relative_path"))).select("relative_path")).distinct()

    # search and context
    def search_context(self, query: str, limit: int = 15) -> DataFrame:
        """Symbols and files for a query in one list, each with the first line that holds one of its words."""
        named = self.symbols.select("id", T.split_identifier(F.col("name")).alias("name"), T.split_identifier(F.col("qualified_name")).alias("qualified"), "signature", "relative_path")
        first = search.search(named, query, {"name": 10, "qualified": 6, "signature": 1, "relative_path": 2}, k=limit).select(F.lit("symbol").alias("kind"), "id", "relevance")
        second = search.search(self.texts, query, {"path": 8, "content": 1, "identifiers": 4}, k=limit, key="file_id").select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "relevance")
        merged = search.merge_ranked(first, second, k=limit)
        words = [w for w in T.query_terms(query) if len(w) >= 3][:8]
        hit = F.filter(F.split("content", "\r?\n"), lambda line: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(line), w))) if words else F.array(F.lit(""))
        snippet = self.texts.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("path"), F.substring(F.trim(T.redact(F.get(hit, F.lit(0)))), 1, 200).alias("snippet"))
        return merged.join(snippet, ["kind", "id"], "left").orderBy(F.col("relevance").desc(), "kind", "id")

    def get_context(self, task: str, *, paths: list[str] = (), budget: int = 6000, max_files: int = 12, include_source: bool | None = None, changed: list[str] | str = ()) -> DataFrame:
        """Files for a task within a token budget, in each project of the index: ``(project_id, path, level, tokens, relevance, reasons, position, truncated)``.

        All kinds of evidence count, each within its project. Source is included for requests about errors, or as ``include_source`` says, for four files.
        ``changed`` are paths that were changed lately, as git tells them, or ``latest`` for the ten that were modified last.
        """
        asked = self.files.select("project_id").distinct().select(F.col("project_id").alias("request_id"), "project_id", F.lit(" ".join([task, *paths])).alias("task"))
        return self._contexts(asked, budget, max_files, include_source, changed)

    def _contexts(self, asked: DataFrame, budget: int, max_files: int, include_source: bool | None, changed: list[str] | str = ()) -> DataFrame:
        asks = asked.withColumn("intent", T.detect_intent(F.col("task")))
        files = self.files.drop("path").withColumnRenamed("relative_path", "path")
        own = files.select("project_id", "file_id", "path")
        symbols = self.symbols.withColumnRenamed("relative_path", "path")
        texts = self.texts.drop("path").join(own.select("file_id", "path"), "file_id")
        named = symbols.select("id", "project_id", T.split_identifier(F.col("name")).alias("name"), T.split_identifier(F.col("qualified_name")).alias("qualified"), "signature", F.col("path").alias("relative_path"))
        by_symbol = postings.search(postings.build(named, {"name": 10, "qualified": 6, "signature": 1, "relative_path": 2}), asks, k=20).join(symbols.select(F.col("id").alias("key"), "path"), "key")
        by_text = postings.search(postings.build(texts, {"path": 8, "content": 1, "identifiers": 4}, key="file_id"), asks, k=15).join(own.select(F.col("file_id").alias("key"), "path"), "key")
        row = lambda rows, kind, strength, why: rows.select("request_id", "path", F.lit(kind).alias("component"), strength.alias("strength"), F.lit(why).alias("reason"))
        parts = [
            context.named_paths(asks, own), context.named_symbols(asks, symbols), row(by_symbol, "search", F.col("relevance"), "symbol match"), row(by_text, "search", F.col("relevance") * 0.8, "content match"),
            context.words_in_paths(asks, own),
        ]
        if changed == "latest":
            parts.append(context.recent_changes(asks, files))
        elif changed:
            parts.append(row(asks.select("request_id", "project_id").join(own.where(F.col("path").isin(list(changed))), "project_id"), "recent", F.lit(1.0), "changed lately"))
        if (records := self._memory()) is not None:
            told = records.where("status = 'active'").select("project_id", F.col("memory_id").alias("id"), F.concat_ws(" ", "title", "content", F.array_join("paths", " ")).alias("text"), "importance")
            parts.append(context.remembered(asks, told, own))
        evidence = materialise(reduce(DataFrame.unionByName, parts))
        scored = context.combine(evidence).join(asks.select("request_id", "project_id", "intent"), "request_id")
        names = own.select("file_id", "path")
        edges = self.edges.join(names.withColumnsRenamed({"file_id": "source", "path": "_s"}), "source").join(names.withColumnsRenamed({"file_id": "target", "path": "_t"}), "target").select("project_id", F.col("_s").alias("source"), F.col("_t").alias("target")).distinct()
        wanted = F.col("intent") == "debug" if include_source is None else F.lit(include_source)
        highlighted = evidence.where("component = 'symbol'").groupBy("request_id", "path").agg(F.collect_set(F.regexp_replace("reason", "^defines ", "")).alias("highlighted"))
        ranked = context.rank(context.combine(evidence.unionByName(context.neighbours(scored, edges)))).join(asks.select("request_id", "project_id", "intent"), "request_id").join(highlighted, ["request_id", "path"], "left")
        ranked = ranked.withColumn("with_source", wanted).withColumn("highlighted", F.coalesce("highlighted", F.array().cast("array<string>")))
        costed = context.entries(ranked, files, symbols, texts, max_files=max_files)
        filled = context.fill_budget(costed, budget=budget, max_files=max_files, sources=4)
        return filled.join(ranked.select("request_id", "project_id", "path", "relevance", "reasons"), ["request_id", "path"]).select("request_id", "project_id", "path", "level", "tokens", "relevance", "reasons", "position", "truncated").orderBy("request_id", "position")

    # what clients tell
    _clock = itertools.count()
    LOGS = {
        "memory": "project_id string, memory_id string, at long, seq long, event string, type string, title string, content string, importance double, confidence double, tags array<string>, paths array<string>, branch string, expires_at long, supersedes string",
        "tasks": "project_id string, task_id string, at long, seq long, status string, title string, priority string, blocked_reason string, tags array<string>, paths array<string>, branch string",
        "sessions": "project_id string, session_id string, at long, seq long, event string, agent string, task_id string, summary string, next_step string, files array<string>",
    }

    def _append(self, name: str, **fields) -> str:
        if self.state is None:
            raise ValueError("an index without a state folder cannot be told anything")
        now = time.time_ns() // 1000
        key = {"memory": "memory_id", "tasks": "task_id", "sessions": "session_id"}[name]
        row = {"at": now, "seq": now * 1000 + next(self._clock) % 1000, key: fields.get(key) or f"{name[:3]}_{now:x}_{next(self._clock)}"} | {k: v for k, v in fields.items() if v is not None}
        columns = [c.split()[0] for c in re.split(r", (?=\w+ )", self.LOGS[name])]
        self.spark.createDataFrame([tuple(row.get(c) for c in columns)], self.LOGS[name]).coalesce(1).write.mode("append").parquet(f"{self.state}/{name}")
        return row[key]

    def _log(self, name: str) -> DataFrame | None:
        if self.state is None or not os.path.isdir(f"{self.state}/{name}"):
            return None
        rows = self.spark.read.schema(self.LOGS[name]).parquet(f"{self.state}/{name}")
        return rows.where(F.col("project_id").isin(self.projects)) if self.projects is not None else rows

    def _memory(self) -> DataFrame | None:
        log = self._log("memory")
        return None if log is None else stores.memory_state(log)

    def remember(self, project_id: str, kind: str, title: str, content: str, **fields) -> str:
        """Id of the record, that of an identical one if there is one, which is reinforced."""
        records = self._memory()
        if records is not None:
            asked = self.spark.createDataFrame([(0, project_id, kind, title, content)], "ask_id int, project_id string, type string, title string, content string")
            known = stores.find_by_hash(records, asked).first()
            if known:
                return self._append("memory", project_id=project_id, memory_id=known.memory_id, event="reinforced", **fields)
        return self._append("memory", project_id=project_id, event="remembered", type=kind, title=title, content=content, **fields)

    def forget(self, project_id: str, memory_id: str, *, hard: bool = False) -> None:
        self._append("memory", project_id=project_id, memory_id=memory_id, event="forgotten" if hard else "archived")

    def recall(self, query: str | None = None, **options) -> DataFrame:
        records = self._memory()
        rows = self.spark.createDataFrame([], self.LOGS["memory"]) if records is None else records
        rows = stores.memory_state(rows) if records is None else rows
        times = rows.withColumn("updated_at", F.timestamp_micros("updated_at")).withColumn("expires_at", F.timestamp_micros("expires_at"))
        return knowledge.recall(times, F.current_timestamp(), query=query, **options)

    def task_create(self, project_id: str, title: str, status: str = "IDEA", **fields) -> str:
        return self._append("tasks", project_id=project_id, title=title, status=status, **fields)

    def task_update(self, project_id: str, task_id: str, **fields) -> None:
        self._append("tasks", project_id=project_id, task_id=task_id, **fields)

    def task_status(self, **options) -> DataFrame:
        log = self._log("tasks")
        return stores.task_list(stores.task_state(self.spark.createDataFrame([], self.LOGS["tasks"]) if log is None else log), **options)

    def task_context(self, task_id: str, *, budget: int = 6000, max_files: int = 12) -> DataFrame:
        """Context of a task: its title, paths and tags as the request."""
        tasks = self.task_status().where(F.col("task_id") == task_id).select("task_id", "project_id", "title", "paths", F.array().cast("array<string>").alias("symbols"), F.array().cast("array<struct<position:int,text:string,done:boolean>>").alias("requirements"))
        return self._contexts(context.of_tasks(tasks), budget, max_files, None)

    def session_start(self, project_id: str, agent: str, **fields) -> str:
        return self._append("sessions", project_id=project_id, event="started", agent=agent, **fields)

    def session_end(self, project_id: str, session_id: str, **fields) -> None:
        self._append("sessions", project_id=project_id, session_id=session_id, event="ended", **fields)

    def sessions(self) -> DataFrame:
        log = self._log("sessions")
        return stores.session_state(self.spark.createDataFrame([], self.LOGS["sessions"]) if log is None else log)

    # projects
    def project_list(self) -> DataFrame:
        rows = table(self.spark, self.root, "projects").withColumnRenamed("id", "project_id")
        return rows.where(F.col("project_id").isin(self.projects)) if self.projects is not None else rows

    def project_status(self) -> DataFrame:
        """What there is of each project: files, bytes, symbols, imports."""
        count = lambda rows, name: rows.groupBy("project_id").agg(F.count("*").alias(name))
        own = self.files.groupBy("project_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        keep = self.files.select("file_id")
        return stores.status_bundle(self.project_list().select("project_id", "name"), [own, count(self.symbols, "symbols"), count(self.imports.join(keep, "file_id", "left_semi"), "imports")])

    def project_map(self, folders: int = 40) -> DataFrame:
        """The fullest folders of each project, two levels deep: ``(project_id, directory, files, languages, place, truncated)``."""
        return graph.project_map(self.files, folders)

    # contracts, safety, state
    def endpoints(self) -> DataFrame:
        return contracts.endpoints(self.texts)

    def api_contracts(self) -> DataFrame:
        found = self.endpoints()
        return contracts.match(found.where("role = 'consumes'"), contracts.provided(found, self.imports))

    def api_links(self) -> DataFrame:
        """Call keys with their call sites and the routes these meet."""
        found = self.endpoints()
        return contracts.links(found.where("role = 'consumes'"), contracts.provided(found, self.imports))

    def callers_of(self, path: str) -> DataFrame:
        return contracts.callers_of(self.endpoints().where("role = 'consumes'"), path)

    def security_status(self) -> DataFrame:
        """``(path, detectors)`` of files that hold something like a secret."""
        hits = F.array_compact(F.array(*[F.when(F.col("content").rlike(T.java(p)), F.lit(n)) for n, p in T.SECRET_PATTERNS]))
        return self.texts.select("project_id", "path", hits.alias("detectors")).where("size(detectors) > 0")

    def cache_status(self) -> DataFrame:
        return knowledge.cache_state(self._table("context_cache").dropDuplicates(["id"]), self.files)

    def activity(self, since: int = 0, limit: int = 100) -> DataFrame:
        return knowledge.feed(self._table("activity"), since, limit)

    def health(self) -> DataFrame:
        log = self._table("files").where("id IS NOT NULL")
        state = ingest.latest(log, ["id"], [F.col("indexed_at")]).withColumnRenamed("id", "file_id")
        return health.check(state, self._table("symbols").dropDuplicates(["id"]), self.imports)


def check_operation(spark: SparkSession, command: str) -> tuple[str, list[str]]:
    """Level and rules of one command."""
    row = spark.range(1).select(T.assess_operation(F.lit(command)).alias("x")).first().x
    return row.level, list(row.rules)
