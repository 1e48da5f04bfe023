"""Projects, health, recall and contracts with mounts."""

import datetime as dt

from pyspark.sql import functions as F

from loomstead.operators import contracts, extract, health, knowledge
from loomstead.sources import project


def test_detection(spark):
    rows = [
        ("a", "package.json", '{"dependencies": {"next": "1", "react": "1"}, "packageManager": "pnpm@9"}'), ("a", "tsconfig.json", "{}"), ("a", "yarn.lock", ""),
        ("b", "requirements.txt", "Flask==3\n"), ("b", "manage.py", None), ("c", "go.mod", "module x"), ("d", "package.json", "not json"),
    ]
    got = {r.project_id: (r.framework, r.frameworks, r.languages, r.package_manager) for r in project.detect(spark.createDataFrame(rows, "project_id string, name string, content string")).collect()}
    assert got["a"] == ("Next.js", ["Next.js", "React"], ["TypeScript", "JavaScript"], "pnpm")
    assert got["b"] == ("Django", ["Django", "Flask"], ["Python"], "pip")
    assert got["c"] == (None, [], ["Go"], None) and got["d"] == (None, [], ["JavaScript"], "npm")


def test_aliases_and_packages(spark):
    files = {
        "tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}, } }',
        "pnpm-workspace.yaml": "packages:\n  - 'packages/*'\n  - '!packages/old'\n", "packages/core/package.json": '{"name": "@w/core"}', "other/package.json": '{"name": "no"}',
    }
    aliases, packages = project.path_aliases(files), project.workspace_packages(files)
    assert aliases == [("@/", "src/")] and packages == [("@w/core", "packages/core")]
    known = spark.createDataFrame([(1, "p", "src/lib/a.ts"), (2, "p", "packages/core/src/index.ts"), (3, "p", "packages/core/src/engine.ts")], "file_id long, project_id string, relative_path string")
    wanted = ["@/lib/a", "@w/core", "@w/core/engine.js", "@w/none", "@/missing"]
    imports = spark.createDataFrame([(9, "p", "src/x.ts", w, "static", k, []) for k, w in enumerate(wanted)], "file_id long, project_id string, path string, specifier string, kind string, line int, names array<string>")
    got = {r.specifier: (r.resolved_file_id, r.is_external) for r in extract.resolve_imports(imports, known, aliases=aliases, packages=packages).collect()}
    assert got == {"@/lib/a": (1, False), "@w/core": (2, False), "@w/core/engine.js": (3, False), "@w/none": (None, True), "@/missing": (None, False)}


def test_health(spark):
    files = spark.createDataFrame([(1, "p", "a", "h", "active"), (2, "p", "a", None, "active"), (3, "p", "b", "h", "deleted")], "file_id long, project_id string, relative_path string, hash string, status string")
    symbols = spark.createDataFrame([("p", 1), ("p", 3)], "project_id string, file_id long")
    imports = spark.createDataFrame([("p", 1, 3), ("p", 3, None)], "project_id string, file_id long, resolved_file_id long")
    runs = spark.createDataFrame([("p", "running"), ("p", "ok")], "project_id string, status string")
    got = {r.problem: r.rows for r in health.check(files, symbols, imports, runs).collect()}
    assert got == {"duplicate_path": 1, "missing_hash": 1, "symbols_of_missing_file": 1, "imports_of_missing_file": 1, "unlinked_target": 1, "unfinished_run": 1}
    assert [r.x for r in spark.createDataFrame([("READ",), ("DESTRUCTIVE",), ("?",)], "p string").select(health.decide(F.col("p")).alias("x")).collect()] == ["allow", "confirm", "deny"]


def test_recall(spark):
    now = dt.datetime(2024, 6, 1)
    base = ([], [], None, "active")
    rows = [
        (1, "DECISION", "retry policy", "payments retry twice", *base, 0.9, 1.0, 0, now, None), (2, "HISTORY", "retry policy", "payments retry twice", *base, 0.3, 1.0, 0, now, None),
        (3, "FACT", "old", "payments", *base, 0.5, 1.0, 0, now, now), (4, "CONSTRAINT", "branch", "only here", ["t"], [], "dev", "active", 0.85, 1.0, 0, now, None),
    ]
    records = spark.createDataFrame(rows, "memory_id long, type string, title string, content string, tags array<string>, paths array<string>, branch string, status string, importance double, confidence double, accesses long, updated_at timestamp, expires_at timestamp")
    ask = lambda **o: [r.memory_id for r in knowledge.recall(records, F.lit(now), **o).collect()]
    assert ask(query="retry policy") == [1, 2] and ask() == [1, 2] and ask(branch="dev") == [1, 4, 2]
    assert ask(branch="dev", tag="t") == [4] and ask(query="nothing like it", kind="DECISION") == [1]
    assert knowledge.cache_key(1, " Fix  it", {"b": 1, "a": [2]}) == knowledge.cache_key(1, "fix it", {"a": [2], "b": 1})
    tasks = spark.createDataFrame([("p", 1, "TASK-7", now), ("p", 2, None, now), ("p", 3, None, now), ("q", 4, None, now)], "project_id string, task_id long, key string, created_at timestamp")
    assert {r.task_id: r.key for r in knowledge.next_task_keys(tasks).collect()} == {1: "TASK-7", 2: "TASK-8", 3: "TASK-9", 4: "TASK-1"}


def test_mounted_routes(spark):
    files = spark.createDataFrame([(1, "a", 'router.get("/list", h)'), (2, "b", 'axios.get("/api/shop/list")')], "file_id long, project_id string, content string")
    found = contracts.endpoints(files)
    routes = contracts.with_mounts(found.where("role = 'provides'"), spark.createDataFrame([(1, "shop")], "target_file_id long, prefix string"))
    calls = found.where("role = 'consumes'")
    assert [r.canonical for r in routes.collect()] == ["shop/list"]
    assert [(r.file_id, r.line) for r in contracts.callers_of(calls, "/Shop/list/").collect()] == [(2, 1)]
    assert [r.file_id for r in contracts.http_impact(routes, calls, 1).collect()] == [2]
