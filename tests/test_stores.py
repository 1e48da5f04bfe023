"""Stores, the kept index, endpoints, scans, git and streams on small fixtures, with nulls, repeated rows and empty tables."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomstead.operators import context, contracts, extract, graph, health, postings, search, stores
from loomstead.sources import config, git, scan
from loomstead.streaming import watch

MEMORY = (
    "project_id string, memory_id long, at long, seq long, event string, type string, title string, content string, importance double, confidence double, tags array<string>, paths array<string>, branch string,"
    " expires_at long, supersedes long"
)


def note(id, at, event="remembered", type="FACT", title="A title", content="Some content", importance=None, tags=(), supersedes=None, branch=None):
    said = event in ("remembered", "updated", "reinforced")
    return ("p", id, at, at, event, type if said else None, title if said else None, content if said else None, importance, None, list(tags), ["a.ts"] if said else None, branch, None, supersedes)


def test_memory_state(spark):
    rows = [
        note(1, 1, importance=0.4, tags=["b"]), note(1, 1, importance=0.4, tags=["b"]), note(1, 5, "reinforced", importance=0.8, tags=["a"]), note(1, 6, "accessed"), note(1, 6, "accessed"), note(1, 7, "accessed"), note(2, 2, content="short"),
        note(3, 3, type="NONE"), note(4, 4), note(4, 9, "forgotten"), note(5, 5, type="DECISION", supersedes=1), note(6, 6), note(6, 8, "archived"), note(7, 7), note(7, 8, "archived"), note(7, 9, "restored"), note(8, 1, "accessed"),
    ]
    got = {r.memory_id: r for r in stores.memory_state(spark.createDataFrame(rows, MEMORY)).collect()}
    assert set(got) == {1, 5, 6, 7}
    assert got[1].importance == 0.8 and got[1].tags == ["a", "b"] and got[1].accesses == 2 and got[1].status == "archived" and got[1].updated_at == 5
    assert got[5].importance == 0.9 and got[5].status == "active" and got[6].status == "archived" and got[7].status == "active"
    log = spark.createDataFrame(rows, MEMORY)
    state = stores.memory_state(log)
    assert [r.memory_id for r in stores.memory_list(state, kind="DECISION", path="a.ts").collect()] == [5]
    assert stores.memory_state(log.limit(0)).count() == 0 and stores.memory_stats(state, F.lit(0)).first().total == 4


def test_task_state_follows_the_table(spark):
    schema = "project_id string, task_id long, at long, seq long, status string, title string, priority string, blocked_reason string, tags array<string>, paths array<string>, branch string"
    row = lambda at, status, reason=None, tags=(): ("p", 1, at, at, status, "t", None, reason, list(tags), None, None)
    log = [row(1, "READY", tags=["x"]), row(2, "IN_PROGRESS"), row(3, "COMPLETED"), row(4, "COMPLETED"), row(5, "IDEA"), row(6, "TESTING", tags=["y"]), row(7, "BLOCKED", "later"), row(8, None), row(8, None)]
    state = stores.task_state(spark.createDataFrame(log, schema)).first()
    assert (state.status, state.refused, state.started_at, state.completed_at, state.blocked_reason, state.tags, state.updated_at) == ("BLOCKED", 1, 2, None, "later", ["x", "y"], 8)
    done = stores.task_state(spark.createDataFrame(log[:4], schema)).first()
    assert (done.status, done.completed_at, done.blocked_reason) == ("COMPLETED", 3, None)
    needs = spark.createDataFrame([(1, 0, "Do A", False), (1, 1, "do b", False)], "task_id long, position int, text string, done boolean")
    ticks = spark.createDataFrame([(1, 1, 1, None, "DO A", True), (1, 2, 1, 1, None, True), (1, 3, 1, 1, None, False)], "task_id long, at long, seq long, position int, text string, done boolean")
    nested = stores.with_requirements(spark.createDataFrame([(1,), (2,)], "task_id long"), stores.tick(needs, ticks)).orderBy("task_id").collect()
    assert [(r["position"], r["done"]) for r in nested[0].requirements] == [(0, True), (1, False)] and nested[0].next_position == 2 and nested[1].requirements == [] and nested[1].next_position == 0


def test_sessions_close_when_the_next_starts(spark):
    schema = "project_id string, session_id string, at long, seq long, event string, agent string, task_id long, summary string, next_step string, files array<string>"
    row = lambda id, at, event, files=(): ("p", id, at, at, event, "a", None, None, None, list(files))
    log = spark.createDataFrame([row("s1", 1, "started", ["x"]), row("s2", 5, "started"), row("s2", 7, "ended", ["y"]), row("s2", 9, "ended"), row("s3", 10, "started"), row("s1", 20, "ended")], schema)
    got = {r.session_id: (r.ended_at, r.status) for r in stores.session_state(log).collect()}
    assert got == {"s1": (5, "ended"), "s2": (7, "ended"), "s3": (None, "active")}
    heads = stores.session_heads(stores.session_state(log)).first()
    assert (heads.active, heads.last_ended, heads.sessions) == ("s3", "s2", 3)


def test_registry_keeps_what_it_knew(spark):
    schema = "project_id string, at long, seq long, name string, path string, framework string, package_manager string, status string"
    log = spark.createDataFrame([("p", 1, 1, "shop", "/a", "next", None, None), ("p", 2, 2, "other", "/b", None, "npm", None)], schema)
    state = stores.registry_state(log).first()
    assert (state.name, state.path, state.framework, state.package_manager, state.status) == ("shop", "/b", "next", "npm", "active")
    times = lambda rows: rows.withColumn("last_seen_at", F.timestamp_seconds("last_seen_at"))
    asked = spark.createDataFrame([("p",), ("SHOP",), ("/a",), ("/c",)], "ask string")
    assert {(r.ask, r.how) for r in stores.resolve(times(stores.registry_state(log)), times(stores.path_history(log)), asked).collect()} == {("p", "id"), ("SHOP", "name"), ("/a", "history")}
    folders = spark.createDataFrame([("p", "/x/p"), ("q", "/x/q")], "project_id string, folder string")
    assert [r.project_id for r in stores.orphan_storage(folders, stores.registry_state(log)).collect()] == ["q"]


def test_kept_index_equals_the_scan(spark):
    docs = [("p", 1, "payment payment service"), ("p", 2, "Zahlung für die Überweisung"), ("p", 3, None), ("p", 4, ""), ("p", 1, "payment payment service"), ("p", 5, "pay the payments")]
    rows = spark.createDataFrame(docs, "project_id string, id long, text string")
    index = postings.build(rows, {"text": 1.0})
    asks = spark.createDataFrame([(1, "p", "payment service"), (2, "p", "uberweisung"), (3, "q", "payment"), (4, "p", "the of"), (5, "p", None)], "request_id long, project_id string, task string")
    got = postings.search(index, asks).collect()
    want = search.search(rows.dropDuplicates(["id"]), "payment service", {"text": 1.0}).collect()
    assert [(r.key, r.score) for r in sorted(got, key=lambda r: (-r.score, r.key)) if r.request_id == 1] == [(r.id, r.score) for r in want]
    assert [r.key for r in got if r.request_id == 2] == [2] and {r.request_id for r in got} == {1, 2}
    changed = spark.createDataFrame([("p", 1, "nothing here", False), ("p", 5, None, True), ("p", 9, "service", False)], "project_id string, id long, text string, gone boolean")
    fresh = postings.update(index, changed, {"text": 1.0})
    assert {(r.key, r.request_id) for r in postings.search(fresh, asks).collect()} == {(9, 1), (2, 2)}
    assert {r.key for r in fresh[1].collect()} == {1, 2, 3, 4, 9} and postings.search(postings.build(rows.limit(0), {"text": 1.0}), asks).count() == 0


def test_stored_index(spark, tmp_path):
    rows = spark.createDataFrame([("p", k, f"word{k} common") for k in range(50)], "project_id string, id long, text string")
    asks = spark.createDataFrame([(1, "p", "word7")], "request_id long, project_id string, task string")
    postings.save(postings.build(rows, {"text": 1.0}), str(tmp_path), buckets=4)
    assert {r.key for r in postings.search(postings.load(spark, str(tmp_path), asks), asks).collect()} == {7}


def test_endpoints_of_every_kind():
    scanned = lambda text, path="a.ts": [(r[0], r[1], r[2]) for r in contracts.scan(text, path)]
    assert scanned('api.get("/conversations/" + id + "/messages");') == [("consumes", "GET", "/conversations/{}/messages")]
    assert scanned("api.post<Res<Tokens>>(`/auth/${kind}`, { a: f(1, 2) })") == [("consumes", "POST", "/auth/${kind}")]
    assert scanned('fetch("/items", { headers: {' + "a: 1, " * 100 + '}, method: "put" })') == [("consumes", "PUT", "/items")] and scanned('fetch("/a"); x({ method: "POST" })') == [("consumes", "GET", "/a")]
    assert scanned('@Controller("users")\nclass A {\n  @Get(":id") a() {}\n  @Post() b() {}\n  @All("x") c() {}\n}') == [("provides", "GET", "/users/:id"), ("provides", "POST", "/users"), ("provides", None, "/users/x")]
    assert scanned("@app.route('/x', methods=['POST'])\n@router.get('/y')\n@app.route('/z')", "a.py") == [("provides", "POST", "/x"), ("provides", "GET", "/y"), ("provides", "GET", "/z")]
    assert contracts.scan("const c = axios.create({ baseURL: 'http://localhost:3000' });\nclient.get('/me')")[0][4] is False
    assert contracts.scan("const c = axios.create({ baseURL: 'https://x.test' });\nclient.get('/me')")[0][4] is True
    assert scanned('cache.get("/a"); map.delete("/b"); app.use(cors()); app.use("/v", auth, routes)') == [("mounts", None, "/v")] and contracts.scan('app.use("/v", auth, routes)')[0][5] == "routes"
    assert contracts.scan("") == [] and contracts.scan("app.get('/a") == [] and scanned("a.get(" * 3000) == []


def test_mounts_lead_to_canonical_paths(spark):
    files = spark.createDataFrame([
        (1, "back", "src/app.ts", 'import inboxRoutes from "./inbox.routes";\napp.use("/api/inbox", inboxRoutes);\n'), (2, "back", "src/inbox.routes.ts", 'router.get("/conversations", h);\nrouter.post("/conversations/:id/messages", h);\nrouter.all("/conversations", w);\n'),
        (3, "client", "src/api.ts", 'api.get("/inbox/conversations");\napi.post("/inbox/conversations/" + id + "/messages", b);\napi.patch("/inbox/conversations/" + id + "/star", b);\n'), (3, "client", "src/api.ts", 'api.get("/inbox/conversations");\napi.post("/inbox/conversations/" + id + "/messages", b);\napi.patch("/inbox/conversations/" + id + "/star", b);\n'),
    ], "file_id long, project_id string, path string, content string")
    imports = extract.resolve_imports(extract.extract_imports(files).distinct(), files.select("project_id", F.col("path").alias("relative_path"), "file_id").distinct())
    found = contracts.endpoints(files)
    routes, calls = contracts.provided(found, imports), found.where("role = 'consumes'")
    assert {(r.method, r.canonical) for r in routes.collect()} == {("GET", "inbox/conversations"), ("POST", "inbox/conversations/{}/messages"), (None, "inbox/conversations")}
    links = {(r.method, r.canonical): (len(r.consumers), [p.file_id for p in r.providers]) for r in contracts.links(calls, routes).collect()}
    assert links == {("GET", "inbox/conversations"): (1, [2]), ("POST", "inbox/conversations/{}/messages"): (1, [2]), ("PATCH", "inbox/conversations/{}/star"): (1, [])}
    assert contracts.http_impact(routes.where("method IS NULL"), calls, 2).count() == 1 and contracts.http_impact(routes, calls, 2).count() == 2
    assert contracts.endpoints(files.limit(0)).count() == 0


def test_imports_go_up_any_number_of_folders(spark):
    deep = "a/b/c/d/e/f/g/h/i/j/k/x.ts"
    files = spark.createDataFrame([("p", "top.ts", 1), ("p", deep, 2)], "project_id string, relative_path string, file_id long")
    imports = spark.createDataFrame([(2, "p", deep, "../" * 11 + "top", "static", 1, ["t"]), (None, "p", deep, "./gone", "static", 2, None)], "file_id long, project_id string, path string, specifier string, kind string, line int, names array<string>")
    got = {r.specifier: (r.resolved_file_id, r.is_external) for r in extract.resolve_imports(imports, files).collect()}
    assert got["../" * 11 + "top"] == (1, False) and got["./gone"] == (None, False)


def test_context_stays_within_projects(spark):
    asks = spark.createDataFrame([(1, "p", "fix `run` in src/a.ts")], "request_id long, project_id string, task string").withColumn("intent", F.lit("debug"))
    files = spark.createDataFrame([("p", "src/a.ts"), ("p", "src/b.ts"), ("q", "src/a.ts"), ("q", "src/c.ts")], "project_id string, path string")
    edges = spark.createDataFrame([("p", "src/b.ts", "src/a.ts"), ("q", "src/c.ts", "src/a.ts")], "project_id string, source string, target string")
    scored = context.combine(context.named_paths(asks, files)).join(asks, "request_id")
    assert {r.path for r in context.neighbours(scored, edges).collect()} == {"src/b.ts"}


def test_outlines_and_costs(spark):
    symbols = spark.createDataFrame([("p", "a.ts", 1, "x", "x", "variable", None, False, 1, 1), ("p", "a.ts", 2, "run", "A.run", "method", "run()", False, 3, 5), ("p", "a.ts", 3, "A", "A", "class", None, True, 2, 6)], "project_id string, path string, id long, name string, qualified_name string, type string, signature string, exported boolean, line_start long, line_end long")
    ranked = spark.createDataFrame([(1, "p", "a.ts", 1.0, ["why"], ["run"], True), (1, "p", "b.ts", 0.5, ["why"], [], True)], "request_id long, project_id string, path string, relevance double, reasons array<string>, highlighted array<string>, with_source boolean")
    files = spark.createDataFrame([("p", "a.ts", "typescript"), ("p", "b.ts", None)], "project_id string, path string, language string")
    texts = spark.createDataFrame([("p", "a.ts", "one\ntwo\nthree\nfour\nfive\nsix"), ("p", "a.ts", "one\ntwo\nthree\nfour\nfive\nsix")], "project_id string, path string, content string")
    got = {r.path: r for r in context.entries(ranked, files, symbols, texts).collect()}
    assert [s["name"] for s in json.loads(got["a.ts"].outline)["symbols"]] == ["A.run", "A", "x"] and got["a.ts"].source.text == "three\nfour\nfive"
    assert got["a.ts"].outline_tokens == -(-len(got["a.ts"].outline) // 4) and got["a.ts"].full_tokens > got["a.ts"].outline_tokens and got["b.ts"].full_tokens is None
    filled = context.fill_budget(spark.createDataFrame([(1, f"f{k}", 1.0 - k / 10, 50, 10, 5) for k in range(6)], "request_id long, path string, relevance double, full_tokens long, outline_tokens long, header_tokens long"), budget=130, max_files=4, sources=2).orderBy("position").collect()
    assert [(r.path, r.level, r.truncated) for r in filled] == [("f0", 2, True), ("f1", 2, True), ("f2", 1, True), ("f3", 1, True)]


def test_repair_leaves_nothing_to_find(spark):
    files = spark.createDataFrame([(1, "p", "a.ts", "h", "active"), (2, "p", "a.ts", "h", "active"), (3, "p", "b.ts", "h", "deleted")], "file_id long, project_id string, relative_path string, hash string, status string")
    symbols = spark.createDataFrame([(1, "p", 1), (2, "p", 3)], "id long, project_id string, file_id long")
    imports = spark.createDataFrame([(1, "p", 2, "a.ts", 3), (2, "p", 3, "a.ts", 1)], "id long, project_id string, file_id long, resolved_path string, resolved_file_id long")
    runs = spark.createDataFrame([("p", "running")], "project_id string, status string")
    assert health.check(files, symbols, imports, runs).count() == 5
    assert health.check(**health.repair(files, symbols, imports, runs)).count() == 0


def test_reach_beyond_the_unbroken_hops(spark):
    edges = spark.createDataFrame([("p", k + 1, k, "static") for k in range(8)], "project_id string, source long, target long, kind string")
    got = {r.node: r.depth for r in graph.reach(edges, spark.createDataFrame([(0,)], "origin long"), 6).collect()}
    assert got == {k: k for k in range(1, 7)}


def test_scan_limits_and_links(spark, tmp_path):
    for name in ("a.ts", "b.ts", "c.ts", ".env", "dist/x.js", "skip/y.ts", "p.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "link.ts").symlink_to(tmp_path / "a.ts")
    (tmp_path / "loop").symlink_to(tmp_path)
    rules = scan.parse_rules("skip/\n")
    listed = scan.walk(spark, str(tmp_path), rules=rules)
    assert {r.relative_path for r in listed.collect()} == {"a.ts", "b.ts", "c.ts", ".env", "dist/x.js", "p.png"}
    assert "link.ts" in {r.relative_path for r in scan.walk(spark, str(tmp_path), follow_links=True).collect()}
    got = scan.scan(listed, max_files=2)
    assert {r.relative_path: r.reason for r in got.collect()} == {"a.ts": None, "b.ts": None, "c.ts": "limit", ".env": "sensitive", "dist/x.js": "ignored", "p.png": "binary"}
    report = scan.scan_report(got).first()
    assert (report.kept, report.bytes, report.truncated, report.skipped) == (2, 2, True, {"limit": 1, "sensitive": 1, "ignored": 1, "binary": 1})


def test_git_adapters(spark, tmp_path):
    call = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@x.test", *args], check=True, capture_output=True)
    try:
        call("init", "-b", "main")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    (tmp_path / "a.txt").write_text("one\n")
    call("add", "."), call("commit", "-m", "first")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    call("commit", "-am", "second")
    (tmp_path / "a.txt").write_text("three\n")
    root = str(tmp_path)
    assert [r.subject for r in git.history(spark, root).collect()] == ["second", "first"] and git.history(spark, root, limit=1, file="a.txt", branch="main").count() == 1
    assert git.diff(root, names=True) == "a.txt\n" and git.diff(root, staged=True) == "" and git.show(root, "HEAD", "a.txt") == "one\ntwo\n" and git.branches(root) == ["main"]
    assert [(r.line, r.text) for r in git.blame(spark, root, "a.txt").collect()][:1] == [(1, "three")] and git.current_branch(root) == "main" and git.remote_url(root) is None
    assert git.root_commit(root) != git.head_commit(root) and git.version() and git.summary(root)["changed"] == ["a.txt"] and git.summary("/nowhere") is None
    assert config.find_root(folder=root) == str(tmp_path.resolve())


def test_config_and_roots(tmp_path):
    assert config.read_config('{"maxFiles": 5, "watch": "yes", "other": 1}') | {"maxFiles": 20000} == config.DEFAULTS and config.read_config("{") == config.DEFAULTS == config.read_config("[]") == config.read_config(None)
    inner = tmp_path / "packages" / "a" / "src"
    inner.mkdir(parents=True)
    (tmp_path / "packages" / "a" / "package.json").write_text("{}")
    (tmp_path / "pnpm-workspace.yaml").write_text("packages: []")
    assert config.find_root(folder=str(inner)) == str(tmp_path.resolve()) and config.find_root(explicit=str(inner)) == str(inner.resolve())
    with pytest.raises(ValueError):
        config.find_root(explicit="/")


def test_changed_stream_keeps_hashes(spark, tmp_path):
    tree, out = tmp_path / "tree", str(tmp_path / "out")
    tree.mkdir()
    seen = []

    def turn():
        files = watch.open_tree(spark, str(tree), "p")
        query = watch.index_stream(watch.changed_stream(files), lambda rows, n: seen.extend((r.relative_path, r.kind) for r in rows.collect()), checkpoint=out, once=True)
        query.awaitTermination(120)

    (tree / "a.ts").write_text("1"), (tree / "b.ts").write_text("1")
    turn()
    (tree / "c.ts").write_text("2")
    turn()
    assert sorted(seen) == [("a.ts", "added"), ("b.ts", "added"), ("c.ts", "added")]
    batch = spark.createDataFrame([("p", "a", "changed"), ("p", "b", "added"), ("q", "c", "removed")], "project_id string, relative_path string, kind string")
    assert {(r.project_id, r.mode, tuple(r.paths)) for r in watch.classify(batch).collect()} == {("p", "partial", ("a", "b")), ("q", "full", ())}


def test_watchers_follow_the_wanted_set():
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    watchers = watch.Watchers(lambda project: Query())
    assert watchers.sync({"a", "b"}) == (["a", "b"], []) and watchers.sync({"b", "c"}) == (["c"], ["a"])
    watchers.running["b"].stop()
    assert watchers.sync({"b", "c"}) == (["b"], [])
