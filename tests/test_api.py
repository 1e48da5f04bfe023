"""The facade over a tiny directory of tables."""

import datetime as dt

import pytest

from loomstead.api import Index, check_operation

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    paths = ["src/db.ts", "src/payment-service.ts", "src/api.ts", "tests/payment.test.ts", "src/login-form.ts"]
    contents = [
        "export const open = 1;\n", "import { open } from './db';\nexport function verifyPayment(id) {\n  return open(id);\n}\n", "import { verifyPayment } from './payment-service';\napp.get('/pay/:id', verifyPayment)\n",
        "import { verifyPayment } from '../src/payment-service';\nverifyPayment(1);\n", "export function LoginForm() {}\nfetch(`/api/pay/${id}`)\n",
    ]
    files = [(i, "p", "/x/" + p, p, "typescript", ".ts", len(c), "h", DAY + dt.timedelta(days=i), DAY, "active", "ok", 1, False) for i, (p, c) in enumerate(zip(paths, contents), 1)]
    spark.createDataFrame([*files, (9, "p", "/x/old.ts", "old.ts", None, None, 1, "h", DAY, DAY, "deleted", None, 0, False), files[0]], "id long, project_id string, path string, relative_path string, language string, extension string, size long, hash string, last_modified timestamp_ntz, indexed_at timestamp_ntz, status string, parse_status string, symbol_count long, has_secrets boolean").write.parquet(root + "/files.parquet")
    spark.createDataFrame([(i, "p", p, c, None) for i, (p, c) in enumerate(zip(paths, contents), 1)], "file_id long, project_id string, path string, content string, identifiers string").write.parquet(root + "/file_search.parquet")
    symbols = [(1, "p", 1, "open", "open", "constant", "open = 1", 1, 1, None, True), (2, "p", 2, "verifyPayment", "verifyPayment", "function", "verifyPayment(id)", 2, 4, None, True), (3, "p", 5, "LoginForm", "LoginForm", "function", "LoginForm()", 1, 1, None, True), (4, "p", 9, "verifyPayment", "verifyPayment", "function", None, 1, 1, None, True)]
    spark.createDataFrame(symbols, "id long, project_id string, file_id long, name string, qualified_name string, type string, signature string, line_start long, line_end long, parent_id long, exported boolean").write.parquet(root + "/symbols.parquet")
    links = [(1, 2, 1), (2, 3, 2), (3, 4, 2)]
    spark.createDataFrame([(k, "p", a, "./x", "static", 1, ["x"], False, None, b, None, DAY) for k, a, b in links], "id long, project_id string, file_id long, specifier string, kind string, line long, names array<string>, is_external boolean, package_name string, resolved_file_id long, resolved_path string, indexed_at timestamp_ntz").write.parquet(root + "/imports.parquet")
    spark.createDataFrame([(1, "p", 3, "verifyPayment", "call", 2, None, DAY), (2, "p", 4, "verifyPayment", "call", 2, None, DAY), (2, "p", 4, "verifyPayment", "call", 2, None, DAY)], "id long, project_id string, file_id long, name string, kind string, line long, from_symbol_id long, indexed_at timestamp_ntz").write.parquet(root + "/symbol_references.parquet")
    return Index(spark, root)


def paths(rows):
    return [r.relative_path for r in rows.collect()]


def test_files_and_symbols(index):
    assert paths(index.find_file("PAYMENT")) == ["tests/payment.test.ts", "src/payment-service.ts"]
    assert paths(index.recent_files(1)) == ["src/login-form.ts"]
    assert [r.id for r in index.find_symbol("verifypayment").collect()] == [2] and [r.id for r in index.find_symbol("Form").collect()] == [3]
    row = index.get_definition("verifyPayment").first()
    assert row.relative_path == "src/payment-service.ts" and row.source.startswith("export function verifyPayment") and row.source.endswith("}")
    assert {(r.relative_path, tuple(r.lines)) for r in index.find_references("verifyPayment").collect()} == {("src/api.ts", (2,)), ("tests/payment.test.ts", (2,))}


def test_graph(index):
    got = {(r.relative_path, r.depth, r.is_test) for r in index.impact_analysis("src/db.ts").collect()}
    assert got == {("src/payment-service.ts", 1, False), ("src/api.ts", 2, False), ("tests/payment.test.ts", 2, True)}
    assert paths(index.affected_tests(["src/db.ts"])) == ["tests/payment.test.ts"] and paths(index.affected_tests(["tests/payment.test.ts"])) == ["tests/payment.test.ts"]
    assert {(r.relation, r.relative_path) for r in index.related_code("src/api.ts").collect()} == {("imports", "src/payment-service.ts"), ("defines", "src/payment-service.ts")}


def test_search_and_context(index):
    rows = index.search_context("verify payment").collect()
    assert rows[0].relevance == 1.0 and {r.kind for r in rows} == {"symbol", "file"}
    got = index.get_context("fix payment verification in verifyPayment").collect()
    assert got[0].path == "src/payment-service.ts" and "src/login-form.ts" not in [r.path for r in got]
    small = index.get_context("fix payment verification in verifyPayment", budget=60).collect()
    assert sum(r.tokens for r in small) <= 60 and len(small) < len(got)


def test_contracts_and_state(index, spark):
    assert [(r.method, r.canonical, r.providers) for r in index.api_contracts().collect()] == [("GET", "pay/{}", 1)]
    assert index.security_status().count() == 0
    assert {r.problem for r in index.health().collect()} == {"symbols_of_missing_file"}
    assert check_operation(spark, "git reset --hard")[0] == "dangerous"


def test_what_clients_tell(spark, index, tmp_path):
    told = Index(spark, index.root, ["p"], state=str(tmp_path))
    first = told.remember("p", "DECISION", "Pay once", "Payments are verified once, in src/payment-service.ts.", paths=["src/payment-service.ts"])
    assert told.remember("p", "DECISION", "Pay once", "Payments are verified once,  in src/payment-service.ts.") == first
    second = told.remember("p", "FACT", "Forms", "Forms have no state of their own.")
    assert [r.memory_id for r in told.recall().collect()] == [first, second] and [r.memory_id for r in told.recall("payments").collect()] == [first]
    told.forget("p", second)
    assert [r.memory_id for r in told.recall().collect()] == [first]
    task = told.task_create("p", "verifyPayment runs twice", "READY", paths=["src/payment-service.ts"])
    told.task_update("p", task, status="IN_PROGRESS")
    assert [(r.task_id, r.status) for r in told.task_status(open_only=True).collect()] == [(task, "IN_PROGRESS")]
    assert told.task_context(task).first().path == "src/payment-service.ts"
    one = told.session_start("p", "agent")
    two = told.session_start("p", "agent")
    told.session_end("p", two, summary="done")
    assert {r.session_id: r.status for r in told.sessions().collect()} == {one: "ended", two: "ended"}
    with pytest.raises(ValueError):
        index.session_start("p", "agent")
    assert index.recall().count() == 0 and index.task_status().count() == 0
    assert [(r.directory, r.files) for r in index.project_map().collect()] == [("src", 4), ("tests", 1)]
    got = index.get_context("anything at all", changed=["src/login-form.ts"]).collect()
    assert [r.path for r in got] == ["src/login-form.ts"] and got[0].request_id == "p"
