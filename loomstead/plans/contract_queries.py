"""Queries of the HTTP operators over sources that are put together from the small tables, and their DuckDB counterparts.

The file tables hold no routes. Here every region is an application that mounts a router of each of its nations, and every
supplier is a client of its nation's routes: what must come out follows from keys alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators import contracts
from loomstead.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


def _sources(spark, root) -> tuple[DataFrame, DataFrame]:
    """``(files, imports)`` of all servers and clients."""
    nations = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    # text with columns between the signs; a dollar and a brace in one SQL literal would be a variable
    put = lambda template: F.expr("concat(" + ", ".join("'" + x.replace("${", "$', '{") + "'" if k % 2 == 0 else x for k, x in enumerate(template.replace("'", "\\'").split("#"))) + ")")
    routers = nations.select(
        (1000 + F.col("n")).alias("file_id"), F.lit("server").alias("project_id"), put("src/n#n#.routes.ts").alias("path"),
        put("import h from \"./h\";\nrouter.get(\"/n#n#/suppliers/:id\", h);\nrouter.post('/n#n#/orders', h);\nrouter.all(\"/n#n#/status\", h);\nmap.get(\"/not/a/route\");\n").alias("content"),
    )
    mounts = nations.groupBy("r").agg(F.array_join(F.array_sort(F.collect_list(put("app.use(\"/api/v1/r#r#\", auth, nation#n#Routes);"))), "\n").alias("content"))
    apps = mounts.select((2000 + F.col("r")).alias("file_id"), F.lit("server").alias("project_id"), put("src/app#r#.ts").alias("path"), "content")
    suppliers = table(spark, root, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").cast("long").alias("n"), F.col("s_acctbal").alias("b")).join(F.broadcast(nations), "n")
    own = put("api.get<Page<Row>>(`/r#r#/n#n#/suppliers/${id}?full=1`);\nfetch(\"/r#r#/n#n#/orders\", {\n  headers: { accept: \"text/plain\", note: \"a, (b\" },\n  method: \"POST\",\n});\nclient.delete(\"/r#r#/n#n#/gone/\" + encode(id, 1) + \"/x\");\naxios.put(\"/r#r#/n#n#/status\", body);\n")
    away = put("const metaApi = axios.create({ baseURL: \"https://x.test/v#n#\" });\nmetaApi.get(\"/r#r#/me\");\n")
    clients = suppliers.select((10000 + F.col("s")).alias("file_id"), put("client#s % 7#").alias("project_id"), put("src/c#s#.ts").alias("path"), F.when(F.col("b") < 0, away).otherwise(own).alias("content"))
    imports = nations.select((2000 + F.col("r")).alias("file_id"), F.array(put("nation#n#Routes")).alias("names"), (1000 + F.col("n")).alias("resolved_file_id"))
    return routers.unionByName(apps).unionByName(clients), imports


def _found(spark, root) -> tuple[DataFrame, DataFrame]:
    files, imports = _sources(spark, root)
    return contracts.endpoints(files), imports


_SQL = """n AS (SELECT n_nationkey AS n, n_regionkey AS r, 'r' || n_regionkey || '/n' || n_nationkey || '/' AS base FROM nation), s AS (SELECT s_suppkey AS s, s_acctbal AS b, 10000 + s_suppkey AS file_id, 'client' || s_suppkey % 7 AS project_id, n.* FROM supplier JOIN n ON n.n = s_nationkey),
routes AS (SELECT 1000 + n AS file_id, 'GET' AS method, base || 'suppliers/{}' AS canonical, 2 AS line FROM n UNION ALL SELECT 1000 + n, 'POST', base || 'orders', 3 FROM n UNION ALL SELECT 1000 + n, NULL, base || 'status', 4 FROM n),
calls AS (SELECT project_id, file_id, 'GET' AS method, base || 'suppliers/{}' AS canonical, 1 AS line, false AS external FROM s WHERE b >= 0 UNION ALL SELECT project_id, file_id, 'POST', base || 'orders', 2, false FROM s WHERE b >= 0
 UNION ALL SELECT project_id, file_id, 'DELETE', base || 'gone/{}/x', 6, false FROM s WHERE b >= 0 UNION ALL SELECT project_id, file_id, 'PUT', base || 'status', 7, false FROM s WHERE b >= 0 UNION ALL SELECT project_id, file_id, 'GET', 'r' || r || '/me', 2, true FROM s WHERE b < 0)"""


@query(f"""WITH {_SQL} SELECT 'provides' AS role, method, regexp_replace(canonical, '^r[0-9]+/', '') AS canonical, count(*) AS sites FROM routes GROUP BY ALL UNION ALL SELECT 'consumes', method, canonical, count(*) FROM calls GROUP BY ALL UNION ALL SELECT 'mounts', NULL, 'r' || r, count(*) FROM n GROUP BY ALL""")
def canonical_routes(spark, root):
    """Endpoints as files have them, before mounts."""
    return _found(spark, root)[0].groupBy("role", "method", "canonical").agg(F.count("*").alias("sites"))


@query(f"WITH {_SQL} SELECT file_id, method, canonical, CAST(line AS BIGINT) AS line FROM routes")
def mounted_routes(spark, root):
    """Routes as clients reach them, under the mounts that lead to their files."""
    return contracts.provided(*_found(spark, root)).select("file_id", "method", "canonical", F.col("line").cast("long").alias("line"))


@query(f"""WITH {_SQL}, keyed AS (SELECT method, canonical, count(*) AS n FROM routes GROUP BY ALL)
SELECT c.method, c.canonical, count(*) AS consumers, CAST(coalesce(max(e.n), max(w.n), 0) AS BIGINT) AS providers FROM calls c LEFT JOIN keyed e ON e.method = c.method AND e.canonical = c.canonical LEFT JOIN keyed w ON w.method IS NULL AND w.canonical = c.canonical WHERE NOT external GROUP BY ALL""")
def contracts_matched(spark, root):
    found, imports = _found(spark, root)
    return contracts.match(found.where("role = 'consumes'"), contracts.provided(found, imports))


@query(f"""WITH {_SQL}, p AS (SELECT c.method, c.canonical, c.project_id, c.file_id, c.line, r.file_id AS provider FROM calls c LEFT JOIN routes r ON r.canonical = c.canonical AND (r.method = c.method OR r.method IS NULL) WHERE NOT external)
SELECT method, canonical, project_id, file_id, CAST(line AS BIGINT) AS line, provider FROM p""")
def contract_sites(spark, root):
    """Each call site with the file of the route that it meets."""
    found, imports = _found(spark, root)
    rows = contracts.links(found.where("role = 'consumes'"), contracts.provided(found, imports))
    return rows.select("method", "canonical", "providers", F.explode("consumers").alias("c")).select("method", "canonical", "c.project_id", "c.file_id", F.col("c.line").cast("long").alias("line"), F.explode_outer("providers").alias("p")).select("method", "canonical", "project_id", "file_id", "line", F.col("p.file_id").alias("provider"))


@query(f"""WITH {_SQL}, k AS (SELECT c.method, c.canonical, bool_or(r.file_id IS NOT NULL) AS met FROM calls c LEFT JOIN routes r ON r.canonical = c.canonical AND (r.method = c.method OR r.method IS NULL) WHERE NOT external GROUP BY ALL)
SELECT 'routes' AS metric, count(*) AS value FROM routes UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'external', count(*) FROM calls WHERE external UNION ALL SELECT 'linked', count(*) FROM k WHERE met UNION ALL SELECT 'unmatched', count(*) FROM k WHERE NOT met
UNION ALL SELECT 'unused', count(*) FROM routes r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE NOT c.external AND c.canonical = r.canonical AND (r.method IS NULL OR c.method = r.method))""")
def contract_report(spark, root):
    return contracts.report(*_found(spark, root))


@query(f"""WITH {_SQL} SELECT 'server' AS project_id, (SELECT count(*) FROM routes) AS provides, 0 AS consumes, (SELECT count(*) FROM n) AS mounts UNION ALL SELECT project_id, 0, count(*), 0 FROM calls GROUP BY ALL""")
def contract_roles(spark, root):
    return contracts.role_counts(_found(spark, root)[0])


@query(f"WITH {_SQL} SELECT file_id, project_id, method, CAST(line AS BIGINT) AS line FROM calls WHERE canonical = 'r1/n1/suppliers/{{}}'")
def contract_callers(spark, root):
    return contracts.callers_of(_found(spark, root)[0].where("role = 'consumes'"), "/R1/n1/suppliers/{}/").select("file_id", "project_id", "method", F.col("line").cast("long").alias("line"))


@query(f"WITH {_SQL} SELECT r.file_id AS origin, c.project_id, c.file_id, CAST(c.line AS BIGINT) AS line, c.method, c.canonical FROM routes r JOIN calls c ON c.canonical = r.canonical AND (r.method = c.method OR r.method IS NULL) WHERE NOT external")
def http_impact(spark, root):
    """What a change of each router reaches by HTTP."""
    found, imports = _found(spark, root)
    routes = contracts.provided(found, imports)
    hits = contracts.http_impact(routes, found.where("role = 'consumes'"), routes.select(F.col("file_id").alias("origin")).distinct())
    return hits.withColumn("line", F.col("line").cast("long"))


@query(f"""WITH {_SQL}, hops AS (SELECT DISTINCT 1000 + n AS origin, 'server' AS project_id, 'src/app' || r || '.ts' AS relative_path, 1 AS depth, 'imports' AS via FROM n),
web AS (SELECT DISTINCT r.file_id AS origin, c.project_id, 'src/c' || c.file_id - 10000 || '.ts' AS relative_path, 1 AS depth, 'http' AS via FROM routes r JOIN calls c ON c.canonical = r.canonical AND (r.method = c.method OR r.method IS NULL) WHERE NOT external AND c.project_id IN ('client0', 'client1', 'client2'))
SELECT * FROM hops UNION ALL SELECT * FROM web""")
def impact_over_http(spark, root):
    """What a change of each router reaches by imports and, within its workspace, by HTTP."""
    files, imports = _sources(spark, root)
    found = contracts.endpoints(files)
    routes = contracts.provided(found, imports)
    live = files.select("file_id", "project_id", F.col("path").alias("relative_path"))
    reached = imports.select(F.col("resolved_file_id").alias("origin"), F.col("file_id").alias("node"), F.lit(1).alias("depth")).distinct()
    members = spark.createDataFrame([("w", p, k) for k, p in enumerate(["server", "client0", "client1", "client2"])] + [("late", "server", 9), ("late", "client3", 9)], "workspace_id string, project_id string, added_at long")
    return contracts.impact_with_http(reached, routes, found.where("role = 'consumes'"), live, members)
