"""Queries of the project-intelligence operators over the domain tables, and their DuckDB counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import context, extract, graph, ingest, knowledge, orphans, search
from loomstead.session import materialise, normal_path, release, table
from loomstead.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}

_STATE = """state AS (SELECT id, arg_max(project_id, indexed_at) AS project_id, arg_max(relative_path, indexed_at) AS relative_path, arg_max({'v': language}, indexed_at).v AS language,
 arg_max(status, indexed_at) AS status, arg_max(size, indexed_at) AS size, arg_max(hash, indexed_at) AS hash, arg_max(last_modified, indexed_at) AS last_modified, min(indexed_at) AS seen FROM files GROUP BY id),
live AS (SELECT * FROM state WHERE status = 'active')"""


def _counted(sql: str) -> str:
    """``count_if(x)`` as a count of BIGINT type."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _counted(sql)
        return f
    return add


def current(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The files as they are: the last row of each id; only the given ``columns`` of it, if some are given."""
    files = table(spark, root, "files").where("id IS NOT NULL")
    if columns:
        files = files.select(*dict.fromkeys(["id", "indexed_at", *columns]))
    return ingest.latest(files, ["id"], [F.col("indexed_at")]).withColumnRenamed("id", "file_id")


def live(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return current(spark, root, *(("status", *columns) if columns else ())).where("status = 'active'")


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.import_edges(table(spark, root, "imports"), live(spark, root))


@query(f"WITH {_STATE} SELECT coalesce(language, 'other') AS language, count(*) AS files FROM live GROUP BY ALL")
def files_by_language(spark, root):
    return live(spark, root).groupBy(F.coalesce("language", F.lit("other")).alias("language")).agg(F.count("*").alias("files"))


@query(f"WITH {_STATE} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM live")
def file_totals(spark, root):
    return live(spark, root).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query(f"WITH {_STATE} SELECT id AS file_id, relative_path, length(relative_path) AS size FROM live WHERE relative_path ILIKE '%guard%' ORDER BY length(relative_path), relative_path, id LIMIT 20")
def find_file(spark, root):
    found = live(spark, root).where(F.col("relative_path").ilike("%guard%"))
    return found.select("file_id", "relative_path", F.length("relative_path").cast("long").alias("size")).orderBy("size", "relative_path", "file_id").limit(20)


@query(f"WITH {_STATE} SELECT id AS file_id, relative_path FROM live ORDER BY last_modified DESC, id LIMIT 20")
def recent_files(spark, root):
    return live(spark, root).orderBy(F.col("last_modified").desc(), "file_id").limit(20).select("file_id", "relative_path")


@query(f"""WITH {_STATE}, parts AS (SELECT project_id, coalesce(language, 'other') AS language, string_split(relative_path, '/') AS p FROM live)
SELECT project_id, CASE WHEN len(p) < 2 THEN '.' ELSE array_to_string(list_slice(p, 1, least(2, len(p) - 1)), '/') END AS directory, count(*) AS files,
 array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM parts GROUP BY ALL""")
def directory_rollup(spark, root):
    parts = F.split("relative_path", "/")
    folder = F.when(F.size(parts) < 2, ".").otherwise(F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1)), "/"))
    return live(spark, root).groupBy("project_id", folder.alias("directory")).agg(
        F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set(F.coalesce("language", F.lit("other")))), ",").alias("languages")
    )


@query(f"WITH {_STATE} SELECT regexp_matches(lower(relative_path), '{T.TEST_PATH}') AS is_test, count(*) AS files FROM live GROUP BY ALL")
def test_files(spark, root):
    return live(spark, root).groupBy(T.looks_like_test(F.col("relative_path")).alias("is_test")).agg(F.count("*").alias("files"))


@query(f"""WITH {_STATE} SELECT CASE WHEN regexp_matches(lower(relative_path), '{T.SENSITIVE_PATH}') THEN 'sensitive' WHEN regexp_matches(lower(relative_path), '(?:^|/)(?:node_modules|\\.git|dist|build|coverage|__pycache__)/') THEN 'ignored'
 WHEN regexp_matches(lower(relative_path), '{T.BINARY_PATH}') THEN 'binary' WHEN size > 8192 THEN 'too_large' ELSE 'indexed' END AS reason, count(*) AS files FROM state GROUP BY ALL""")
def skip_reasons(spark, root):
    reason = F.coalesce(T.skip_reason(F.col("relative_path"), F.col("size"), 8192), F.lit("indexed"))
    return current(spark, root).groupBy(reason.alias("reason")).agg(F.count("*").alias("files"))


@query("SELECT sha256(content) AS hash, count(DISTINCT file_id) AS copies, min(file_id) AS first_file FROM file_search WHERE content IS NOT NULL GROUP BY ALL HAVING count(DISTINCT file_id) > 1")
def duplicate_content(spark, root):
    rows = table(spark, root, "file_search").where("content IS NOT NULL").select(F.sha2("content", 256).alias("hash"), "file_id").distinct()  # hashes, not texts
    return rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("file_id").alias("first_file")).where("copies > 1")


_quoted = lambda p: p.replace("'", "''")
_DETECTED = ", ".join(f"len(regexp_extract_all(content, '{_quoted(p)}')) AS {n}" for n, p in T.SECRET_PATTERNS)


@query(f"SELECT * FROM (UNPIVOT (SELECT file_id, {_DETECTED} FROM (SELECT DISTINCT file_id, content FROM file_search)) ON {', '.join(n for n, _ in T.SECRET_PATTERNS)} INTO NAME detector VALUE occurrences) WHERE occurrences > 0")
def secret_findings(spark, root):
    rows = table(spark, root, "file_search").select("file_id", "content")
    each = F.array(*[F.struct(F.lit(n).alias("detector"), F.size(F.regexp_extract_all("content", F.lit(f"({T.java(p)})"), 1)).cast("long").alias("occurrences")) for n, p in T.SECRET_PATTERNS])
    return rows.select("file_id", F.explode(each).alias("x")).select("file_id", "x.detector", "x.occurrences").where("occurrences > 0").distinct()


def _redact_sql(column: str) -> str:
    for name, pattern in T.SECRET_PATTERNS:
        put = "\\1=<REDACTED>" if name == "assigned_secret" else "<REDACTED>"
        column = f"regexp_replace({column}, '{_quoted(pattern)}', '{put}', 'g')"
    return column


@query(f"SELECT DISTINCT file_id, sha256({_redact_sql('content')}) AS hash FROM file_search")
def redacted_text(spark, root):
    return table(spark, root, "file_search").select("file_id", F.sha2(T.redact(F.col("content")), 256).alias("hash")).distinct()


@query("SELECT least(9, tokens // 500) AS bucket, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) END AS tokens FROM documents) GROUP BY ALL")
def token_buckets(spark, root):
    rows = table(spark, root, "documents").select(T.estimate_tokens(F.col("text")).alias("tokens"))
    return rows.groupBy(F.expr("least(9L, tokens div 500)").alias("bucket")).agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


_SPLIT = "trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[._\\-$/]+', ' ', 'g')), '\\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT id AS symbol_id, {_SPLIT.format('qualified_name')} AS words FROM symbols")
def symbol_words(spark, root):
    return table(spark, root, "symbols").select(F.col("id").alias("symbol_id"), T.split_identifier(F.col("qualified_name")).alias("words")).distinct()


@query(f"SELECT word AS term, count(DISTINCT file_id) AS files FROM (SELECT file_id, unnest(string_split({_SPLIT.format('n')}, ' ')) AS word FROM (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]+')) AS n FROM file_search)) WHERE length(word) >= 3 GROUP BY ALL")
def identifier_terms(spark, root):
    rows = table(spark, root, "file_search").select("file_id", F.explode(T.identifier_stream(F.col("content"), 1 << 30)).alias("term")).distinct()
    return rows.groupBy("term").agg(F.count("*").alias("files"))


@query("SELECT type, count(*) AS symbols, count_if(exported) AS exported FROM (SELECT DISTINCT id, type, exported FROM symbols) GROUP BY ALL")
def symbols_by_type(spark, root):
    return table(spark, root, "symbols").select("id", "type", "exported").distinct().groupBy("type").agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"))


@query(f"""WITH {_STATE}, s AS (SELECT DISTINCT s.* FROM symbols s WHERE file_id IN (SELECT id FROM live)), hits AS (
 SELECT *, CASE WHEN lower(name) = 'dispatch' OR lower(qualified_name) = 'dispatch' THEN 0 ELSE 1 END AS tier FROM s WHERE name ILIKE '%dispatch%' OR qualified_name ILIKE '%dispatch%')
SELECT id AS symbol_id, tier FROM hits WHERE tier = (SELECT min(tier) FROM hits) ORDER BY exported DESC, length(name), name, id LIMIT 25""")
def find_symbol(spark, root):
    own = live(spark, root).select("file_id")
    rows = table(spark, root, "symbols").select("id", "file_id", "name", "qualified_name", "exported").distinct().join(own, "file_id", "left_semi")
    exact = (F.lower("name") == "dispatch") | (F.lower("qualified_name") == "dispatch")
    hits = rows.where(F.col("name").ilike("%dispatch%") | F.col("qualified_name").ilike("%dispatch%")).withColumn("tier", F.when(exact, 0).otherwise(1))
    best = hits.agg(F.min("tier")).first()[0]
    kept = hits.where(F.col("tier") == F.lit(best))
    return kept.orderBy(F.col("exported").desc(), F.length("name"), "name", "id").limit(25).select(F.col("id").alias("symbol_id"), "tier")


@query(f"""WITH {_STATE}, s AS (SELECT DISTINCT s.* FROM symbols s WHERE file_id IN (SELECT id FROM live)), scored AS (
 SELECT project_id, lower(name) AS name, id, exported::INT * 3 + CASE WHEN type IN ('class', 'interface', 'function', 'type', 'component', 'hook') THEN 2 WHEN type IN ('variable', 'property') THEN -2 ELSE 0 END AS score FROM s)
SELECT project_id, name, arg_max(id, (score, -id)) AS symbol_id, max(score) AS score, count(*) AS candidates FROM scored GROUP BY ALL HAVING count(*) > 1""")
def definition_pick(spark, root):
    own = live(spark, root).select("file_id")
    rows = table(spark, root, "symbols").select("id", "project_id", "file_id", "name", "type", "exported").distinct().join(own, "file_id", "left_semi")
    score = F.col("exported").cast("int") * 3 + F.when(F.col("type").isin("class", "interface", "function", "type", "component", "hook"), 2).when(F.col("type").isin("variable", "property"), -2).otherwise(0)
    return rows.withColumn("score", score).groupBy("project_id", F.lower("name").alias("name")).agg(
        F.max_by("id", F.struct("score", -F.col("id"))).alias("symbol_id"), F.max("score").alias("score"), F.count("*").alias("candidates")
    ).where("candidates > 1")


@query("""SELECT project_id, count(*) AS total, count_if(NOT is_external) AS internal, count_if(NOT is_external AND resolved_file_id IS NULL) AS unresolved, count(DISTINCT CASE WHEN is_external THEN package_name END) AS packages
FROM (SELECT DISTINCT * FROM imports) GROUP BY ALL""")
def import_stats(spark, root):
    return table(spark, root, "imports").select("id", "project_id", "is_external", "resolved_file_id", "package_name").distinct().groupBy("project_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_external")).alias("internal"), F.count_if(~F.col("is_external") & F.col("resolved_file_id").isNull()).alias("unresolved"),
        F.countDistinct(F.when(F.col("is_external"), F.col("package_name"))).alias("packages"),
    )


@query("SELECT package_name, count(DISTINCT file_id) AS files FROM imports WHERE is_external AND package_name IS NOT NULL GROUP BY ALL")
def external_packages(spark, root):
    rows = table(spark, root, "imports").where("is_external AND package_name IS NOT NULL").select("package_name", "file_id").distinct()
    return rows.groupBy("package_name").agg(F.count("*").alias("files"))


@query("SELECT project_id, count(*) AS files, count_if(parse_status = 'ok') AS parsed, count_if(parse_status IN ('partial', 'error')) AS with_errors, count_if(parse_status IS NULL) AS unparsed FROM (SELECT DISTINCT * FROM files) GROUP BY ALL")
def parse_stats(spark, root):
    status = F.col("parse_status")
    return table(spark, root, "files").distinct().groupBy("project_id").agg(
        F.count("*").alias("files"), F.count_if(status == "ok").alias("parsed"), F.count_if(status.isin("partial", "error")).alias("with_errors"), F.count_if(status.isNull()).alias("unparsed")
    )


_EDGES = f"""{_STATE}, edges AS (SELECT DISTINCT project_id, file_id AS source, resolved_file_id AS target, kind FROM imports
 WHERE resolved_file_id IN (SELECT id FROM live) AND file_id IN (SELECT id FROM live))"""


@query(f"WITH {_EDGES} SELECT * FROM edges")
def dependencies_of(spark, root):
    return _edges(spark, root)


@query(f"""WITH {_EDGES}, both_ends AS (SELECT DISTINCT source AS file_id, target AS o, NULL::BIGINT AS i FROM edges UNION SELECT DISTINCT target, NULL, source FROM edges)
SELECT file_id, count(o) AS dependencies, count(i) AS dependents FROM both_ends GROUP BY ALL""")
def graph_degrees(spark, root):
    return graph.degrees(_edges(spark, root))


def _reach_sql(tests: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, back AS (SELECT DISTINCT target AS node, source AS following FROM edges WHERE target <> source),
walk AS (SELECT id AS origin, id AS node, 0 AS depth FROM live WHERE id % 100 = 0 UNION SELECT w.origin, b.following, w.depth + 1 FROM walk w JOIN back b ON b.node = w.node WHERE w.depth < 3),
reached AS (SELECT origin, node, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT r.origin, l.relative_path, r.depth, regexp_matches(lower(l.relative_path), '{T.TEST_PATH}') AS is_test FROM reached r JOIN live l ON l.id = r.node WHERE r.depth > 0{tests}"""


def _impact(spark: SparkSession, root: str) -> DataFrame:
    own = live(spark, root)
    asked = own.where("file_id % 100 = 0").select(F.col("file_id").alias("origin"))  # the stated set of queries, against all edges
    return graph.impact(_edges(spark, root), own, asked, depth=3)


@query(_reach_sql(""))
def impact_depth3(spark, root):
    return _impact(spark, root)


@query(_reach_sql(f" AND regexp_matches(lower(l.relative_path), '{T.TEST_PATH}')") + f" UNION ALL SELECT id, relative_path, 0, true FROM live WHERE id % 100 = 0 AND regexp_matches(lower(relative_path), '{T.TEST_PATH}')")
def affected_tests(spark, root):
    own = live(spark, root).where("file_id % 100 = 0").where(T.looks_like_test(F.col("relative_path"))).select(F.col("file_id").alias("origin"), "relative_path", F.lit(0).alias("depth"), F.lit(True).alias("is_test"))
    return _impact(spark, root).where("is_test").unionByName(own)


@query(f"""WITH {_STATE}, r AS (SELECT DISTINCT * FROM symbol_references WHERE file_id IN (SELECT id FROM live))
SELECT project_id, name, kind, count(*) AS refs, count(DISTINCT file_id) AS files, min(line) AS first_line FROM r GROUP BY ALL""")
def references_grouped(spark, root):
    rows = table(spark, root, "symbol_references").select("id", "project_id", "file_id", "name", "kind", "line").distinct().join(live(spark, root).select("file_id"), "file_id", "left_semi")
    return rows.groupBy("project_id", "name", "kind").agg(F.count("*").alias("refs"), F.countDistinct("file_id").alias("files"), F.min("line").alias("first_line"))


@query(f"""WITH {_STATE}, c AS (SELECT DISTINCT ON (id) * FROM context_cache), f AS (SELECT id, project_id, unnest(files) AS f FROM c),
now AS (SELECT project_id, relative_path, max(hash) AS h FROM live GROUP BY ALL),
j AS (SELECT c.id, c.project_id, f.f.path AS path, f.f.hash AS hash, now.h FROM c LEFT JOIN f ON f.id = c.id LEFT JOIN now ON now.project_id = c.project_id AND now.relative_path = regexp_replace(replace(f.f.path, '\\', '/'), '^\\./', '')),
n AS (SELECT id, project_id, count_if(h IS NOT NULL AND h IS DISTINCT FROM hash) AS stale, count_if(path IS NOT NULL AND h IS NULL) AS missing FROM j GROUP BY ALL)
SELECT *, CASE WHEN stale = 0 AND missing = 0 THEN 'hit' WHEN stale <= 3 AND missing = 0 THEN 'incremental' ELSE 'miss' END AS state FROM n""")
def cache_validation(spark, root):
    return knowledge.cache_state(table(spark, root, "context_cache").dropDuplicates(["id"]), live(spark, root))


@query("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY last_used_at DESC, id) AS r FROM (SELECT DISTINCT id, project_id, last_used_at FROM context_cache)) WHERE r <= 3""")
def cache_eviction(spark, root):
    return knowledge.evict(table(spark, root, "context_cache").select("id", "project_id", "last_used_at").distinct(), keep=3).select("id")


@query("""SELECT count(*) AS requests, count_if(k = 'hit') AS hits, count_if(k = 'incremental') AS incremental, count_if(k = 'miss') AS misses, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(a) AS BIGINT) AS avoided,
 round(count_if(k IN ('hit', 'incremental')) / count(*), 3) AS hit_rate, round(avg(t)) AS average_tokens
FROM (SELECT DISTINCT id, CASE WHEN hits > 2 THEN 'hit' WHEN hits > 0 THEN 'incremental' ELSE 'miss' END AS k, token_estimate AS t, len(files) AS a FROM context_cache)""")
def cache_analytics(spark, root):
    kind = F.when(F.col("hits") > 2, "hit").when(F.col("hits") > 0, "incremental").otherwise("miss")
    rows = table(spark, root, "context_cache").select("id", kind.alias("cache"), F.col("token_estimate").alias("tokens"), F.size("files").cast("long").alias("files_avoided")).distinct()
    return knowledge.cache_analytics(rows)


def _intent_sql() -> str:
    count = lambda p: f"len(regexp_extract_all(lower(coalesce(task, '')), '{p}'))"
    scores = [f"{count(p)} * {w}" for _, w, p in T.INTENTS]
    top = f"greatest({', '.join(scores)})"
    return f"SELECT CASE WHEN {top} = 0 THEN 'general' " + " ".join(f"WHEN {s} = {top} THEN '{n}'" for s, (n, _, _) in zip(scores, T.INTENTS)) + " END AS intent, count(*) AS tasks FROM (SELECT DISTINCT id, task FROM context_cache) GROUP BY ALL"


@query(_intent_sql())
def intent_of_tasks(spark, root):
    rows = table(spark, root, "context_cache").select("id", "task").distinct()
    return rows.groupBy(T.detect_intent(F.col("task")).alias("intent")).agg(F.count("*").alias("tasks"))


def _short_sql(column: str, limit: int) -> str:
    flat = f"trim(regexp_replace({_redact_sql(column)}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > {limit} THEN substr({flat}, 1, {limit - 1}) || '…' ELSE {flat} END AS {column}"


@query(f"SELECT id, project_id, source, tool, {_short_sql('summary', 200)}, {_short_sql('detail', 400)}, outcome FROM (SELECT DISTINCT id, project_id, source, tool, summary, detail, outcome FROM activity WHERE id > 500 ORDER BY id DESC LIMIT 100)")
def activity_page(spark, root):
    return knowledge.feed(table(spark, root, "activity"), 500)


@query("SELECT coalesce(tool, source) AS tool, count(*) AS calls FROM (SELECT DISTINCT id, tool, source FROM activity ORDER BY id DESC LIMIT 2000) GROUP BY ALL")
def activity_latest_tools(spark, root):
    newest = table(spark, root, "activity").select("id", "tool", "source").distinct().orderBy(F.col("id").desc()).limit(2000)
    return newest.groupBy(F.coalesce("tool", "source").alias("tool")).agg(F.count("*").alias("calls"))


@query("SELECT lower(trim(agent)) AS agent, count(DISTINCT id) AS events, count(DISTINCT project_id) AS projects FROM activity WHERE agent IS NOT NULL GROUP BY ALL")
def activity_by_agent(spark, root):
    return table(spark, root, "activity").where("agent IS NOT NULL").groupBy(F.lower(F.trim("agent")).alias("agent")).agg(F.countDistinct("id").alias("events"), F.countDistinct("project_id").alias("projects"))


@query(f"""WITH e AS (SELECT DISTINCT project_id, coalesce(summary, '') AS p, "at" AS moment FROM activity WHERE source = 'file' AND "at" IS NOT NULL AND project_id IS NOT NULL),
f AS (SELECT *, CASE WHEN moment - lag(moment) OVER w <= INTERVAL 300 MILLISECOND THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY project_id ORDER BY moment, p)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY moment, p) AS batch FROM f)
SELECT project_id, epoch_us(min(moment)) AS start_us, epoch_us(max(moment)) + 300000 AS end_us, CAST(count(DISTINCT p) AS BIGINT) AS paths FROM n GROUP BY project_id, batch""")
def debounce_batches(spark, root):
    rows = table(spark, root, "activity").where("source = 'file' AND at IS NOT NULL AND project_id IS NOT NULL")
    events = rows.select("project_id", F.coalesce("summary", F.lit("")).alias("relative_path"), F.timestamp_micros(orphans.utc_micros(F.col("at"))).alias("at"))
    return watch.debounce(events, ignore=False).select("project_id", F.unix_micros("started").alias("start_us"), F.unix_micros("ended").alias("end_us"), F.size("paths").cast("long").alias("paths"))


@query("""WITH cut AS (SELECT quantile_disc(indexed_at, 0.5) AS c FROM files), f AS (SELECT DISTINCT project_id, id, relative_path, hash, status, indexed_at FROM files),
b AS (SELECT id, arg_max(project_id, indexed_at) AS project_id, arg_max(relative_path, indexed_at) AS relative_path, arg_max(hash, indexed_at) AS hash, arg_max(status, indexed_at) AS status FROM f WHERE indexed_at <= TIMESTAMP '2016-01-20 00:00:00' GROUP BY id),
a AS (SELECT id, arg_max(project_id, indexed_at) AS project_id, arg_max(relative_path, indexed_at) AS relative_path, arg_max(hash, indexed_at) AS hash, arg_max(status, indexed_at) AS status FROM f GROUP BY id),
s AS (SELECT project_id, relative_path, min(hash) AS hash FROM a WHERE status = 'active' GROUP BY ALL), o AS (SELECT project_id, relative_path, min(hash) AS hash, bool_or(status = 'active') AS active FROM b GROUP BY ALL),
j AS (SELECT CASE WHEN o.relative_path IS NULL THEN 'added' WHEN s.relative_path IS NULL THEN CASE WHEN o.active THEN 'deleted' END WHEN NOT o.active OR o.hash IS DISTINCT FROM s.hash THEN 'updated' ELSE 'unchanged' END AS change
 FROM o FULL JOIN s ON o.project_id = s.project_id AND o.relative_path = s.relative_path)
SELECT change, count(*) AS files FROM j WHERE change IS NOT NULL GROUP BY ALL""")
def snapshot_diff(spark, root):
    log = table(spark, root, "files").where("id IS NOT NULL").select("id", "project_id", "relative_path", "hash", "status", "indexed_at")
    order = [F.col("indexed_at")]
    before = ingest.latest(log.where(orphans.utc_micros(F.col("indexed_at")) <= 1453248000000000), ["id"], order)
    after = ingest.latest(log, ["id"], order).where("status = 'active'")
    old = before.groupBy("project_id", "relative_path").agg(F.min("hash").alias("hash"), F.bool_or(F.col("status") == "active").alias("active"))
    new = after.groupBy("project_id", "relative_path").agg(F.min("hash").alias("hash"))
    return ingest.snapshot_diff(old, new).groupBy("change").agg(F.count("*").alias("files"))


def _bm25_sql(source: str, key: str, columns: dict[str, float], text: str, k: int) -> str:
    terms = search.clauses(text)
    tf = lambda c, t, p: f"len(list_filter({c}, lambda x: {'starts_with(x, ' + repr(t) + ')' if p else 'x = ' + repr(t)}))"
    tokens = ", ".join(f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+') AS t{i}" for i, c in enumerate(columns))
    freq = ", ".join("(" + " + ".join(f"{tf(f't{i}', t, p)} * {float(w)}" for i, w in enumerate(columns.values())) + f") AS f{j}" for j, (t, p) in enumerate(terms))
    size = " + ".join(f"len(t{i})" for i in range(len(columns)))
    score = " + ".join(f"greatest(1e-6, ln((n - d{j} + 0.5) / (d{j} + 0.5))) * (f{j} * 2.2 / (f{j} + 1.2 * (1 - 0.75 + 0.75 * size / avgdl)))" for j in range(len(terms)))
    return f"""WITH docs AS ({source}), tok AS (SELECT {key} AS key, {tokens} FROM docs), r AS (SELECT key, {size} AS size, {freq} FROM tok),
fig AS (SELECT count(*) AS n, avg(size) AS avgdl, {', '.join(f'count_if(f{j} > 0) AS d{j}' for j in range(len(terms)))} FROM r),
s AS (SELECT key, round({score}, 6) AS score FROM r, fig WHERE {' OR '.join(f'f{j} > 0' for j in range(len(terms)))} ORDER BY score DESC, key LIMIT {k})
SELECT key AS {key}, round(CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END, 4) AS relevance FROM s"""


DOCUMENT_QUERY, FILE_QUERY, SYMBOL_QUERY = "why does the nightly job rebuild the symbol table", "fix payment verification running twice", "dispatch payment record"


@query(_bm25_sql("SELECT doc_id, text FROM documents", "doc_id", {"text": 1.0}, DOCUMENT_QUERY, 25))
def search_documents(spark, root):
    return search.search(table(spark, root, "documents"), DOCUMENT_QUERY, {"text": 1.0}, key="doc_id").select("doc_id", "relevance")


@query(_bm25_sql("SELECT DISTINCT file_id, path, content, identifiers FROM file_search", "file_id", {"path": 8, "content": 1, "identifiers": 4}, FILE_QUERY, 25))
def search_files(spark, root):
    rows = table(spark, root, "file_search").select("file_id", "path", "content", "identifiers")
    return search.search(rows, FILE_QUERY, {"path": 8, "content": 1, "identifiers": 4}, key="file_id", repeated=True).select("file_id", "relevance")


@query(_bm25_sql(f"WITH {_STATE} SELECT DISTINCT s.id AS symbol_id, {_SPLIT.format('s.name')} AS name, {_SPLIT.format('s.qualified_name')} AS qualified_name, s.signature, l.relative_path FROM symbols s JOIN live l ON l.id = s.file_id", "symbol_id", {"name": 10, "qualified_name": 6, "signature": 1, "relative_path": 2}, SYMBOL_QUERY, 25))
def search_symbols(spark, root):
    rows = table(spark, root, "symbols").select(F.col("id").alias("symbol_id"), "file_id", T.split_identifier(F.col("name")).alias("name"), T.split_identifier(F.col("qualified_name")).alias("qualified_name"), "signature").distinct().join(live(spark, root).select("file_id", "relative_path"), "file_id")
    return search.search(rows, SYMBOL_QUERY, {"name": 10, "qualified_name": 6, "signature": 1, "relative_path": 2}, key="symbol_id").select("symbol_id", "relevance")


@query("SELECT id AS project_id, lower(trim(remote_url)) AS remote, 'proj_' || substr(sha256(coalesce('remote:' || lower(trim(remote_url)), 'path:' || root_path)), 1, 10) AS identity FROM projects")
def project_identities(spark, root):
    none = F.lit(None).cast("string")
    return table(spark, root, "projects").select(F.col("id").alias("project_id"), T.normal_remote(F.col("remote_url")).alias("remote"), T.project_identity(F.col("remote_url"), none, none, F.col("root_path")).alias("identity"))


@query(f"""WITH {_STATE} SELECT 'projects' AS metric, count(*) AS value FROM projects UNION ALL SELECT 'files', count(*) FROM live UNION ALL SELECT 'symbols', count(DISTINCT id) FROM symbols
UNION ALL SELECT 'imports', count(DISTINCT id) FROM imports UNION ALL SELECT 'references', count(DISTINCT id) FROM symbol_references UNION ALL SELECT 'events', count(DISTINCT id) FROM activity UNION ALL SELECT 'documents', count(*) FROM documents""")
def overview_totals(spark, root):
    ids = lambda name: table(spark, root, name).agg(F.countDistinct("id").alias("value"))
    rows = {
        "projects": table(spark, root, "projects").agg(F.count("*").alias("value")), "files": live(spark, root).agg(F.count("*").alias("value")), "symbols": ids("symbols"),
        "imports": ids("imports"), "references": ids("symbol_references"), "events": ids("activity"), "documents": table(spark, root, "documents").agg(F.count("*").alias("value")),
    }
    found = [frame.select(F.lit(name).alias("metric"), "value") for name, frame in rows.items()]
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


_TASKS = "SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'PLANNING' END AS status FROM orders"


@query(f"""WITH t AS ({_TASKS}), r AS (SELECT l_orderkey AS task_id, count_if(l_linestatus = 'F') AS done, count(*) AS total FROM lineitem GROUP BY ALL)
SELECT t.task_id, t.status, coalesce(done, 0) AS done, coalesce(total, 0) AS total, CAST(CASE WHEN coalesce(total, 0) > 0 THEN round(100.0::DOUBLE * done / total) WHEN t.status = 'COMPLETED' THEN 100 ELSE 0 END AS BIGINT) AS percent FROM t LEFT JOIN r USING (task_id)""")
def task_board(spark, root):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("PLANNING")
    tasks = table(spark, root, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"))
    needs = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_linestatus") == "F").alias("done"))
    return knowledge.progress(tasks, needs)


@query("SELECT project_id, type, count(*) AS records, CAST(sum(times) AS BIGINT) AS times FROM (SELECT source AS project_id, upper(coalesce(kind, 'fact')) AS type, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS c, count(*) AS times FROM documents GROUP BY ALL) GROUP BY ALL")
def remembered_records(spark, root):
    rows = table(spark, root, "documents").select(
        F.col("source").alias("project_id"), F.upper(F.coalesce("kind", F.lit("fact"))).alias("type"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("double").alias("importance"), F.array("lang").alias("tags"), "created_at",
    )
    return knowledge.remember(rows).groupBy("project_id", "type").agg(F.count("*").alias("records"), F.sum("times").alias("times"))


@query()
def extracted_symbols(spark, root):
    """Symbols read from the present text of every file."""
    rows = table(spark, root, "file_search").select("file_id", "path", "content")
    return extract.extract_symbols(rows).select("file_id", "ordinal", "name", "qualified_name", "type", "line_start", "line_end", "exported").distinct()


@query()
def extracted_references(spark, root):
    """References read from the present text of every file, with the symbol around each."""
    rows = table(spark, root, "file_search").select("file_id", "project_id", "path", "content")
    return extract.extract_references(rows).select("file_id", "project_id", "ordinal", "name", "kind", "line", "from_ordinal").distinct()


@query()
def resolved_imports(spark, root):
    """Imports read from the present text, resolved against the files that are active."""
    found = extract.extract_imports(table(spark, root, "file_search")).distinct()
    return extract.resolve_imports(found, live(spark, root).select("project_id", "relative_path", "file_id")).select("file_id", "specifier", "kind", "line", "is_external", "package_name", "resolved_path")


_EVIDENCE = f"""{_STATE}, asks AS (SELECT DISTINCT id AS request_id, project_id, task FROM context_cache WHERE task IS NOT NULL),
words AS (SELECT request_id, project_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(task), '[a-z0-9_$]{{2,}}'), lambda w: length(w) >= 4))) AS word FROM asks),
path_words AS (SELECT DISTINCT project_id, relative_path AS path, last_modified, unnest(string_split(trim(regexp_replace(lower(relative_path), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM live),
hits AS (SELECT w.request_id, p.path, count(DISTINCT w.word) AS n FROM words w JOIN path_words p ON p.project_id = w.project_id AND p.word = w.word GROUP BY ALL)
SELECT request_id, path, round(0.85 * least(1.0, n / 3.0), 6) AS score, round(least(1.0, n / 3.0) / max(least(1.0, n / 3.0)) OVER (PARTITION BY request_id), 3) AS relevance FROM hits"""


def _asks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "context_cache").where("task IS NOT NULL").select(F.col("id").alias("request_id"), "project_id", "task").distinct()


def _evidence(spark: SparkSession, root: str, *, k: int | None = None, others: DataFrame | None = None) -> DataFrame:
    """Path evidence of every cached request at once: files whose path holds words of the request.

    With ``k`` it is enough for the ``k`` best files of each request if ``others`` are the ``(request_id, path)`` for which something else speaks.
    """
    plain, other = context.worded(_asks(spark, root))
    files = live(spark, root, "project_id", "relative_path").select("project_id", F.col("relative_path").alias("path"))
    held = context.asked_words(plain, files)
    hits = context.path_hits(plain, held) if k is None else context.best_path_hits(plain, held, k=k)
    if others is not None:
        hits = hits.unionByName(context.hits_of(others, plain).select("request_id", "path", "n"))
    return context.words_evidence(hits.unionByName(context.grouped_hits(other, files)))


@query("WITH " + _EVIDENCE)
def context_evidence_scores(spark, root):
    """Two passes: the best score of each request from the words alone, then all pairs, none of which is shuffled."""
    plain, other = context.worded(_asks(spark, root))
    files = live(spark, root, "project_id", "relative_path").select("project_id", F.col("relative_path").alias("path"))
    held = context.asked_words(plain, files)
    top = context.most_hits(plain, held).select("request_id", context.words_score(F.col("n")).alias("_top"))
    score = context.words_score(F.col("n"))
    rows = context.path_hits(plain.join(top, "request_id"), held).select("request_id", "path", score.alias("score"), context.share_of(score, F.col("_top")).alias("relevance"))
    rest = context.rank(context.combine(context.words_evidence(context.grouped_hits(other, files)))).select("request_id", "path", "score", "relevance")
    return rows.unionByName(rest)


def _all_evidence(spark: SparkSession, root: str, *, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(asks, files, evidence)``: all kinds of evidence but the neighbours, for every cached request within its project.

    With ``k``, the evidence is kept, and of path words it has those of the ``k`` best files of each request and of the files for which something else speaks.
    """
    asks = _asks(spark, root).withColumn("intent", T.detect_intent(F.col("task")))
    files = live(spark, root, "project_id", "relative_path", "size", "symbol_count", "last_modified").select("project_id", "file_id", F.col("relative_path").alias("path"), "size", "symbol_count", "last_modified")
    files = files if k is None else materialise(files)
    own = files.select("project_id", "file_id", "path")
    # rows that repeat an id are left out last, so that those left lie by the key of the search
    symbols = table(spark, root, "symbols").select("id", "file_id", "name", "qualified_name", "signature").join(own, "file_id").dropDuplicates(["id"])
    texts = table(spark, root, "file_search").select("file_id", "content", "identifiers").dropDuplicates(["file_id"]).join(own, "file_id")
    named = symbols.select("id", "project_id", T.split_identifier(F.col("name")).alias("name"), T.split_identifier(F.col("qualified_name")).alias("qualified"), "signature", "path")
    by_symbol = search.search_many(asks, named, {"name": 10, "qualified": 6, "signature": 1, "path": 2}, keep=("path",)).where("id IS NOT NULL")
    release(spark)
    by_text = search.search_many(asks, texts, {"path": 8, "content": 1, "identifiers": 4}, key="file_id", keep=("path",))
    release(spark)
    hit = lambda rows, share, why: rows.select("request_id", "path", F.lit("search").alias("component"), (F.col("relevance") * share).alias("strength"), F.lit(why).alias("reason"))
    memories = table(spark, root, "documents").where("kind = 'memory' AND text IS NOT NULL").select(F.col("source").alias("project_id"), F.col("doc_id").alias("id"), "text", F.lit(0.9).alias("importance"))
    found = [
        context.named_paths(asks, files), context.named_symbols(asks, symbols), hit(by_symbol, 1.0, "symbol match"), hit(by_text, 0.8, "content match"),
        context.recent_changes(asks, files), context.remembered(asks, memories, files),
    ]
    others = reduce(DataFrame.unionByName, found)
    if k is None:
        return asks, files, others.unionByName(_evidence(spark, root))
    others = materialise(others)
    release(spark)
    plain, other = context.worded(asks)
    hits = context.top_path_hits(plain, context.asked_words(plain, own), k=k).unionByName(context.hits_of(others, plain).select("request_id", "path", "n"))
    hits = materialise(hits.unionByName(context.grouped_hits(other, own)))
    release(spark)
    return asks, files, others.unionByName(context.words_evidence(hits))


def _spoken(spark: SparkSession, root: str, *, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(asks, files, evidence)``: all kinds of evidence for the ``k`` best files of each request and for all others but those for which only words in their path speak."""
    asks, files, found = _all_evidence(spark, root, k=max(k, context.SEEDS))
    scored = context.combine(found.repartition("request_id")).join(asks.select("request_id", "project_id", "intent"), "request_id")
    names = files.select("file_id", "path")
    edges = _edges(spark, root).join(names.withColumnsRenamed({"file_id": "source", "path": "_s"}), "source").join(names.withColumnsRenamed({"file_id": "target", "path": "_t"}), "target").select("project_id", F.col("_s").alias("source"), F.col("_t").alias("target")).distinct()
    near = materialise(context.neighbours(scored, edges))
    release(spark)
    near = near.unionByName(context.words_evidence(context.hits_of(near, context.worded(asks)[0])))
    return asks, files, found.unionByName(near).repartition("request_id")


def _ranked_context(spark: SparkSession, root: str, *, k: int) -> tuple[DataFrame, DataFrame]:
    """``(ranked, files)``; the ``k`` best files of each request are among those ranked, in their order."""
    asks, files, spoken = _spoken(spark, root, k=k)
    return context.rank(context.combine(spoken)).join(asks.select("request_id", "project_id").distinct(), "request_id"), files


@query()
def context_all_evidence(spark, root):
    """Every file that speaks for a cached request, from all kinds of evidence. Of the pairs for which only words in the path speak, none is shuffled."""
    asks, files, spoken = _spoken(spark, root, k=1)
    own = asks.select("request_id", "project_id").distinct()
    columns = ["request_id", "project_id", "path", "score", "relevance", "reasons"]
    scored = context.combine(spoken)
    ranked = context.rank(scored).join(own, "request_id").select(*columns)
    # the best file of each request is among those that are scored, so that its score is the request's best
    top = scored.groupBy("request_id").agg(F.max("score").alias("_top"))
    plain = context.worded(asks)[0]
    asked = plain.join(top, "request_id").withColumn("_project", F.col("project_id"))
    score = context.words_score(F.col("n"))
    rest = context.path_hits(asked, context.asked_words(plain, files), but=context.hits_of(spoken, plain))
    rest = rest.select("request_id", F.col("_project").alias("project_id"), "path", score.alias("score"), context.share_of(score, F.col("_top")).alias("relevance"), F.array(F.lit(context.WORDS_REASON)).alias("reasons"))
    return ranked.unionByName(rest)


def _costs(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id", "path").agg(F.max(F.ceil(F.col("size") / 4)).alias("full_tokens"), F.max(20 + 12 * F.coalesce("symbol_count", F.lit(0))).alias("outline_tokens"))


@query()
def context_budget_fill(spark, root):
    """Context of every cached request: all evidence, neighbours in the import graph, ranking, budget."""
    ranked, files = _ranked_context(spark, root, k=13)  # one more than can be taken
    return context.fill_budget(ranked.join(_costs(files), ["project_id", "path"]).select("request_id", "path", "relevance", "full_tokens", "outline_tokens"))


_FILL = f"""{_STATE}, asks AS (SELECT DISTINCT id AS request_id, project_id, task FROM context_cache WHERE task IS NOT NULL),
words AS (SELECT request_id, project_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(task), '[a-z0-9_$]{{2,}}'), lambda w: length(w) >= 4))) AS word FROM asks),
path_words AS (SELECT DISTINCT project_id, relative_path AS path, unnest(string_split(trim(regexp_replace(lower(relative_path), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM live),
hits AS (SELECT w.request_id, p.path, 0.85 * least(1.0, count(DISTINCT w.word) / 3.0) AS part FROM words w JOIN path_words p ON p.project_id = w.project_id AND p.word = w.word GROUP BY ALL),
late AS (SELECT DISTINCT project_id, relative_path AS path FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY last_modified DESC, relative_path) AS r FROM live) WHERE r <= 10),
evidence AS (SELECT request_id, path, part FROM hits UNION ALL SELECT request_id, path, 0.3 FROM asks JOIN late USING (project_id)),
scored AS (SELECT request_id, path, round(sum(part), 6) AS score FROM evidence GROUP BY ALL), ranked AS (SELECT *, round(score / max(score) OVER (PARTITION BY request_id), 3) AS relevance FROM scored),
costs AS (SELECT project_id, relative_path AS path, CAST(max(ceil(size / 4.0)) AS BIGINT) AS full_t FROM live GROUP BY ALL), outs AS (SELECT project_id, relative_path AS path, max(20 + 12 * coalesce(n, 0)) AS out_t FROM live l JOIN (SELECT id, arg_max({{'v': symbol_count}}, indexed_at).v AS n FROM files GROUP BY id) USING (id) GROUP BY ALL),
r AS (SELECT k.request_id, k.path, full_t, out_t, 40 + length(a.task) AS header, row_number() OVER (PARTITION BY k.request_id ORDER BY relevance DESC, k.path) AS i FROM ranked k JOIN asks a USING (request_id) JOIN costs c ON c.project_id = a.project_id AND c.path = k.path JOIN outs o ON o.project_id = a.project_id AND o.path = k.path),
fill AS (SELECT request_id, CAST(0 AS BIGINT) AS i, CAST(max(header) AS BIGINT) AS used, 0 AS taken, false AS stop, CAST(NULL AS VARCHAR) AS path, 0 AS level, CAST(0 AS BIGINT) AS tokens FROM r GROUP BY ALL
 UNION ALL SELECT f.request_id, r.i, f.used + CASE WHEN f.taken >= 6 THEN 0 WHEN f.taken < 4 AND f.used + full_t <= 1500 THEN full_t WHEN f.used + out_t <= 1500 THEN out_t ELSE 0 END, f.taken + CASE WHEN f.taken < 6 AND ((f.taken < 4 AND f.used + full_t <= 1500) OR f.used + out_t <= 1500) THEN 1 ELSE 0 END,
 NOT (f.taken < 6 AND ((f.taken < 4 AND f.used + full_t <= 1500) OR f.used + out_t <= 1500)), r.path, CASE WHEN f.taken < 4 AND f.used + full_t <= 1500 THEN 2 ELSE 1 END, CASE WHEN f.taken < 4 AND f.used + full_t <= 1500 THEN full_t ELSE out_t END FROM fill f JOIN r ON r.request_id = f.request_id AND r.i = f.i + 1 WHERE NOT f.stop)"""


@query(f"WITH RECURSIVE {_FILL} SELECT request_id, path, level, tokens, CAST(taken - 1 AS BIGINT) AS position, bool_or(stop) OVER (PARTITION BY request_id) AS truncated FROM fill WHERE i > 0 QUALIFY NOT stop")
def context_fill_by_path(spark, root):
    """Context of every cached request from path words and recent changes: ranking, header, four files with source, six in all, 1,500 tokens."""
    most = 6
    asks = _asks(spark, root)
    files = live(spark, root, "project_id", "relative_path", "size", "symbol_count", "last_modified").select("project_id", F.col("relative_path").alias("path"), "size", "symbol_count", "last_modified")
    recent = context.recent_changes(asks, files)
    # only the best files of a request can be taken: the words in all other paths need not be ranked
    ranked = context.rank(context.combine(recent.unionByName(_evidence(spark, root, k=most + 1, others=recent))))
    costed = ranked.join(asks.select("request_id", "project_id", (40 + F.length("task")).alias("header_tokens")), "request_id").join(_costs(files), ["project_id", "path"])
    found = context.fill_budget(costed, budget=1500, max_files=most, sources=4)
    return found.withColumn("position", F.col("position").cast("long"))


@query("SELECT project_id, outcome, count(DISTINCT id) AS events, count(DISTINCT CASE WHEN duration_ms > 1000 THEN id END) AS slow FROM activity WHERE project_id IS NOT NULL GROUP BY ALL")
def activity_outcomes(spark, root):
    return table(spark, root, "activity").where("project_id IS NOT NULL").groupBy("project_id", "outcome").agg(F.countDistinct("id").alias("events"), F.countDistinct(F.when(F.col("duration_ms") > 1000, F.col("id"))).alias("slow"))


@query(f"WITH {_STATE}, lost AS (SELECT DISTINCT file_id FROM symbols WHERE file_id NOT IN (SELECT id FROM live)) SELECT s.project_id, count(DISTINCT s.id) AS symbols FROM symbols s JOIN lost USING (file_id) GROUP BY ALL")
def leftover_symbols(spark, root):
    rows = table(spark, root, "symbols").select("id", "project_id", "file_id").distinct().join(live(spark, root).select("file_id"), "file_id", "left_anti")
    return rows.groupBy("project_id").agg(F.count("*").alias("symbols"))


@query(f"""WITH {_STATE}, t AS (SELECT project_id, relative_path, min(id) AS target FROM live GROUP BY ALL), i AS (SELECT DISTINCT id, project_id, regexp_replace(replace(resolved_path, '\\', '/'), '^\\./', '') AS p, resolved_file_id FROM imports WHERE resolved_path IS NOT NULL)
SELECT i.id AS import_id, t.target AS linked, i.resolved_file_id AS before FROM i LEFT JOIN t ON t.project_id = i.project_id AND t.relative_path = i.p WHERE t.target IS DISTINCT FROM i.resolved_file_id""")
def relinked_imports(spark, root):
    rows = table(spark, root, "imports").where("resolved_path IS NOT NULL").select("id", "project_id", normal_path(F.col("resolved_path")).alias("resolved_path"), "resolved_file_id", F.col("resolved_file_id").alias("before")).distinct()
    linked = ingest.relink(rows, live(spark, root))
    return linked.where(~F.col("resolved_file_id").eqNullSafe(F.col("before"))).select(F.col("id").alias("import_id"), F.col("resolved_file_id").alias("linked"), "before")


_BLANK_SQL = "[\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"
_clean_sql = lambda column: f"trim(regexp_replace(lower(coalesce({column}, '')), '{_BLANK_SQL}', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, nullif(regexp_extract(text, '^(?:# )?([^\n]{{3,80}})\n', 1), '') AS title, text FROM documents)
SELECT doc_id, title, substr(sha256('readme|' || {_clean_sql('title')} || '|' || {_clean_sql('text')}), 1, 32) AS content_hash FROM d""")
def record_hashes(spark, root):
    """Record hash of every document; one without a title line has a null title, which counts as empty."""
    title = F.nullif(F.regexp_extract("text", r"^(?:# )?([^\n]{3,80})\n", 1), F.lit(""))
    rows = table(spark, root, "documents").withColumn("title", title)
    return rows.select("doc_id", "title", T.content_hash(F.lit("readme"), F.col("title"), F.col("text")).alias("content_hash"))


document_hashes = record_hashes  # both names are in use
QUERIES["document_hashes"], SQL["document_hashes"] = record_hashes, SQL["record_hashes"]
