"""Lookups, lists and joins that clients make, for all projects at once, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import knowledge, stores
from loomstead.plans import store_queries
from loomstead.plans.reference_queries import _DETECTED, _STATE, _counted, current, live
from loomstead.session import normal_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _counted(sql)
        return f
    return add


@query(f"WITH {_STATE} SELECT project_id, language, id AS file_id, row_number() OVER (PARTITION BY project_id, language ORDER BY relative_path, id) AS place FROM live WHERE language IS NOT NULL")
def files_of_languages(spark, root):
    """Active files of each project and language, by path."""
    order = Window.partitionBy("project_id", "language").orderBy("relative_path", "file_id")
    return live(spark, root).where("language IS NOT NULL").select("project_id", "language", "file_id", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {_STATE}, asked AS (SELECT DISTINCT project_id, regexp_replace(replace(f.path, '\\', '/'), '^\\./', '') AS path FROM (SELECT project_id, unnest(files) AS f FROM context_cache))
SELECT a.project_id, a.path, s.id AS file_id, s.status FROM asked a JOIN state s ON s.project_id = a.project_id AND s.relative_path = a.path""")
def file_lookups(spark, root):
    """The files at the paths that cached contexts name, whatever their status."""
    asked = table(spark, root, "context_cache").select("project_id", F.explode("files").alias("f")).select("project_id", normal_path(F.col("f.path")).alias("path")).distinct()
    return asked.join(current(spark, root).select("project_id", F.col("relative_path").alias("path"), "file_id", "status"), ["project_id", "path"])


@query(f"WITH {_STATE}, p AS (SELECT id, arg_max({{'v': parse_status}}, indexed_at).v AS parse_status FROM files GROUP BY id) SELECT id AS file_id, project_id FROM live JOIN p USING (id) WHERE parse_status IS NULL AND language IN ('typescript', 'javascript', 'python')")
def unparsed_files(spark, root):
    """Active files in a language that is parsed, without a parse status."""
    return live(spark, root).where(F.col("parse_status").isNull() & F.col("language").isin("typescript", "javascript", "python")).select("file_id", "project_id")


@query(f"WITH {_STATE} SELECT file_id, id AS symbol_id, row_number() OVER (PARTITION BY file_id ORDER BY line_start, id) AS place FROM (SELECT DISTINCT id, file_id, line_start FROM symbols) WHERE file_id IN (SELECT id FROM live)")
def file_outlines(spark, root):
    """Symbols of each active file by line."""
    rows = table(spark, root, "symbols").select("id", "file_id", "line_start").distinct().join(live(spark, root).select("file_id"), "file_id", "left_semi")
    order = Window.partitionBy("file_id").orderBy("line_start", "id")
    return rows.select("file_id", F.col("id").alias("symbol_id"), F.row_number().over(order).cast("long").alias("place"))


@query(f"WITH {_STATE} SELECT file_id, id AS import_id, row_number() OVER (PARTITION BY file_id ORDER BY line, id) AS place FROM (SELECT DISTINCT id, file_id, line FROM imports) WHERE file_id IN (SELECT id FROM live)")
def file_imports(spark, root):
    """Imports of each active file by line."""
    rows = table(spark, root, "imports").select("id", "file_id", "line").distinct().join(live(spark, root).select("file_id"), "file_id", "left_semi")
    order = Window.partitionBy("file_id").orderBy("line", "id")
    return rows.select("file_id", F.col("id").alias("import_id"), F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {_STATE}, s AS (SELECT id, min(qualified_name) AS enclosing FROM symbols GROUP BY id)
SELECT DISTINCT r.id AS reference_id, r.name, r.kind, r.line, l.relative_path, s.enclosing FROM symbol_references r JOIN live l ON l.id = r.file_id LEFT JOIN s ON s.id = r.from_symbol_id""")
def reference_sites(spark, root):
    """References in active files with the symbol around each, where it is known."""
    rows = table(spark, root, "symbol_references").select("id", "file_id", "name", "kind", "line", "from_symbol_id").distinct()
    around = table(spark, root, "symbols").groupBy(F.col("id").alias("from_symbol_id")).agg(F.min("qualified_name").alias("enclosing"))
    return rows.join(live(spark, root).select("file_id", "relative_path"), "file_id").join(around, "from_symbol_id", "left").select(F.col("id").alias("reference_id"), "name", "kind", "line", "relative_path", "enclosing")


@query(f"WITH {_STATE} SELECT DISTINCT r.project_id, r.name, l.relative_path, array_to_string(list_sort(list(DISTINCT r.line)), ',') AS lines FROM symbol_references r JOIN live l ON l.id = r.file_id GROUP BY ALL")
def reference_lines(spark, root):
    """Lines of each name in each file, in order."""
    rows = table(spark, root, "symbol_references").select("project_id", "file_id", "name", "line").distinct().join(live(spark, root).select("file_id", "relative_path"), "file_id")
    return rows.groupBy("project_id", "name", "relative_path").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("lines"))


@query(f"""WITH {_STATE}, d AS (UNPIVOT (SELECT file_id, {_DETECTED} FROM file_search) ON {', '.join(n for n, _ in T.SECRET_PATTERNS)} INTO NAME detector VALUE occurrences)
SELECT l.project_id, l.relative_path, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors FROM d JOIN live l ON l.id = d.file_id WHERE occurrences > 0 GROUP BY ALL""")
def finding_files(spark, root):
    """Detectors that find something in each active file."""
    found = table(spark, root, "file_search").select("file_id", F.map_keys(T.findings(F.col("content"))).alias("d")).where("size(d) > 0").select("file_id", F.explode("d").alias("detector"))
    return found.join(live(spark, root).select("file_id", "project_id", "relative_path"), "file_id").groupBy("project_id", "relative_path").agg(F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"))


@query(f"WITH {_STATE} SELECT project_id, relative_path, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path) AS place FROM (SELECT DISTINCT project_id, relative_path FROM live WHERE regexp_matches(relative_path, '(?:^|/)(?:index|main|app|server|cli)[^/]*\\.(?:ts|tsx|js|jsx|mjs|py)$'))) WHERE place <= 10")
def entry_candidates(spark, root):
    """The first ten files of each project whose names begin like those of entry points."""
    rows = live(spark, root).where(F.col("relative_path").rlike(r"(?:^|/)(?:index|main|app|server|cli)[^/]*\.(?:ts|tsx|js|jsx|mjs|py)$")).select("project_id", "relative_path").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("relative_path")).cast("long")).where("place <= 10")


@query(f"""WITH {_STATE}, c AS (SELECT DISTINCT ON (id) * FROM context_cache), f AS (SELECT id, project_id, unnest(files) AS f FROM c), p AS (SELECT id, project_id, regexp_replace(replace(f.path, '\\', '/'), '^\\./', '') AS path, f.hash AS hash FROM f WHERE f.path IS NOT NULL),
now AS (SELECT project_id, relative_path, max(hash) AS h FROM live GROUP BY ALL)
SELECT p.id, p.path, CASE WHEN h IS NULL THEN 'missing' ELSE 'stale' END AS what FROM p LEFT JOIN now ON now.project_id = p.project_id AND now.relative_path = p.path WHERE h IS NULL OR h IS DISTINCT FROM hash""")
def cache_differences(spark, root):
    """The paths of each cached context that are stale or missing."""
    return knowledge.cache_differences(table(spark, root, "context_cache").dropDuplicates(["id"]), live(spark, root))


@query(f"""WITH {_STATE}, r AS (SELECT DISTINCT id, project_id, regexp_replace(replace(f.path, '\\', '/'), '^\\./', '') AS path FROM (SELECT id, project_id, unnest(files) AS f FROM context_cache)) SELECT r.id AS memory_id, l.id AS file_id, l.relative_path FROM r JOIN live l ON l.project_id = r.project_id AND l.relative_path = r.path""")
def record_files(spark, root):
    """Active files that records name; the paths of cached contexts stand for those of records."""
    rows = table(spark, root, "context_cache").select(F.col("id").alias("memory_id"), "project_id", F.transform("files", lambda f: normal_path(f["path"])).alias("paths"))
    return stores.files_of_records(rows, live(spark, root))


@query(f"WITH {store_queries._RECORDS_SQL}, d AS (SELECT doc_id, max(annotator || '/' || subject) AS top FROM subject_labels GROUP BY ALL) SELECT memory_id, type, CASE WHEN type = 'DECISION' THEN regexp_replace(top, '^[^/]*/', '') END AS reason FROM records LEFT JOIN d ON doc_id = memory_id")
def record_decisions(spark, root):
    """Records with what is known of the decision, for decisions only."""
    none = F.array().cast("array<string>")
    made = table(spark, root, "subject_labels").select(F.col("doc_id").alias("memory_id"), F.col("annotator").alias("at"), F.col("subject").alias("seq"), F.col("subject").alias("reason"), none.alias("alternatives"), none.alias("affected"))
    return stores.with_decisions(store_queries._memories(spark, root), made).select("memory_id", "type", F.col("decision.reason").alias("reason"))


_LABELS_SQL = "CASE regexp_extract(lower(relative_path), '\\.([^./]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{T.LABELS.get(n, n[0].upper() + n[1:])}'" for e, n in T.LANGUAGES.items()) + " ELSE 'Other' END"


@query(f"WITH {_STATE} SELECT {_LABELS_SQL} AS language, count(*) AS files FROM live GROUP BY ALL")
def language_labels(spark, root):
    """Active files by the name of the language that their extension stands for."""
    return live(spark, root).groupBy(T.language_label(T.language_of(F.col("relative_path"))).alias("language")).agg(F.count("*").alias("files"))


@query(f"""WITH {_STATE}, f AS (SELECT project_id, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM live GROUP BY ALL), s AS (SELECT project_id, count(DISTINCT id) AS symbols FROM symbols WHERE file_id IN (SELECT id FROM live) GROUP BY ALL),
i AS (SELECT project_id, count(DISTINCT id) AS imports FROM imports WHERE file_id IN (SELECT id FROM live) GROUP BY ALL), c AS (SELECT project_id, count(DISTINCT id) AS contexts FROM context_cache GROUP BY ALL), a AS (SELECT project_id, count(DISTINCT id) AS events, epoch_us(max("at")) AS last_us FROM activity GROUP BY ALL)
SELECT p.id AS project_id, p.name, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, coalesce(symbols, 0) AS symbols, coalesce(imports, 0) AS imports, coalesce(contexts, 0) AS contexts, coalesce(events, 0) AS events, last_us
FROM projects p LEFT JOIN f ON f.project_id = p.id LEFT JOIN s ON s.project_id = p.id LEFT JOIN i ON i.project_id = p.id LEFT JOIN c ON c.project_id = p.id LEFT JOIN a ON a.project_id = p.id""")
def project_status(spark, root):
    """What there is of each project."""
    own = live(spark, root)
    keep = own.select("file_id")
    count = lambda name, column: table(spark, root, name).join(keep, "file_id", "left_semi").groupBy("project_id").agg(F.countDistinct("id").alias(column))
    activity = table(spark, root, "activity").groupBy("project_id").agg(F.countDistinct("id").alias("events"), F.max(store_queries.utc_micros(F.col("at"))).alias("last_us"))
    parts = [own.groupBy("project_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), count("symbols", "symbols"), count("imports", "imports"), table(spark, root, "context_cache").groupBy("project_id").agg(F.countDistinct("id").alias("contexts")), activity]
    return stores.status_bundle(table(spark, root, "projects").select(F.col("id").alias("project_id"), "name"), parts)
