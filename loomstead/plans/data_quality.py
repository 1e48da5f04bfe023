"""Queries of the core data-quality operators (orphan references, sessions) and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstead.operators.orphans import orphan_references, orphan_report
from loomstead.operators.sessions import sessionize
from loomstead.session import table


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    names = ("files", "symbols", "imports", "symbol_references", "context_cache")
    return orphan_references(*(table(spark, root, name) for name in names))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("table_name", "record_id", "ref_key").distinct()


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(_orphans(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return sessionize(table(spark, root, "activity"))


_ORPHANS = r"""
WITH state AS (
  SELECT id, arg_max(project_id, indexed_at) AS project_id, arg_max(relative_path, indexed_at) AS relative_path,
         arg_max(status, indexed_at) AS status, min(indexed_at) AS seen
  FROM files GROUP BY id),
live AS (SELECT * FROM state WHERE status = 'active'),
refs AS (
  SELECT 'imports' AS table_name, CAST(i.id AS VARCHAR) AS record_id, i.project_id, 'path' AS kind,
         regexp_replace(replace(i.resolved_path, '\', '/'), '^\./', '') AS ref_key, i.indexed_at AS moment
  FROM imports i WHERE i.resolved_path IS NOT NULL AND i.file_id IN (SELECT id FROM live)
  UNION ALL
  SELECT 'context_cache', c.id, c.project_id, 'path', regexp_replace(replace(c.f.path, '\', '/'), '^\./', ''), c.created_at
  FROM (SELECT id, project_id, created_at, unnest(files) AS f FROM context_cache) c WHERE c.f.path IS NOT NULL
  UNION ALL
  SELECT 'symbol_references', CAST(r.id AS VARCHAR), r.project_id, 'name', r.name, r.indexed_at
  FROM symbol_references r
  WHERE r.name IS NOT NULL AND r.file_id IN (SELECT id FROM live)
    AND NOT EXISTS (SELECT 1 FROM (SELECT file_id, unnest(names) AS name FROM imports WHERE is_external) e
                    WHERE e.file_id = r.file_id AND e.name = r.name)),
parents AS (
  SELECT project_id, 'path' AS kind, relative_path AS ref_key, min(seen) AS seen FROM live GROUP BY ALL
  UNION ALL
  SELECT s.project_id, 'name', s.name, min(l.seen) FROM symbols s JOIN live l ON l.id = s.file_id GROUP BY ALL),
orphans AS (
  SELECT DISTINCT r.table_name, r.record_id, r.ref_key, r.moment
  FROM refs r LEFT JOIN parents p ON p.project_id = r.project_id AND p.kind = r.kind AND p.ref_key = r.ref_key
  WHERE p.seen IS NULL OR p.seen > r.moment)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found}

SQL = {
    "p2_found": _ORPHANS + "SELECT DISTINCT table_name, record_id, ref_key FROM orphans",
    "p2_report": _ORPHANS + """
SELECT table_name, strftime(moment, '%Y-%m') AS month, count(*) AS n_references, count(DISTINCT ref_key) AS n_keys
FROM orphans GROUP BY ALL""",
    "p4_found": """
WITH once AS (
  SELECT id, min("at") AS moment, arg_min(lower(trim(agent)), "at") AS agent, arg_min(project_id, "at") AS project_id
  FROM activity WHERE "at" IS NOT NULL AND agent IS NOT NULL AND project_id IS NOT NULL GROUP BY id),
flagged AS (
  SELECT *, CASE WHEN moment - lag(moment) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM once WINDOW w AS (PARTITION BY agent, project_id ORDER BY moment, id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY agent, project_id ORDER BY moment, id) AS n FROM flagged)
SELECT agent, project_id, epoch_us(min(moment)) AS start_us, epoch_us(max(moment)) AS end_us, count(*) AS n_events
FROM numbered GROUP BY agent, project_id, n""",
}
