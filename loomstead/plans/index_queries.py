"""Queries of the kept search index, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import postings
from loomstead.plans import store_queries
from loomstead.plans.reference_queries import _bm25_sql, _SPLIT, _STATE, live
from loomstead.session import materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
ASKS = ["fix payment verification running twice", "dispatch the order record", "validate cart total and invoice", "symbol table rebuild", "café menu"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


def _asks(spark, project: str = "all"):
    return spark.createDataFrame([(k, project, text) for k, text in enumerate(ASKS)], "request_id int, project_id string, task string")


def _found(index, spark, key: str):
    return postings.search(index, _asks(spark)).select("request_id", F.col("key").alias(key), "relevance")


def _sql(source: str, key: str, columns: dict[str, float]) -> str:
    each = [f"SELECT {k} AS request_id, * FROM ({_bm25_sql(source, key, columns, text, 25).replace('regexp_extract_all(lower(', 'regexp_extract_all(nfc_plain(')})" for k, text in enumerate(ASKS)]
    return " UNION ALL ".join(each)


def _with_plain(sql: str) -> str:
    """The bm25 statements with marks taken off the letters; a text is lowered and then bared."""
    out, name = "", "nfc_plain("
    while (at := sql.find(name)) >= 0:
        depth, end = 1, at + len(name)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[:at] + f"strip_accents(lower({sql[at + len(name) : end - 1]}))"
        sql = sql[end:]
    return out + sql


FILES = {"path": 8, "content": 1, "identifiers": 4}
SYMBOLS = {"name": 10, "qualified_name": 6, "signature": 1, "relative_path": 2}
RECORDS = {"title": 6, "content": 2, "tags": 3}


@query(_with_plain(_sql("SELECT DISTINCT file_id, path, content, identifiers FROM file_search", "file_id", FILES)))
def search_index_files(spark, root):
    """Several requests over the index of all files in one plan."""
    docs = table(spark, root, "file_search").withColumn("project_id", F.lit("all"))
    return _found(tuple(map(materialise, postings.build(docs, FILES, key="file_id"))), spark, "file_id")


@query(_with_plain(_sql(f"WITH {_STATE} SELECT DISTINCT s.id AS symbol_id, {_SPLIT.format('s.name')} AS name, {_SPLIT.format('s.qualified_name')} AS qualified_name, s.signature, l.relative_path FROM symbols s JOIN live l ON l.id = s.file_id", "symbol_id", SYMBOLS)))
def search_index_symbols(spark, root):
    """Several requests over the index of the symbols of active files."""
    own = live(spark, root).select("file_id", "relative_path")
    docs = table(spark, root, "symbols").select("id", "file_id", "name", "qualified_name", "signature").dropDuplicates(["id"]).join(own, "file_id").select(
        F.lit("all").alias("project_id"), "id", T.split_identifier(F.col("name")).alias("name"), T.split_identifier(F.col("qualified_name")).alias("qualified_name"), "signature", "relative_path"
    )
    return _found(tuple(map(materialise, postings.build(docs, SYMBOLS))), spark, "symbol_id")


@query(_with_plain(_sql("SELECT doc_id, CASE WHEN kind = 'issue' THEN NULL WHEN kind IN ('memory', 'task') THEN text ELSE lang END AS text FROM documents WHERE kind IS DISTINCT FROM 'issue'", "doc_id", {"text": 1.0})))
def search_index_updated(spark, root):
    """An index of languages after memories and tasks got their texts and issues went."""
    docs = table(spark, root, "documents").select("doc_id", "kind", "text", "lang").withColumn("project_id", F.lit("all"))
    first = postings.build(docs.select("project_id", "doc_id", F.col("lang").alias("text")), {"text": 1.0}, key="doc_id")
    changed = docs.where("kind IN ('memory', 'task', 'issue')").select("project_id", "doc_id", "text", (F.col("kind") == "issue").alias("gone"))
    return _found(tuple(map(materialise, postings.update(first, changed, {"text": 1.0}, key="doc_id"))), spark, "doc_id")


@query(_with_plain(_sql(f"WITH {store_queries._RECORDS_SQL} SELECT memory_id, substr(text, 1, 60) AS title, text AS content, lang AS tags FROM records", "memory_id", RECORDS)))
def search_index_records(spark, root):
    """Several requests over the index of knowledge records."""
    docs = store_queries._memories(spark, root).select(F.lit("all").alias("project_id"), "memory_id", "title", "content", F.array_join("tags", " ").alias("tags"))
    return _found(tuple(map(materialise, postings.build(docs, RECORDS, key="memory_id"))), spark, "memory_id")


@query(_with_plain(_sql("SELECT o_orderkey AS task_id, o_orderpriority || ' menu ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'validate cart' ELSE 'dispatch order' END AS description, o_orderstatus AS tags FROM orders", "task_id", {"title": 6, "description": 2, "tags": 3})))
def search_index_tasks(spark, root):
    """Several requests over the index of tasks."""
    docs = table(spark, root, "orders").select(
        F.lit("all").alias("project_id"), F.col("o_orderkey").alias("task_id"), F.concat("o_orderpriority", F.lit(" menu "), "o_orderkey").alias("title"), F.when(F.col("o_orderstatus") == "F", "validate cart").otherwise("dispatch order").alias("description"), F.col("o_orderstatus").alias("tags")
    )
    return _found(tuple(map(materialise, postings.build(docs, {"title": 6, "description": 2, "tags": 3}, key="task_id"))), spark, "task_id")
