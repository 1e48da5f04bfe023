"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstead.llm import credentials, handwritten, packing, subjects, syntax, tokens
from loomstead.session import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return handwritten.not_by_hand(table(spark, root, "file_search"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return credentials.credential_lines(table(spark, root, "file_search"))


def p3_redacted(spark: SparkSession, root: str) -> DataFrame:
    return credentials.scan(table(spark, root, "file_search"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return syntax.invalid_files(table(spark, root, "file_search"))


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    return syntax.syntax_rates(syntax.syntax_report(table(spark, root, "file_search")))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode(table(spark, root, "documents"))


def p7_windows(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents"), table(spark, root, "pack_targets"))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill(p7_windows(spark, root), table(spark, root, "pack_targets"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    docs, labels, areas = (table(spark, root, name) for name in ("documents", "subject_labels", "subjects"))
    return subjects.document_subjects(docs, labels, areas).select("doc_id", "subject")


def p8_composition(spark: SparkSession, root: str) -> DataFrame:
    docs, labels, areas = (table(spark, root, name) for name in ("documents", "subject_labels", "subjects"))
    return subjects.composition(subjects.document_subjects(docs, labels, areas))


QUERIES = {"p1_found": p1_found, "p8_found": p8_found, "p8_composition": p8_composition, "p3_found": p3_found, "p3_redacted": p3_redacted, "p5_found": p5_found, "p5_rates": p5_rates, "p6_ids": p6_ids, "p7_windows": p7_windows, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
