"""Scans of source trees, and the ignore rules they honour."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.text import language_of, skip_reason


def glob_pattern(rule: str) -> str:
    """Regular expression of one ignore rule: ``*`` and ``?`` stay within a folder, ``**`` does not; a slash anchors."""
    only_folders = rule.endswith("/")
    body = rule.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
            i += 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_folders else "(?:/|$)")


def parse_rules(text: str) -> list[tuple[bool, str]]:
    """``(ignores, pattern)`` of each line of an ignore file, in order."""
    found = []
    for line in text.splitlines():
        line = line.rstrip()
        if line and not line.startswith("#"):
            found.append((not line.startswith("!"), glob_pattern(line.removeprefix("!"))))
    return found


def is_ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last matching rule ignores the path."""
    verdict = F.lit(False)
    for ignores, pattern in rules:
        verdict = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(verdict)
    return verdict


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(relative_path, size, modified_at)`` of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    local = F.regexp_replace("path", r"^file:/*", "/")
    return files.select(F.regexp_replace(local, "^" + re.escape(root.rstrip("/")) + "/", "").alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def read_tree(spark: SparkSession, root: str, *, rules: list[tuple[bool, str]] = (), max_bytes: int = 1 << 20) -> DataFrame:
    """``(relative_path, language, size, hash, modified_at, content)`` of the files a scan keeps."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    local = F.regexp_replace("path", r"^file:/*", "/")
    rows = files.withColumn("relative_path", F.regexp_replace(local, "^" + re.escape(root.rstrip("/")) + "/", ""))
    kept = rows.where(skip_reason(F.col("relative_path"), F.col("length"), max_bytes).isNull() & ~is_ignored(F.col("relative_path"), list(rules)))
    return kept.select(
        "relative_path", language_of(F.col("relative_path")).alias("language"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"),
        F.col("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("content"),
    )


def skip_counts(listing: DataFrame, *, rules: list[tuple[bool, str]] = (), max_bytes: int = 1 << 20) -> DataFrame:
    """Files per reason for which a scan leaves them out, ``kept`` for the rest."""
    reason = F.when(is_ignored(F.col("relative_path"), list(rules)), "ignored")
    first = skip_reason(F.col("relative_path"), F.col("size"), max_bytes)
    order = F.when(first == "sensitive", first).when(reason.isNotNull(), reason).otherwise(first)
    return listing.groupBy(F.coalesce(order, F.lit("kept")).alias("reason")).agg(F.count("*").alias("files"))


def walk(spark: SparkSession, root: str, *, follow_links: bool = False, rules: list[tuple[bool, str]] = ()) -> DataFrame:
    """``(relative_path, size, modified_ms)`` below a local folder, ignored folders not entered; links only with ``follow_links``, no folder twice. Runs on the driver."""
    compiled = [(ignores, re.compile(pattern)) for ignores, pattern in rules]

    def ignored(path: str) -> bool:
        verdict = False
        for ignores, pattern in compiled:
            verdict = ignores if pattern.search(path) else verdict
        return verdict

    rows, seen = [], set()
    for at, folders, names in os.walk(root, followlinks=follow_links):
        real = os.path.realpath(at)
        if real in seen:
            folders.clear()
            continue
        seen.add(real)
        inside = lambda name: os.path.relpath(os.path.join(at, name), root).replace(os.sep, "/")  # noqa: E731, B023
        folders[:] = sorted(f for f in folders if not ignored(inside(f) + "/"))
        for name in names:
            full = os.path.join(at, name)
            if os.path.isfile(full) and (follow_links or not os.path.islink(full)):
                told = os.stat(full)
                rows.append((inside(name), told.st_size, int(told.st_mtime * 1000)))
    return spark.createDataFrame(rows, "relative_path string, size long, modified_ms long")


def scan(listing: DataFrame, *, rules: list[tuple[bool, str]] = (), max_bytes: int = 1 << 20, max_files: int | None = None) -> DataFrame:
    """``listing`` with ``reason``, why a scan leaves a file out; null for the files it keeps.

    Checks in order: sensitive, ignored by a rule or a folder, binary, too large. Of the rest the first ``max_files`` by path are kept and the others have the reason ``limit``.
    """
    first = skip_reason(F.col("relative_path"), F.col("size"), max_bytes)
    reason = F.when(first == "sensitive", first).when(is_ignored(F.col("relative_path"), list(rules)), "ignored").otherwise(first)
    rows = listing.withColumn("reason", reason)
    if max_files is None:
        return rows
    within = rows.where("reason IS NULL").select("relative_path").orderBy("relative_path").limit(max_files).withColumn("_within", F.lit(True))
    return rows.join(within, "relative_path", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_within").isNull(), "limit"))).drop("_within")


def scan_report(scanned: DataFrame) -> DataFrame:
    """One row ``(kept, bytes, skipped, truncated)``: files kept, their size, a map of the others by reason, and whether a limit was met."""
    by_reason = scanned.groupBy("reason").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    return by_reason.agg(
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("b"))), F.lit(0)).alias("bytes"),
        F.map_from_entries(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))).alias("skipped"), F.coalesce(F.bool_or(F.col("reason") == "limit"), F.lit(False)).alias("truncated"),
    )
