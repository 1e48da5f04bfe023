"""Health of an index as data-quality findings: what is wrong, in which project, how often."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators import ingest


def check(files: DataFrame, symbols: DataFrame, imports: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """``(project_id, problem, rows)`` of every check that finds something.

    Duplicate active paths, symbols and imports of files that are gone, resolved targets that are gone, files without
    a hash, and index runs that never finished. ``files`` is the present state ``(file_id, project_id, relative_path, hash, status)``.
    """
    live = files.where("status = 'active'")
    own = live.select("file_id")
    count = lambda rows, name: rows.groupBy("project_id").agg(F.count("*").alias("rows")).select("project_id", F.lit(name).alias("problem"), "rows")
    doubled = live.groupBy("project_id", "relative_path").agg(F.count("*").alias("n")).where("n > 1")
    found = [
        count(doubled, "duplicate_path"),
        count(live.where("hash IS NULL OR hash = ''"), "missing_hash"),
        count(symbols.join(own, "file_id", "left_anti"), "symbols_of_missing_file"),
        count(imports.join(own, "file_id", "left_anti"), "imports_of_missing_file"),
        count(imports.where("resolved_file_id IS NOT NULL").join(own.withColumnRenamed("file_id", "resolved_file_id"), "resolved_file_id", "left_anti"), "unlinked_target"),
    ]
    if runs is not None:
        found.append(count(runs.where("status = 'running'"), "unfinished_run"))
    return reduce(DataFrame.unionByName, found)


def decide(permission: Column) -> Column:
    """Whether a call may go ahead: reading, writing and executing may, destroying asks first, anything else may not."""
    return F.when(permission.isin("READ", "WRITE", "EXECUTE"), "allow").when(permission == "DESTRUCTIVE", "confirm").otherwise("deny")


def repair(files: DataFrame, symbols: DataFrame, imports: DataFrame, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without what :func:`check` finds and can be mended from the files as they are.

    Of active files at one path the one with the greatest id stays, the others are deleted; derived rows of files that are gone go, imports are linked anew and
    runs that never finished are abandoned. Files without a hash are left for the next scan.
    """
    same = files.where("status = 'active'").groupBy("project_id", "relative_path").agg(F.max("file_id").alias("_kept"))
    marked = files.join(same, ["project_id", "relative_path"], "left")
    status = F.when((F.col("status") == "active") & (F.col("file_id") != F.col("_kept")), "deleted").otherwise(F.col("status"))
    mended = marked.withColumn("status", status).select(*files.columns)
    own = mended.where("status = 'active'")
    keys = own.select("file_id")
    found = {"files": mended, "symbols": symbols.join(keys, "file_id", "left_semi"), "imports": ingest.relink(imports.join(keys, "file_id", "left_semi"), own)}
    if runs is not None:
        found["runs"] = runs.withColumn("status", F.when(F.col("status") == "running", "abandoned").otherwise(F.col("status")))
    return found
