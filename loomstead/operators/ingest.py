"""Incremental indexing: what changed between a snapshot and a scan, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, scan: DataFrame, *, complete: bool = True) -> DataFrame:
    """``(project_id, relative_path, change)``: added, updated, unchanged or deleted.

    ``before`` has ``(project_id, relative_path, hash, active)``, ``scan`` ``(project_id, relative_path, hash)``. A path that
    was deleted before and is back counts as updated. Only a complete scan deletes. One full outer join on the key.
    """
    old = before.select("project_id", "relative_path", F.col("hash").alias("old_hash"), F.col("active").alias("was_active"), F.lit(True).alias("known"))
    new = scan.select("project_id", "relative_path", F.col("hash").alias("new_hash"), F.lit(True).alias("found"))
    change = (
        F.when(F.col("known").isNull(), "added")
        .when(F.col("found").isNull(), F.when(F.col("was_active") & F.lit(complete), "deleted"))
        .when(~F.col("was_active") | ~F.col("old_hash").eqNullSafe(F.col("new_hash")), "updated").otherwise("unchanged")
    )
    return old.join(new, ["project_id", "relative_path"], "full_outer").select("project_id", "relative_path", change.alias("change")).where("change IS NOT NULL")


def upsert(before: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``before`` with the rows of the same keys replaced and new ones added."""
    return before.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def replace_derived(before: DataFrame, rows: DataFrame, changed: DataFrame, key: str = "file_id") -> DataFrame:
    """Derived rows after the files in ``changed`` were read again: theirs replaced, those of other files kept."""
    return before.join(changed.select(key).distinct(), key, "left_anti").unionByName(rows)


def soft_delete(before: DataFrame, missing: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """``before`` with the rows of missing keys marked deleted."""
    gone = missing.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return before.join(gone, keys, "left").withColumn(status, F.when("_gone", "deleted").otherwise(F.col(status))).drop("_gone")


def purge(before: DataFrame, status: str = "status") -> DataFrame:
    return before.where(~F.col(status).eqNullSafe(F.lit("deleted")))


def relink(imports: DataFrame, live: DataFrame) -> DataFrame:
    """``imports`` with ``resolved_file_id`` set to the active file at ``resolved_path``, else null."""
    target = live.groupBy("project_id", F.col("relative_path").alias("resolved_path")).agg(F.min("file_id").alias("_target"))
    return imports.join(target, ["project_id", "resolved_path"], "left").withColumn("resolved_file_id", F.col("_target")).drop("_target")


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """State from an event log: the row of each key that is last in ``order``, with a map-side combine."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")
