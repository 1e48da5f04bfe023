"""References to records that do not exist, per table and period.

Method: parent and child keys are tagged and unioned in long form ``(project, kind, key)``; one grouping per key,
with a map-side combine, tells whether a parent exists and since when. Keys without a parent flag, or whose parent came
after some child, are kept; their records are then listed and counted per table and month.

Scale: the grouping moves one combined row per key and task, so a key with a third of all rows costs nothing extra.
Records come back through a join on the kept keys only. A key with more than ``ROWS_PER_SALT`` records is repeated over as
many salts as it has such parts, and each of its records picks one by its id; these keys are few (never more than ``MOST_HOT``,
as the size of a part grows with the records beyond that) and are broadcast to the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import materialise, normal_path, utc_micros

ROWS_PER_SALT = 500_000
MOST_HOT = 20_000


def file_states(files: DataFrame) -> DataFrame:
    """Present state of each file of an upsert log: ``(file_id, project_id, relative_path, active, seen_us)``.

    The row with the latest ``indexed_at`` is the state, the earliest tells when the file was first seen. Rows without
    id are no file; a null ``indexed_at`` counts as the earliest possible, ties are broken by status, path and project.
    """
    state = F.struct(utc_micros(F.col("indexed_at")).alias("us"), "status", "relative_path", "project_id")
    return (
        files.where("id IS NOT NULL")
        .groupBy(F.col("id").alias("file_id"))
        .agg(F.max(state).alias("now"), F.min(utc_micros(F.col("indexed_at"))).alias("seen_us"))
        .select(
            "file_id", "now.project_id", F.col("now.relative_path").alias("relative_path"),
            F.coalesce(F.col("now.status") == "active", F.lit(False)).alias("active"), "seen_us",
        )
    )


def tagged_children(live: DataFrame, imports: DataFrame, references: DataFrame, cache: DataFrame) -> DataFrame:
    """Every reference as ``(project_id, kind, key, table_name, record_id, us)``; null keys are no reference."""
    own = live.select("file_id")
    path_import = (
        imports.where("resolved_path IS NOT NULL")
        .select("project_id", "file_id", normal_path(F.col("resolved_path")).alias("key"), F.col("id").cast("string").alias("record_id"), utc_micros(F.col("indexed_at")).alias("us"))
        .join(own, "file_id", "left_semi")
        .select("project_id", F.lit("path").alias("kind"), "key", F.lit("imports").alias("table_name"), "record_id", "us")
    )
    brought_in = (
        imports.where("is_external AND names IS NOT NULL")
        .select("file_id", F.explode("names").alias("name"))
        .where("name IS NOT NULL")
    )
    named = (
        references.where("name IS NOT NULL")
        .select("project_id", "file_id", "name", F.col("id").cast("string").alias("record_id"), utc_micros(F.col("indexed_at")).alias("us"))
        .join(own, "file_id", "left_semi")
        .join(brought_in, ["file_id", "name"], "left_anti")
        .select("project_id", F.lit("name").alias("kind"), F.col("name").alias("key"), F.lit("symbol_references").alias("table_name"), "record_id", "us")
    )
    cached = (
        cache.where("files IS NOT NULL")
        .select("project_id", F.col("id").alias("record_id"), utc_micros(F.col("created_at")).alias("us"), F.explode("files").alias("file"))
        .where("file.path IS NOT NULL")
        .select("project_id", F.lit("path").alias("kind"), normal_path(F.col("file.path")).alias("key"), F.lit("context_cache").alias("table_name"), "record_id", "us")
    )
    return path_import.unionByName(named).unionByName(cached)


def tagged_parents(live: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every existing path and name as ``(project_id, kind, key, seen_us)``."""
    paths = live.where("relative_path IS NOT NULL").select("project_id", F.lit("path").alias("kind"), F.col("relative_path").alias("key"), "seen_us")
    names = (
        symbols.where("name IS NOT NULL")
        .select("project_id", "file_id", "name")
        .join(live.select("file_id", "seen_us"), "file_id")
        .select("project_id", F.lit("name").alias("kind"), F.col("name").alias("key"), "seen_us")
    )
    return paths.unionByName(names)


def orphan_keys(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Keys that lack a parent, or whose parent came after a child: ``(project_id, kind, key, seen_us, n)``.

    ``seen_us`` is null where there is no parent at all; ``n`` counts the children. A child without a time counts as older than any parent.
    """
    long = parents.select("project_id", "kind", "key", "seen_us", F.lit(None).cast("long").alias("us")).unionByName(
        children.select("project_id", "kind", "key", F.lit(None).cast("long").alias("seen_us"), F.coalesce("us", F.lit(-(1 << 62))).alias("us"))
    )
    return (
        long.groupBy("project_id", "kind", "key")
        .agg(F.min("seen_us").alias("seen_us"), F.min("us").alias("first_us"), F.count("us").alias("n"))
        .where("first_us IS NOT NULL AND (seen_us IS NULL OR seen_us > first_us)")
        .select("project_id", "kind", "key", "seen_us", "n")
    )


def orphan_references(files: DataFrame, symbols: DataFrame, imports: DataFrame, references: DataFrame, cache: DataFrame, *, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """References that point nowhere: ``(table_name, record_id, ref_key, us)``, one row per distinct triple and time.

    Imports and references count only if their own file is active now. A path exists if an active file of the project
    has it and was seen no later than the record; a name exists if a symbol in such a file has it, or if an external
    import of the same file lists it. Null paths and names are no case, null projects match nothing, repeated rows
    collapse, empty tables give an empty result, and other columns are not read.
    """
    live = file_states(files).where("active").select("file_id", "project_id", "relative_path", F.coalesce("seen_us", F.lit(-(1 << 62))).alias("seen_us"))
    children = tagged_children(live, imports, references, cache)
    keys = materialise(orphan_keys(tagged_parents(live, symbols), children))
    part = max(rows_per_salt, (keys.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {part}"))))
    hot = F.broadcast(keys.where(F.col("n") > part).select("project_id", "kind", "key", F.expr(f"(n - 1) div {part} + 1").alias("salts")))
    on_key = lambda a, b: F.col(f"{a}.project_id").eqNullSafe(F.col(f"{b}.project_id")) & (F.col(f"{a}.kind") == F.col(f"{b}.kind")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))
    salts = F.coalesce("h.salts", F.lit(1).cast("long"))
    child = children.alias("x").join(hot.alias("h"), on_key("x", "h"), "left").select("x.*", F.pmod(F.xxhash64("x.record_id"), salts).alias("salt"))
    same = on_key("c", "k") & (F.col("c.salt") == F.col("k.salt"))
    return (
        child.alias("c").join(salted.alias("k"), same)
        .where("k.seen_us IS NULL OR c.us IS NULL OR k.seen_us > c.us")
        .select("c.table_name", "c.record_id", F.col("c.key").alias("ref_key"), "c.us")
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table and month of the record: ``(table_name, month, n_references, n_keys)``.

    Records without a time are reported under a null month.
    """
    return (
        orphans.withColumn("month", F.date_format(F.timestamp_micros("us"), "yyyy-MM"))
        .groupBy("table_name", "month")
        .agg(F.count("*").alias("n_references"), F.countDistinct("ref_key").alias("n_keys"))
    )
