"""Dependencies between files: edges, degrees, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import looks_like_test
from loomstead.session import materialise


UNBROKEN = 3


def import_edges(imports: DataFrame, live: DataFrame) -> DataFrame:
    """``(project_id, source, target, kind)``: resolved imports between files that are active, each once."""
    own = live.select("file_id")
    return (
        imports.where("resolved_file_id IS NOT NULL")
        .select("project_id", F.col("file_id").alias("source"), F.col("resolved_file_id").alias("target"), "kind").distinct()
        .join(own.withColumnRenamed("file_id", "source"), "source", "left_semi")
        .join(own.withColumnRenamed("file_id", "target"), "target", "left_semi")
        .select("project_id", "source", "target", "kind")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``(file_id, dependencies, dependents)`` of every file with an edge."""
    out = edges.select(F.col("source").alias("file_id"), F.col("target").alias("out"), F.lit(None).cast("long").alias("into"))
    into = edges.select(F.col("target").alias("file_id"), F.lit(None).cast("long").alias("out"), F.col("source").alias("into"))
    both = out.unionByName(into).distinct()
    return both.groupBy("file_id").agg(F.count("out").alias("dependencies"), F.count("into").alias("dependents"))


def reach(edges: DataFrame, origins: DataFrame, depth: int = 3) -> DataFrame:
    """``(origin, node, depth)``: what depends on each origin within ``depth`` (1 to 10) hops, at its least depth.

    A bounded breadth-first search over all origins at once: each hop is one join and one anti-join with what was
    seen; from the third on it is checkpointed, so that the plan does not grow. Origins themselves have no row; cycles end.
    """
    depth = max(1, min(10, depth))
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("following")).where("node <> following").distinct()
    front = origins.select(F.col("origin"), F.col("origin").alias("node")).distinct()
    seen = front.withColumn("depth", F.lit(0))
    for hop in range(1, depth + 1):
        front = (
            front.join(back, "node").select("origin", F.col("following").alias("node")).distinct()
            .join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        )
        if hop >= UNBROKEN:  # the plan of the first hops is short enough to stay whole
            front = materialise(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front.withColumn("depth", F.lit(hop)))
    return seen.where("depth > 0")


def impact(edges: DataFrame, live: DataFrame, origins: DataFrame, *, depth: int = 3) -> DataFrame:
    """``(origin, relative_path, depth, is_test)`` of everything that a change of the origins reaches."""
    return reach(edges, origins, depth).join(live.select(F.col("file_id").alias("node"), "relative_path"), "node").select(
        "origin", "relative_path", "depth", looks_like_test(F.col("relative_path")).alias("is_test")
    )


def project_map(live: DataFrame, folders: int = 40) -> DataFrame:
    """``(project_id, directory, files, languages, place, truncated)``: the ``folders`` fullest folders of each project, two levels deep; ``truncated`` tells whether it has more."""
    parts = F.split("relative_path", "/")
    folder = F.when(F.size(parts) < 2, ".").otherwise(F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1)), "/"))
    rows = live.groupBy("project_id", folder.alias("directory")).agg(F.count("*").alias("files"), F.array_sort(F.collect_set(F.coalesce("language", F.lit("other")))).alias("languages"))
    whole = Window.partitionBy("project_id")
    placed = rows.withColumn("place", F.row_number().over(whole.orderBy(F.col("files").desc(), "directory"))).withColumn("truncated", F.count("*").over(whole) > folders)
    return placed.where(F.col("place") <= folders)
