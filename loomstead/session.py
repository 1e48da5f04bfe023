"""Session defaults and the few helpers every operator shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "loomstead", **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` entries win over them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Tables of whole texts, which take far longer to work through than to read.
TEXTS = ("file_search", "documents")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a data directory.

    A table of texts that is read in fewer parts than there are cores is spread over them. That is so only while it is small (under one
    split a core); a larger one is never shuffled for this.
    """
    rows = spark.read.parquet(f"{root}/{name}.parquet")
    if name in TEXTS and rows.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        return rows.repartition(cores)
    return rows


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave ``spark.checkpoint.dir`` alone where the cluster names it; set a folder only for a local session.

    On a cluster without that setting this raises: a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir", ""):
        return
    if sc.getCheckpointDir():
        return
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomstead-checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared checkpoint folder (survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of steps that are over removed; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utc_micros(column: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less (or UTC) timestamp column, whatever the session's zone is."""
    return F.unix_micros(F.from_utc_timestamp(column.cast("timestamp"), F.current_timezone()))


def normal_path(column: Column) -> Column:
    r"""``\`` read as ``/`` and one leading ``./`` dropped."""
    return F.regexp_replace(F.translate(column, "\\", "/"), r"^\./", "")
