"""Session defaults and the few helpers that depend on the running cluster."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app_name: str = "postroom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution; size partitions by bytes, not by a fixed count."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder of its own; on a
    cluster the setting is required, since executors would not see such a folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="postroom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and go on from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """Size in the optimizer's statistics; unknown sources report a very large one."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint below a checked size; beyond it the join stays with the planner."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Give an input of a few files to all cores; a large input is left as it is read.

    Only for work that is heavy per row. The scan has at least one partition per
    core at scale, and then nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def visible(df: DataFrame) -> DataFrame:
    """``df``, after telling Python workers where this package lies (they need not start in its folder)."""
    root = str(Path(__file__).resolve().parents[1])
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)
    return df
