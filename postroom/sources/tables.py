"""Table sinks and schema evolution over Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def evolve(old: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add missing columns with a default; fill gaps in those that exist."""
    return old.withColumns(
        {name: F.coalesce(F.col(name), value) if name in old.columns else value for name, value in defaults.items()}
    )


def audit_rows(rows: DataFrame, *, scope: str, action: str, title: Column, summary: Column, detail: Sequence[str], at: Column) -> DataFrame:
    """Audit events with the listed columns as a JSON detail."""
    return rows.select(
        F.lit(scope).alias("scope"),
        F.lit(action).alias("action"),
        title.alias("title"),
        summary.alias("summary"),
        F.to_json(F.struct(*detail)).alias("detail"),
        at.alias("created_at"),
    )


def append_audit(events: DataFrame, path: str) -> None:
    """Append-only log, partitioned by scope so that purges by scope touch their own files."""
    events.write.mode("append").partitionBy("scope").parquet(path)


def replace_by_bucket(rows: DataFrame, path: str, key: str, buckets: int = 256, arrived: DataFrame | None = None) -> None:
    """Replace all rows of the parents in ``arrived``; only their buckets are read and rewritten.

    ``arrived`` holds the parents' keys (default: those of ``rows``). A parent that arrives without
    rows loses its old ones. Stored rows of other parents are kept. The bucket count of a table is
    fixed when it is created; later calls keep it. The new content goes to a fresh folder first, so a
    lost executor never reads a file that the same job is replacing. A bucket is written by several
    tasks, one per salt.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    keys = (rows if arrived is None else arrived).select(key).distinct()
    staged = f"{path.rstrip('/')}_staged/{uuid.uuid4().hex}"
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - only a missing table may be created
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        stored = None
    result = rows.withColumn("bucket", bucket)
    if stored is not None:
        touched = [r["bucket"] for r in keys.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
        kept = stored.filter(F.col("bucket").isin(touched)).join(keys, key, "left_anti")
        result = kept.select(*rows.columns, "bucket").unionByName(result)
    salt = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(4))
    result.repartition("bucket", salt).write.mode("overwrite").parquet(staged)
    ready = spark.read.parquet(staged)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if stored is not None:
        emptied = sorted(set(touched) - {r["bucket"] for r in ready.select("bucket").distinct().collect()})
        for number in emptied:  # dynamic overwrite leaves partitions without new rows as they are
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/bucket={number}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """Evaluation results as JSON, one folder per section."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
