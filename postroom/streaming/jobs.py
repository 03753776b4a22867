"""Structured Streaming forms of the incremental jobs.

Each job is a DataFrame transformation plus a sink; ``drain`` runs one with
``availableNow`` and returns what it wrote. Output, checkpoints and state live in
the shared folder of the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.operators.corpus import chunk_documents, clean_documents
from postroom.session import broadcast_if_small, cut_lineage, shared_folder
from postroom.sources.tables import replace_by_bucket

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, name: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files of one table in ``folder``: files by its name, or those in folders by its name."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder.rstrip('/')}/{name}*.parquet")


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on ``column``; zone-less times are read as session time."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, label: str, mode: str = "append", key: Sequence[str] = ()) -> DataFrame:
    """Run a stream over everything available and read its output back.

    Append writes straight to files. Complete and update results replace or follow
    one another per batch; the newest batch of each key is the answer.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, label)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(f"{folder}/rows")
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(
            f"{folder}/rows/batch={number}"
        )

    query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    written = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    if mode == "complete":
        last = written.agg(F.max("_batch").alias("_batch"))
        return written.join(last, "_batch", "left_semi").drop("_batch")
    rest = [name for name in stream.columns if name not in key]
    newest = written.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return newest.select(*key, *[F.col("_row")[name].alias(name) for name in rest])


def drain_runs(arrivals: Iterable[DataFrame], label: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run an append-mode job once per arrival, as a nightly job does, and return all it wrote.

    An arrival's rows are appended to the job's source folder; the job then starts from its checkpoint, with the state and
    the watermark that the run before left, takes what is new and ends.
    """
    folder = rows = None
    for arrived in arrivals:
        spark = arrived.sparkSession
        folder = folder or new_folder(spark, label)
        arrived.write.mode("append").parquet(f"{folder}/source")
        stream = job(spark.readStream.schema(arrived.schema).parquet(f"{folder}/source"))
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
        writer.format("parquet").outputMode("append").start(f"{folder}/rows").awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    if rows is None:
        raise ValueError("no arrivals")
    return rows


def new_messages(
    stream: DataFrame, key: Sequence[str], event_time: str, delay: str, triage: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Incremental triage: drop repeated ids inside the watermark, then run the row-wise chain."""
    return triage(with_event_time(stream, event_time, delay).dropDuplicatesWithinWatermark(list(key)))


def import_messages(
    stream: DataFrame, path: str, *, key: Sequence[str], order: Sequence[str], chain: Callable[[DataFrame], DataFrame], checkpoint: str
):
    """Incremental import as a job: per micro-batch, the messages whose ids are not stored yet go through ``chain`` and are stored.

    A repeated id counts once, whenever it comes again: inside a batch its first row by ``order`` stays, and ids that an
    earlier batch stored are left out. There is no state and no watermark, as the table itself knows the ids. Only the
    batch's own ids are looked up, in a scan of the stored key columns, with the batch broadcast if it is small.

    Each batch overwrites its own partition ``batch=<number>`` and looks only at those before it, so that a batch that runs
    again after a failure writes the same rows. A reader must not take partitions that have no success mark.
    """
    spark = stream.sparkSession
    ids = ", ".join(f"`{name}` {kind}" for name, kind in stream.dtypes if name in key)

    def apply(batch: DataFrame, number: int) -> None:
        rest = [name for name in batch.columns if name not in key]
        first = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
        arrived = cut_lineage(batch.groupBy(*key).agg(first.alias("_row")).select(*key, "_row.*"))
        if number:
            earlier = [f"{path}/batch={n}" for n in range(number) if folder_exists(spark, f"{path}/batch={n}")]
            if earlier:
                stored = spark.read.schema(ids).parquet(*earlier)
                known = stored.join(broadcast_if_small(arrived.select(*key)), list(key), "left_semi").distinct()
                arrived = arrived.join(known, list(key), "left_anti")
        chain(arrived).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def imported(spark: SparkSession, path: str) -> DataFrame:
    """All rows that :func:`import_messages` stored, without the batch number."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Has a job written this folder to its end?"""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def daily_usage(stream: DataFrame, event_time: str, delay: str, by: Sequence[str]) -> DataFrame:
    """Usage and cost per day. In append or update mode rows later than the watermark are dropped and closed
    days leave the state; complete mode keeps every day and drops nothing."""
    return (
        with_event_time(stream, event_time, delay)
        .groupBy(F.window(event_time, "1 day").alias("_day"), *by)
        .agg(
            F.count("*").alias("messages"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
        )
        .select(F.to_date("_day.start").alias("day"), *by, "messages", "input_tokens", "output_tokens")
    )


def upsert_corpus(
    stream: DataFrame, path: str, *, key: str, text: str, title: str, source: str, checkpoint: str, buckets: int = 256,
    version: Sequence[str] = (),
):
    """Per micro-batch: clean, chunk and replace the chunks of the documents that arrived.

    A document that comes several times in a batch counts once, with its greatest ``version`` columns
    (then text). One that yields no chunk any more loses its old ones.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != key]
        order = F.struct(*version, text, *[c for c in rest if c not in (*version, text)])
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")
        newest = cut_lineage(newest)
        chunks = chunk_documents(clean_documents(newest, text), key=key, text="clean_text", title=title, source=source)
        replace_by_bucket(chunks, path, key, buckets, arrived=newest.select(key))

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def entity_state(stream: DataFrame, key: str, moment: str, sequence: str, action: str, statuses: dict[str, str], key_type: str = "bigint") -> DataFrame:
    """Ticket status per key as a stateful operator: (key, status, events).

    The state is the newest closing action and the newest ``open`` with their
    (time, sequence) marks. Keeping only maxima makes it independent of the order
    inside a batch, so the handler reads a hot key piece by piece and never sorts
    or buffers it.
    """
    from postroom.streaming.state import ticket_processor

    rows = stream.select(
        F.col(key).alias("entity"),
        F.unix_micros(F.col(moment).cast("timestamp")).alias("at"),
        F.col(sequence).cast("long").alias("seq"),
        F.col(action).alias("action"),
    )
    state = rows.groupBy("entity").transformWithStateInPandas(
        statefulProcessor=ticket_processor(statuses),
        outputStructType=f"entity {key_type}, status string, events bigint",
        outputMode="Update",
        timeMode="None",
    )
    return state.withColumnRenamed("entity", key)
