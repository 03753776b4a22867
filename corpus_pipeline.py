"""Preparing a training corpus: five stages over ``documents``, each written as Parquet and read again.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last
return the columns they were given.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from postroom.llm import decontamination, jaccard_join, secret_scan, sequence_packing, toxicity
from postroom.llm.common import fold, table, tokenizer_path
from postroom.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the compression distances call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=fold("doc_id") != 2)
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group that links at 80 % of five-word shingles."""
    return jaccard_join.deduplicate(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 4096 tokens."""
    return sequence_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


ARROW_ROWS, ARROW_BYTES = 1000, "8m"


def in_small_batches(stage):
    """The stage with Arrow batches kept at ``ARROW_ROWS`` rows and ``ARROW_BYTES``, where the session says nothing else.

    Whole rows pass through Python in several stages; what JVM and workers hold of them stays with the executor.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, small in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
            setting = f"spark.sql.execution.arrow.{name}"
            if spark.sparkContext.getConf().get(setting) is None:
                spark.conf.set(setting, small)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, in_small_batches(stage))
    for name, stage in (
        ("toxicity", drop_toxic),
        ("near_copies", drop_near_copies),
        ("decontamination", drop_benchmark),
        ("secrets", redact_secrets),
        ("packing", pack_sequences),
    )
]

# Compression lengths and merges are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what lies between them is kept in the folder that the cluster shares."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
