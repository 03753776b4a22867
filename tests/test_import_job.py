"""The import job over several micro-batches: repeats, late repeats, a batch that runs again."""

from __future__ import annotations

from collections import Counter

import pytest

from postroom.operators import triage
from postroom.streaming import jobs

SCHEMA = "provider string, message_id long, at timestamp, subject string, body string, sender string"


def chain(batch):
    return triage.triage(batch, subject="subject", body="body", sender="sender")


def rows_of(number):
    """Batch ``number``: own messages, one that came in batch 0, and a repeat inside the batch."""
    day = f"2024-0{number + 1}-15 10:00:0"
    own = [("imap", 10 * number + i, f"{day}{i}", f"Order {i}", f"I was charged twice for order {i}, please refund", f"a{i}@x.org") for i in range(4)]
    again = [("imap", 1, f"{day}8", "Order 1 again", "other words", "a1@x.org"), (*own[2][:2], f"{day}9", "later copy", "copy", "c@x.org")]
    odd = [("pop", number, f"{day}5", None, None, None)]
    return own + again + odd


def batches(spark):
    from datetime import datetime

    return [[(*r[:2], datetime.fromisoformat(r[2]), *r[3:]) for r in rows_of(n)] for n in range(4)]


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, source, path, checkpoint):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    jobs.import_messages(stream, path, key=["provider", "message_id"], order=["at"], chain=chain, checkpoint=checkpoint).awaitTermination()


def content(df):
    return Counter(repr(sorted(r.asDict().items())) for r in df.collect())


@pytest.fixture()
def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "rows"), str(tmp_path / "checkpoint")


def test_four_batches_equal_the_batch_chain(spark, folders):
    source, path, checkpoint = folders
    every = []
    for rows in batches(spark):
        feed(spark, source, rows)
        every += rows
        run(spark, source, path, checkpoint)
    first = {}
    for r in sorted(every, key=lambda r: (r[2], r[3] or "")):
        first.setdefault(r[:2], r)
    got = jobs.imported(spark, path)
    assert content(got) == content(chain(spark.createDataFrame(list(first.values()), SCHEMA)))
    assert got.filter("message_id = 1 AND provider = 'imap'").count() == 1  # it came again up to 90 days later
    assert got.count() == 20


def test_a_batch_that_runs_again_writes_the_same(spark, folders, tmp_path):
    source, path, checkpoint = folders
    parts = batches(spark)
    for rows in parts[:2]:
        feed(spark, source, rows)
        run(spark, source, path, checkpoint)
    before = content(jobs.imported(spark, path))
    # the second batch's commit is lost: the job starts anew from a checkpoint that knows the first only
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".1.crc"):
        crc.unlink()
    run(spark, source, path, checkpoint)
    assert content(jobs.imported(spark, path)) == before
    feed(spark, source, parts[2])
    run(spark, source, path, checkpoint)
    assert jobs.imported(spark, path).count() == 15


def test_a_table_without_rows(spark, folders):
    source, path, checkpoint = folders
    feed(spark, source, [])
    run(spark, source, path, checkpoint)
    feed(spark, source, batches(spark)[0])
    run(spark, source, path, checkpoint)
    assert jobs.imported(spark, path).count() == 5
