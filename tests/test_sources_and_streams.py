from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.operators import corpus as cp
from postroom.operators import lifecycle as lc
from postroom.operators.expectations import split_valid
from postroom.sources import corpus_files as cf
from postroom.sources import tables as tb
from postroom.streaming import jobs


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "kb" / "deep").mkdir(parents=True)
    (tmp_path / "kb" / "a.md").write_text("﻿# A\n\nbody", encoding="utf-8")
    (tmp_path / "kb" / "deep" / "b c.TXT").write_text("two\nlines", encoding="utf-8")
    (tmp_path / "kb" / "skip.png").write_bytes(b"x")
    rows = {r["source"]: r for r in cf.read_corpus(spark, str(tmp_path / "kb")).collect()}
    assert set(rows) == {"a.md", "deep/b c.TXT"}
    assert rows["a.md"]["text"] == "# A\n\nbody" and rows["deep/b c.TXT"]["stem"] == "b c"


def test_labelled_cases(spark, tmp_path):
    case = {"id": "1", "language": "en", "customer_name": "n", "customer_email": "e", "subject": "s", "body": "b", "expected_support": True}
    lines = [json.dumps(case), "", json.dumps({**case, "id": "2", "tags": ["t"], "expected_risk": "high"}), json.dumps(case)]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(lines))
    cases = cf.read_cases(spark, str(path))
    rows = sorted(cases.collect(), key=lambda r: (r["id"], r["expected_risk"]))
    assert len(rows) == 3 and rows[0]["expected_category"] == "other" and rows[0]["tags"] == [] and rows[2]["expected_risk"] == "high"
    found = cf.check_cases(cases).collect()[0]
    assert (found["cases"], found["duplicate_ids"], found["broken"]) == (3, 1, ["unique_ids"])
    assert cf.read_cases(spark, str(path), 2).count() == 2
    assert cf.check_cases(cases.filter("false")).collect()[0]["broken"] == ["size"]


def test_scenarios_expand_per_language(spark):
    rows = [("refund", 1, "double", "high", ["r.md"], True, "主题", "正文", "Subject", "Body"),
            ("", 2, "promo", None, [], False, "推", "广", "Promo", "Sale")]
    df = spark.createDataFrame(rows, "category string, number int, slug string, risk string, sources array<string>, support boolean, "
                                     "subject_zh string, body_zh string, subject_en string, body_en string")
    out = {r["id"]: r for r in cf.expand_scenarios(df).collect()}
    assert set(out) == {"ext-refund-zh-01", "ext-refund-en-01", "ext-nonsupport-zh-02", "ext-nonsupport-en-02"}
    assert out["ext-nonsupport-en-02"]["tags"] == ["non_support", "promo", "en", "extended"]
    assert out["ext-nonsupport-en-02"]["expected_risk"] == "low"


def test_replace_keeps_other_parents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda items: spark.createDataFrame(items, "doc bigint, text string")
    tb.replace_by_bucket(rows([(i, f"old {i}") for i in range(20)] + [(3, "old 3b")]), path, "doc", 4)
    tb.replace_by_bucket(rows([(3, "new 3"), (40, "new 40")]), path, "doc", 4)
    tb.replace_by_bucket(rows([(3, "new 3"), (40, "new 40")]), path, "doc", 4)
    got = sorted((r["doc"], r["text"]) for r in spark.read.parquet(path).collect())
    assert got == sorted([(i, f"old {i}") for i in range(20) if i != 3] + [(3, "new 3"), (40, "new 40")])


def test_audit_log_and_report_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, what string")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    for scope in ("mail", "knowledge"):
        events = tb.audit_rows(df, scope=scope, action="import", title=F.col("what"), summary=F.lit("s"), detail=["id"], at=at)
        tb.append_audit(events, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and sorted(r[0] for r in log.filter("scope = 'mail'").select("detail").collect()) == ['{"id":1}', '{"id":2}']
    tb.write_report({"metrics": df, "failures": df.filter("id = 2")}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "failures")).count() == 1


def test_evolve_adds_and_fills(spark):
    old = spark.createDataFrame([(1, None)], "id int, status string")
    row = tb.evolve(old, {"status": F.lit("indexed"), "flags": F.array().cast("array<string>")}).collect()[0]
    assert (row["status"], row["flags"]) == ("indexed", [])


@pytest.fixture
def event_files(spark, tmp_path):
    """Actions of forty entities in five files, shuffled over the files."""
    rows = []
    for i in range(400):
        entity = 0 if i % 3 == 0 else i % 40
        action = ("open", "assign", "resolve", "return_to_review", "open")[(i * 7 + i // 40) % 5]
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), entity, action, float(i % 13)))
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    for part in range(5):
        df.filter(F.col("event_id") % 5 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return df, str(tmp_path / "events"), "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def read_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_state_equals_batch(spark, event_files):
    df, folder, schema = event_files
    stream = read_stream(spark, folder, schema)
    state = jobs.entity_state(stream, "user_id", "ts", "event_id", "event_type", lx.TICKET_STATUS)
    got = {r["user_id"]: (r["status"], r["events"]) for r in jobs.drain(state, "t", "update", ["user_id"]).collect()}
    log = df.withColumns({"action": F.col("event_type"), "operator": F.lit("o")})
    tickets = lc.seq.latest(lc.tickets(log, "user_id", ["ts", "event_id"], F.to_date("ts")), ["user_id"], ["ticket_number"])
    status = {r["user_id"]: r["status"] for r in tickets.collect()}
    counts = {r["user_id"]: r["count"] for r in df.groupBy("user_id").count().collect()}
    assert got == {user: (status[user], counts[user]) for user in status}


def test_streamed_usage_equals_batch(spark, event_files):
    df, folder, schema = event_files
    as_usage = lambda d: d.select("ts", "event_type", F.floor("value").alias("input_tokens"), F.lit(1).alias("output_tokens"))
    stream = jobs.daily_usage(as_usage(read_stream(spark, folder, schema)), "ts", "30 days", ["event_type"])
    got = sorted(tuple(r) for r in jobs.drain(stream, "u", "complete").collect())
    want = sorted(
        tuple(r)
        for r in as_usage(df).groupBy(F.to_date("ts").alias("day"), "event_type")
        .agg(F.count("*"), F.sum("input_tokens"), F.sum("output_tokens")).collect()
    )
    assert got == want


def test_streamed_dedup(spark, event_files):
    df, folder, schema = event_files
    stream = read_stream(spark, folder, schema)
    kept = jobs.new_messages(stream, ["user_id", "event_type"], "ts", "60 days", lambda d: d.filter("event_type <> 'assign'"))
    rows = [tuple(r) for r in jobs.drain(kept.select("user_id", "event_type"), "d").collect()]
    want = {tuple(r) for r in df.filter("event_type <> 'assign'").select("user_id", "event_type").distinct().collect()}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_streamed_corpus_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"# Part {i}\n\nBody of document {i}. " * (i + 1), "T", f"{i}.md") for i in range(12)],
                                 "doc_id bigint, text string, title string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    stream = read_stream(spark, str(tmp_path / "docs"), "doc_id bigint, text string, title string, source string")
    jobs.upsert_corpus(stream, str(tmp_path / "chunks"), key="doc_id", text="text", title="title", source="source",
                       checkpoint=str(tmp_path / "cp"), buckets=4).awaitTermination()
    batch = cp.chunk_documents(cp.clean_documents(docs, "text"), key="doc_id", text="clean_text", title="title", source="source")
    columns = ["doc_id", "position", "content", "category"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "chunks")).select(*columns).collect())
    assert got == sorted(tuple(r) for r in batch.select(*columns).collect())


def test_split_valid_is_complete(spark):
    df = spark.range(10)
    valid, bad = split_valid(df, {"even": F.col("id") % 2 == 0, "small": F.col("id") < 7})
    assert valid.count() + bad.count() == 10


def test_bad_case_lines_fail_or_are_kept_apart(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text("\n".join([json.dumps({"id": "1", "subject": "s"}), "", '{"subject": "no id"}', "not json", json.dumps({"id": "2"})]))
    with pytest.raises(Exception, match="no id|unreadable"):
        cf.read_cases(spark, str(path)).collect()
    rows = cf.read_cases(spark, str(path), quarantine=True).collect()
    assert sorted((r["id"] or "", r["problem"] or "") for r in rows) == [("", "no id"), ("", "unreadable"), ("1", ""), ("2", "")]
    assert {r["bad_line"] for r in rows} == {None, "not json", '{"subject": "no id"}'}


def test_replace_drops_rows_of_emptied_parents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda items: spark.createDataFrame(items, "doc bigint, text string")
    keys = lambda items: spark.createDataFrame([(i,) for i in items], "doc bigint")
    tb.replace_by_bucket(rows([(i, f"old {i}") for i in range(6)]), path, "doc", 64)
    tb.replace_by_bucket(rows([(2, "new")]), path, "doc", 64, arrived=keys([1, 2, 4]))
    got = sorted((r["doc"], r["text"]) for r in spark.read.parquet(path).collect())
    assert got == [(0, "old 0"), (2, "new"), (3, "old 3"), (5, "old 5")]


def test_upsert_takes_the_newest_version_and_drops_emptied_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, title string, source string, at bigint"
    folder, out = str(tmp_path / "in"), str(tmp_path / "chunks")

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.upsert_corpus(spark.readStream.schema(schema).parquet(folder), out, key="doc_id", text="text", title="title", source="source",
                           checkpoint=str(tmp_path / "cp"), buckets=4, version=["at"]).awaitTermination()
        return sorted((r["doc_id"], r["content"]) for r in spark.read.parquet(out).collect())

    body = "A body that is long enough to become one chunk of text."
    first = send([(1, f"old {body}", "T", "a.md", 1), (1, f"new {body}", "T", "a.md", 2), (2, f"two {body}", "T", "b.md", 1)])
    assert [(i, t[:3]) for i, t in first] == [(1, "new"), (2, "two")]
    assert [i for i, _ in send([(1, "", "T", "a.md", 3)])] == [2]


def test_late_usage_is_dropped_in_append_mode(spark, tmp_path):
    schema = "ts timestamp_ntz, event_type string, input_tokens bigint, output_tokens bigint"
    folder = str(tmp_path / "usage")

    def send(*rows):
        spark.createDataFrame([(dt.datetime(2024, 1, d), "click", n, n) for d, n in rows], schema).coalesce(1).write.mode("append").parquet(folder)

    send((1, 10), (2, 20))
    usage = lambda: jobs.daily_usage(spark.readStream.schema(schema).parquet(folder), "ts", "1 day", ["event_type"])
    query = lambda: usage().writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).format(
        "parquet").outputMode("append").start(str(tmp_path / "out")).awaitTermination()
    query()
    send((9, 90))
    query()
    send((1, 1000), (15, 150))  # the first of these is eight days late
    query()
    rows = sorted((r["day"].day, r["messages"], r["input_tokens"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(1, 1, 10), (2, 1, 20), (9, 1, 90)]
