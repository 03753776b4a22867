"""Streams over tables that are folders of part files, as a large table is."""

from __future__ import annotations

import pytest

from postroom.plans.registry import QUERIES
from postroom.plans import load

load()


def documents(spark):
    text = "First heading here\nSome words of the body that go on for a while.\nMore of them."
    rows = [(i, f"{text} Number {i}.", "en", f"d{i}.md", 90) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def conversations(spark):
    rows = [(i, t, "user" if t % 2 else "assistant", f"please refund order {i}") for i in range(10) for t in range(3)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.fixture(params=[1, 3])
def folder(request, spark, tmp_path):
    for name, rows in (("documents", documents(spark)), ("conversations", conversations(spark))):
        rows.repartition(request.param).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_corpus_upsert(spark, folder):
    got = {r["doc_id"]: r["chunks"] for r in QUERIES["stream_corpus_upsert"](spark, folder).collect()}
    assert got == dict.fromkeys(range(12), 1)


def test_import_and_triage(spark, folder):
    wanted = {(i, 1) for i in range(10)}
    for name in ("stream_import", "stream_triage"):
        got = [(r["conv_id"], r["turn"]) for r in QUERIES[name](spark, folder).collect()]
        assert len(got) == 10 and set(got) == wanted
