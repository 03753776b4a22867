"""The pipeline's stages: what they keep, and that odd tables pass through."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from postroom.llm import decontamination, jaccard_join, queries, secret_scan, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage on the smallest tables."""
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, FOLDER).write.parquet(path)
        seen[name] = docs, spark.read.parquet(path)
        docs = seen[name][1]
    return seen


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "near_copies", "decontamination", "secrets", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert before.columns == after.columns == COLUMNS
            assert set(ids(after)) <= set(ids(before))


def test_each_decision_takes_effect(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"), train=corpus_pipeline.fold("doc_id") != 2)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(before, model).collect()}
    assert ids(after) == sorted(i for i, p in scored.items() if not p) and len(ids(after)) < len(scored)
    before, after = stages["near_copies"]
    joined = jaccard_join.join(before, width=5, percent=80).collect()
    assert ids(after) == sorted(r["doc_id"] for r in joined if r["component_id"] == r["doc_id"] or not r["n_shingles"])
    before, after = stages["decontamination"]
    found = {r["doc_id"] for r in decontamination.find(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert ids(after) == sorted(set(ids(before)) - found)
    before, after = stages["secrets"]
    held = {r["doc_id"]: r["spans"] for r in secret_scan.scan(before).collect()}
    old, new = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (before, after))
    assert set(old) == set(new) and {i for i in old if old[i] != new[i]} == {i for i, s in held.items() if s}
    before, after = stages["packing"]
    assert {r["doc_id"] for r in after.collect()} == set(ids(before))


def test_run_equals_the_stages(spark, stages):
    def rows(df):
        return sorted(tuple(r)[:5] for r in df.collect())

    assert rows(queries.QUERIES["pipeline"](spark, FOLDER)) == rows(stages["packing"][1])


def test_odd_tables_pass(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "", "en", None, 0, None), (2, "b " * 5000, None, "s", 1, "x"),
                                 (3, "same words here once", None, None, None, None), (3, "same words here once", None, None, None, None)], schema)
    for docs, left in ((odd, 4), (odd.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == odd.columns
        assert docs.count() == left
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).select("sequence_id").distinct().count() == (2 if left else 0)


def test_a_stage_alone_takes_small_batches(spark):
    """Stages may be called one by one; the batches are not only set for the whole chain."""
    names = [f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[3:]:
        for name in names:
            spark.conf.unset(name)
        stage(spark, docs.limit(3), FOLDER)
        assert [spark.conf.get(name) for name in names] == [str(corpus_pipeline.ARROW_ROWS), corpus_pipeline.ARROW_BYTES]
