from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.operators import evaluation as ev
from postroom.operators import layout as ly
from postroom.operators import reporting as rp
from postroom.schemas import OCR_WORD


def test_binary_and_label_metrics(spark):
    rows = [(True, True, "a", "a"), (True, False, "a", "b"), (False, True, "b", "b"), (False, False, "b", "other")]
    df = spark.createDataFrame(rows, "e boolean, p boolean, le string, lp string")
    b = ev.binary_metrics(df, "e", "p").collect()[0]
    assert (b["true_positive"], b["false_positive"], b["false_negative"], b["true_negative"]) == (1, 1, 1, 1)
    assert (b["accuracy"], b["precision"], b["recall"], b["f1"]) == (0.5, 0.5, 0.5, 0.5)
    per = {r["label"]: r for r in ev.label_metrics(df, "le", "lp", ["a", "b", "c"]).collect()}
    assert (per["a"]["precision"], per["a"]["recall"], per["a"]["f1"]) == (1.0, 0.5, 0.6667)
    assert (per["b"]["support"], per["b"]["precision"], per["b"]["recall"]) == (2, 0.5, 0.5)
    assert per["c"]["f1"] == 0.0
    macro = ev.macro_metrics(df, "le", "lp", ["a", "b", "c"]).collect()[0]
    assert macro["accuracy"] == 0.5 and macro["macro_f1"] == round((2 / 3 + 0.5) / 3, 4)
    none = ev.binary_metrics(df.filter("false"), "e", "p").collect()[0]
    assert (none["cases"], none["f1"]) == (0, 0.0)


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame(
        [(1, "docs/a.md#chunk-1", 1), (1, "docs/a.md#chunk-2", 2), (1, "b.md", 3), (1, "c.md", 4), (1, "d.md", 5), (2, "x.md", 1)],
        "q int, source string, k int")
    top = ev.distinct_sources(hits, "q", "source", "k", 3)
    assert [r["source"] for r in top.filter("q = 1").orderBy("source_rank").collect()] == ["docs/a.md", "b.md", "c.md"]
    cases = spark.createDataFrame([(1, ["B.md", "c.md"]), (2, ["y.md"]), (3, ["z.md"])], "q int, expected array<string>")
    m = ev.retrieval_metrics(ev.retrieval_judgements(cases, top, "q", "expected")).collect()[0]
    assert (m["evaluated_cases"], m["recall_at_1"], m["recall_at_3"]) == (3, 0.0, 0.3333)
    assert (m["mrr"], m["precision_at_3"]) == (0.1667, 0.2222)


def test_source_match_needs_a_path_border(spark):
    df = spark.createDataFrame([("kb/refund.md", "REFUND.md"), ("kb/no-refund.md", "refund.md"), ("a\\b.md#chunk-4", "b.md")],
                               "a string, e string")
    assert [r[0] for r in df.select(ev.source_matches(F.col("a"), F.col("e"))).collect()] == [True, False, True]


def test_failures(spark):
    schema = ("id string, expected_support boolean, predicted_support boolean, expected_category string, predicted_category string, "
              "expected_risk string, predicted_risk string, expected_language string, predicted_language string, "
              "expected_sources array<string>, retrieved_sources array<string>, error string")
    rows = [
        ("ok", True, True, "refund", "refund", "low", "low", "en", "en", ["a.md"], ["kb/a.md"], ""),
        ("bad", True, True, "refund", "billing", "low", "high", "en", "zh", ["a.md"], ["b.md"], "boom"),
        ("miss", True, False, "refund", "other", "low", "high", "en", "en", [], [], ""),
    ]
    out = ev.failures(spark.createDataFrame(rows, schema), ev.case_checks(True))
    got = {r["id"]: r["failed_metrics"] for r in out.collect()}
    assert got == {"bad": ["category", "risk", "language", "rag_recall_at_3", "runtime_error"], "miss": ["support_detection"]}


def test_profile(spark):
    df = spark.createDataFrame([(True, "en", ["x", "y"]), (False, "zh", ["x"]), (True, "en", [])], "s boolean, l string, t array<string>")
    got = {(r["dimension"], r["value"]): r["cases"] for r in ev.dataset_profile(df, support="s", language="l", tags="t").collect()}
    assert got == {("all", "cases"): 3, ("support", "support"): 2, ("support", "non_support"): 1, ("language", "en"): 2,
                   ("language", "zh"): 1, ("tag", "x"): 2, ("tag", "y"): 1}


def test_recent_usage_counts_the_whole_day_and_24_hours(spark):
    at = dt.datetime(2024, 5, 2, 6)
    rows = [(at + dt.timedelta(hours=h), 1, None, 2, 0.5) for h in (-25, -24, -10, 0, 17, 18)]
    df = spark.createDataFrame(rows, "u timestamp_ntz, input_tokens int, output_tokens int, embedding_tokens int, estimated_cost double")
    row = rp.recent_usage(df, "u", "2024-05-02 06:00:00").collect()[0]
    assert (row["messages"], row["tokens"], row["cost"]) == (4, 12, 2.0)


def test_cost_and_notes(spark):
    df = spark.createDataFrame([("m", 1_000_000, None, 500_000)], "k string, input_tokens bigint, output_tokens bigint, embedding_tokens bigint")
    assert rp.usage_by(df, ["k"]).collect()[0]["estimated_cost"] == 1.04
    acts = spark.createDataFrame([("zh", "approve", ""), ("en", "revise", "mine"), ("fr", "revise", None)], "language string, action string, note string")
    got = {(r["language"], r["action"]): r["note"] for r in rp.with_review_note(acts, rp.review_notes(spark)).collect()}
    assert got == {("zh", "approve"): "审核通过，可以发送。", ("en", "revise"): "mine", ("fr", "revise"): None}


def test_variant_and_capabilities(spark):
    df = spark.createDataFrame([("alternative-2",), ("default",), ("alternative-5",)], "v string")
    bodies = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert [r[0] for r in df.select(rp.variant_of(bodies, F.col("v"))).collect()] == ["b", "a", "b"]
    marks = [("logs", ("audit",)), ("teams", ("team workspace", "工作区"))]
    e = spark.createDataFrame([("Audit and 工作区",), ("nothing",)], "e string")
    got = [r[0] for r in e.select(rp.capability_answer(F.col("e"), marks, "Has ", ".", "No.", ", ")).collect()]
    assert got == ["Has logs, teams.", "No."]


def test_flag_labels(spark):
    from postroom.functions.matching import relabel

    df = spark.createDataFrame([("Possible refund and legal issue",), ("unknown",)], "f string")
    assert [r[0] for r in df.select(relabel(F.col("f"), lx.RISK_FLAG_LABELS)).collect()] == ["涉及法务风险，涉及退款请求", "unknown"]


def words(spark, rows):
    full = [(1, 1, b, p, line, i, left, top, w, h, conf, text) for i, (b, p, line, left, top, w, h, conf, text) in enumerate(rows)]
    return spark.createDataFrame(full, OCR_WORD)


def test_words_become_lines_and_blocks(spark):
    df = words(spark, [(1, 1, 1, 42, 20, 30, 10, 95.0, "政策"), (1, 1, 1, 10, 20, 30, 10, 93.0, "企业"),
                       (1, 1, 2, 10, 40, 60, 10, 90.0, "Policy"), (1, 1, 2, 90, 40, 10, 10, -1.0, "noise"), (2, 1, 1, 0, 0, 5, 5, 80.0, " ")])
    usable = ly.usable_words(df)
    assert usable.count() == 3
    block = ly.build_blocks(usable, ["doc_id", "page"]).collect()
    assert len(block) == 1 and block[0]["text"] == "企业政策\nPolicy"
    assert (block[0]["left"], block[0]["top"], block[0]["width"], block[0]["height"]) == (10, 20, 62, 30)
    assert round(block[0]["confidence"], 4) == round((0.93 * 300 + 0.95 * 300 + 0.90 * 600) / 1200, 4)


def blocks(spark, rows):
    full = [(1, 1, i, 0, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id int, page int, block int, par int, text string, left int, top int, width int, height int")


def test_two_columns_read_left_then_right(spark):
    df = blocks(spark, [("head", 50, 10, 850, 40), ("L1", 50, 100, 300, 60), ("R1", 600, 110, 300, 60), ("L2", 50, 240, 300, 60),
                        ("R2", 600, 250, 300, 60), ("foot", 50, 400, 850, 20)])
    rows = ly.reading_order(df, ["doc_id", "page"]).orderBy("position").collect()
    assert [r["text"] for r in rows] == ["head", "L1", "L2", "R1", "R2", "foot"]
    assert all(r["multi_column"] and r["reordered"] for r in rows)
    single = ly.reading_order(blocks(spark, [(t, 50, y, 700, 30) for t, y in (("a", 10), ("b", 60), ("c", 110), ("d", 160))]), ["doc_id", "page"])
    assert not any(r["multi_column"] or r["reordered"] for r in single.collect())


def test_quality_orders_pages(spark):
    df = spark.createDataFrame([("Clean readable text of a page", 0.95, 3, 0), ("□■� x ◆ ~~ ^^", 0.4, 3, 3), ("", 0.9, 0, 0)],
                               "text string, average_confidence double, blocks bigint, short_blocks bigint")
    good, bad, empty = (r[0] for r in df.select(ly.quality_score()).collect())
    assert good > 0.9 > bad >= 0.0 and empty == 0.0


def test_best_alternative_keeps_the_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0, 5, "a"), (1, 1, 9, "b"), (1, 2, 9, "c")], "k int, pos int, s int, t string")
    assert ly.pick_best(df, ["k"], F.col("s"), "pos", "t").collect()[0]["t"] == "b"
