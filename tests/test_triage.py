from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions import matching as mt
from postroom.operators import expectations as ex
from postroom.operators import triage as tr

# One row per rule: which term groups meet, and the level that follows.
RISK_CASES = [
    # a question about what the product can do: the score is reset
    ("Before we buy seats: can pro export its own backups, and are roles and permissions part of it?", "technical", [], "en", "low"),
    ("想了解一下：专业版是否支持离线备份？", "product_question", [], "zh", "low"),
    # the same words with a failure in it are no such question
    ("Can pro restore backups? Ours failed overnight.", "technical", [], "en", "medium"),
    # money, paperwork or access alone
    ("When will the refund for order 7731 reach my bank?", "refund", [], "en", "medium"),
    ("The receipt you issued spells our street wrongly.", "billing", [], "en", "medium"),
    ("登录时收不到短信，麻烦看一下。", "technical", [], "zh", "medium"),
    # a dispute: charge and twice, unauthorized and renewed, cancelled and still charged
    ("The charge of 9 May shows as two identical lines.", "refund", [], "en", "high"),
    ("An unauthorized renewal appeared on Monday.", "refund", [], "en", "high"),
    ("I cancelled in May and I am still charged in July.", "refund", [], "en", "high"),
    # asking what to hand in is no dispute
    ("For the charge that came twice this month, what evidence do you want to see?", "refund", [], "en", "medium"),
    # outage with production or a wide reach
    ("Since 6:00 the core page timed out for every clerk.", "other", [], "en", "high"),
    ("An incident hit two departments.", "other", [], "en", "high"),
    ("The wiki timed out once.", "other", [], "en", "low"),
    # locked out, law, and a complaint that climbs
    ("We are in an mfa loop since the phone change.", "technical", [], "en", "high"),
    ("Somebody from an unknown device reads our files.", "other", [], "en", "high"),
    ("I want to speak to a supervisor.", "other", [], "en", "high"),
    # flags of the preprocessing count on their own
    ("The line stands still, production too.", "other", ["business_blocked"], "en", "high"),
    ("Nothing special here.", None, ["legal_risk"], "en", "high"),
    ("Nothing special here.", None, None, "en", "low"),
]


def test_risk_levels(spark):
    rows = [(i, t.lower(), c, f, lang, want) for i, (t, c, f, lang, want) in enumerate(RISK_CASES)]
    df = spark.createDataFrame(
        rows, "id int, t string, category string, preprocessing_flags array<string>, language string, want string"
    )
    for row in tr.assess_risk(df, "t").collect():
        assert row["risk_level"] == row["want"], row
        assert (row["risk_score"] >= 4) == (row["risk_level"] == "high")
        assert len(set(row["risk_flags"])) == len(row["risk_flags"])


def test_bounded_terms_do_not_touch_letters(spark):
    df = spark.createDataFrame(
        [("a tissue box",), ("they may sue us",), ("(sue)",), ("9-sue_x",), ("他们要起诉",), ("敏感 oauth7",)], "t string"
    )
    found = [r[0] for r in df.select(mt.has_bounded("t", ("sue", "起诉", "敏感 oauth"))).collect()]
    assert found == [False, True, True, True, True, False]


def test_vote_ties_go_to_the_earlier_rule(spark):
    df = spark.createDataFrame([("login and refund",), ("invoice receipt tax plan",), ("hello",)], "t string")
    rows = tr.vote_category(df, "t").collect()
    assert [r["category"] for r in rows] == ["refund", "billing", "other"]
    assert [r["confidence"] for r in rows] == [0.79, 0.93, 0.58]
    assert rows[1]["matched_terms"] == ["invoice", "receipt", "tax"]


def test_gate_keeps_requests_and_drops_marketing(spark):
    rows = [
        ("Welcome to Quillbase", "Your trial has begun. Take the tour when you like. Unsubscribe here.",
         "Mia mia@quillbase.example", False, "welcome"),
        ("Locked out since Tuesday", "I cannot log in to the shop. Please help me, the reset keeps failing.",
         "Kim kim@buyer.example", True, "support intent"),
        ("Spring release", "Explore the latest features in a product tour.", "Product Team tips@tool.example", False, "platform"),
        ("Sign-in notice", "Your verification code is 907", "noreply@github.com", False, "platform security"),
    ]
    df = spark.createDataFrame(rows, "subject string, body string, sender string, want boolean, part string")
    for row in tr.triage(df, subject="subject", body="body", sender="sender").collect():
        assert row["is_support"] == row["want"], row
        assert row["part"] in row["gate_reason"].lower()
        if not row["want"]:
            assert (row["status"], row["category"], row["risk_level"], row["risk_flags"]) == ("irrelevant", "other", "low", [])


def test_a_negative_verdict_filters_the_message(spark):
    df = spark.createDataFrame([("a message", "c@example.com", "other"), ("a message", "c@example.com", "refund")],
                               "t string, s string, category string")
    df = df.withColumns({"nothing": F.lit(""), "letter": F.lit("this is a newsletter")})
    out = tr.second_gate(df, "t", "s", analysis="nothing", verdict_is_support=F.lit(False)).collect()
    assert all(r["is_filtered"] and r["filter_reason"] == lx.SECOND_GATE_REASONS["verdict"] for r in out)
    kept = tr.second_gate(df, "t", "s", analysis="letter").collect()
    assert [r["is_filtered"] for r in kept] == [True, False]


def test_rules_raise_but_never_lower(spark):
    df = spark.createDataFrame(
        [("low", ["model"], "high", ["leak"]), ("high", ["threat"], "medium", ["threat", "routine"])],
        "m string, mf array<string>, r string, rf array<string>",
    )
    merged = [r[0] for r in df.select(tr.merge_risk(F.col("m"), F.col("mf"), F.col("r"), F.col("rf"))).collect()]
    assert [(m["level"], m["flags"]) for m in merged] == [("high", ["model", "leak"]), ("high", ["threat", "routine"])]


def test_verdict_validation(spark):
    good = {"category": "refund", "is_support_request": True, "confidence": 0.9, "risk_level": "low",
            "risk_flags": [], "should_escalate": False, "reason": "r"}
    texts = [
        json.dumps(good),
        "```json\n" + json.dumps(good) + "\n```",
        json.dumps({**good, "risk_level": "severe"}),
        json.dumps({**good, "confidence": 1.2}),
        json.dumps({k: v for k, v in good.items() if k != "reason"}),
        "not json",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string")
    rows = ex.parse_verdicts(df, "raw").orderBy("id").collect()
    assert [r["verdict"] is not None for r in rows] == [True, True, False, False, False, False]
    assert rows[2]["verdict_errors"] == ["risk_level"] and rows[3]["verdict_errors"] == ["confidence"]


def test_context_lists_attachments(spark):
    schema = "s string, b string, a array<struct<filename:string,content_type:string,size_bytes:bigint,text_preview:string>>"
    df = spark.createDataFrame([("S", "B", []), ("S", "B", [("f.pdf", "", 10, ""), ("g.txt", "text/plain", 5, "hello")])], schema)
    got = [r[0] for r in df.select(tr.analysis_context(F.col("s"), F.col("b"), F.col("a"))).collect()]
    assert got[0] == "S\n\nB"
    assert got[1] == "S\n\nB\n\nAttachments:\nf.pdf (unknown, 10 bytes)\ng.txt (text/plain, 5 bytes): hello"


def test_split_valid_quarantines_with_reasons(spark):
    df = spark.createDataFrame([("a", "a@b", "s", "long enough body"), ("", "a@b", "s", "short")],
                               "customer_name string, customer_email string, subject string, body string")
    valid, bad = ex.split_valid(df, ex.message_expectations())
    assert valid.count() == 1
    assert bad.collect()[0]["broken"] == ["customer_name", "body"]


@pytest.mark.parametrize("confidence,hits,want", [(0.7, ["strong"], "ready_to_send"), (0.69, ["strong"], "human_review"),
                                                  (0.9, ["medium"], "human_review")])
def test_routing(spark, confidence, hits, want):
    df = spark.createDataFrame([(confidence, [(h,) for h in hits])], "c double, h array<struct<reliability:string>>")
    route = tr.review_route(F.lit("low"), F.lit(False), F.lit("refund"), F.col("c"), F.col("h"))
    assert df.select(route).collect()[0][0] == want
