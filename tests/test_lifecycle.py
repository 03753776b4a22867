from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from postroom.operators import lifecycle as lc
from postroom.operators import sequence as seq

START = dt.datetime(2024, 1, 1)


def log(spark, count=600):
    """A log in which one key holds a third of all rows."""
    rng = random.Random(3)
    rows = []
    for i in range(count):
        user = 0 if i % 3 == 0 else rng.randint(1, 12)
        rows.append((i, user, START + dt.timedelta(minutes=rng.randint(0, 9000)), rng.choice("abc"), rng.randint(0, 4)))
    return spark.createDataFrame(rows, "id bigint, user int, ts timestamp_ntz, kind string, n int")


def as_set(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def test_stretched_windows_equal_plain_windows(spark):
    df = log(spark)
    w = Window.partitionBy("user").orderBy("ts", "id")
    plain = df.withColumn("p", F.lag("kind").over(w)).withColumn("s", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    day = F.to_date("ts")
    split = seq.with_previous(df, ["user"], ["ts", "id"], F.col("kind"), day, "p")
    split = seq.with_running_sum(split, ["user"], ["ts", "id"], F.col("n"), day, "s")
    assert as_set(plain.fillna("-"), "id", "p", "s") == as_set(split.fillna("-"), "id", "p", "s")


def test_nearest_rank_rounds_half_to_even(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 40)) for k in range(6) for _ in range(rng.randint(1, 60))] + [(9, None)]
    df = spark.createDataFrame(rows, "k int, v int")
    for ratio in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["percentile"] for r in seq.nearest_rank(df, ["k"], "v", ratio, F.floor(F.col("v") / 7)).collect()}
        for k in range(6):
            values = sorted(v for key, v in rows if key == k)
            assert got[k] == values[round((len(values) - 1) * ratio)], (k, ratio)
        assert 9 not in got


def test_version_history_and_rollback(spark):
    rows = [(1, i, c) for i, c in enumerate("aabbbacc")] + [(2, 0, None), (2, 1, None), (2, 2, "x")]
    df = spark.createDataFrame(rows, "doc int, at int, hash string")
    versions = lc.version_history(df, ["doc"], ["at"], ["hash"], F.floor(F.col("at") / 2)).cache()
    assert as_set(versions.fillna("-"), "doc", "version_number", "at", "hash") == [
        (1, 1, 0, "a"), (1, 2, 2, "b"), (1, 3, 5, "a"), (1, 4, 6, "c"), (2, 1, 0, "-"), (2, 2, 2, "x")]
    target = spark.createDataFrame([(1, 2)], "doc int, target_version bigint")
    assert as_set(lc.restore_version(versions, target, "doc"), "doc", "version_number") == [(1, 1), (1, 2), (2, 1), (2, 2)]
    wish = spark.createDataFrame([(1, 4), (1, 2), (2, 1)], "doc int, version_number bigint")
    kept, refused = lc.delete_versions(versions, wish, "doc")
    assert as_set(kept, "doc", "version_number") == [(1, 1), (1, 3), (1, 4), (2, 2)]
    assert as_set(refused, "doc", "version_number") == [(1, 4)]


def brute_tickets(events):
    """Replay of the ticket rules, one event after the other."""
    tickets = []
    for action, operator in events:
        current = tickets[-1] if tickets else None
        if action == "open":
            if not current or current["status"] not in ("open", "assigned"):
                tickets.append({"status": "open", "assigned": ""})
            continue
        if not current:
            current = {"status": "open", "assigned": ""}
            tickets.append(current)
        if action == "assign":
            current["status"], current["assigned"] = "assigned", operator
        else:
            current["status"] = {"resolve": "resolved", "return_to_review": "returned"}[action]
            current["assigned"] = current["assigned"] or operator
    return [(n + 1, t["status"], t["assigned"]) for n, t in enumerate(tickets)]


def test_tickets_equal_a_replay(spark):
    rng = random.Random(6)
    rows = []
    for key in range(20):
        for i in range(rng.randint(1, 25)):
            rows.append((key, i, rng.choice(["open", "open", "assign", "resolve", "return_to_review"]), rng.choice("xyz")))
    df = spark.createDataFrame(rows, "m int, at int, action string, operator string")
    got = as_set(lc.tickets(df, "m", ["at"], F.floor(F.col("at") / 5)), "m", "ticket_number", "status", "assigned_to")
    want = sorted(
        (key, *ticket) for key in range(20) for ticket in brute_tickets([(a, o) for k, _, a, o in rows if k == key])
    )
    assert got == want


def test_import_upsert_and_status(spark):
    incoming = spark.createDataFrame([("gmail", str(i), i) for i in range(10)], "provider string, mid string, at int")
    known = incoming.filter("at in (8, 9, 1)").union(incoming.filter("at = 9"))
    marked = lc.split_import(incoming, known, ["provider", "mid"], [F.col("at").desc()], 4, "provider")
    assert as_set(marked, "mid", "is_new") == [("6", True), ("7", True), ("8", False), ("9", False)]
    assert lc.import_counts(marked, "provider").collect()[0].asDict() == {"provider": "gmail", "queued_count": 2, "skipped_count": 2}

    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = lc.upsert(stored, new, ["k"])
    assert as_set(once, "k", "v") == [(1, "a"), (2, "B"), (3, "C")] == as_set(lc.upsert(once, new, ["k"]), "k", "v")

    actions = spark.createDataFrame(
        [(1, 1, "revise", "draft one"), (1, 2, "escalate", ""), (1, 3, "undo_escalate", ""), (2, 1, "revise", ""), (2, 2, "approve", "")],
        "m int, at int, action string, reply string")
    status = lc.message_status(actions, "m", ["at"], draft="reply")
    assert as_set(status.fillna("-"), "m", "status", "draft_reply", "has_approval") == [
        (1, "human_review", "draft one", False), (2, "ready_to_send", "-", True)]
    history = lc.escalation_history(actions, "m", ["at"])
    flags = history.select("m", lc.has_escalation_history(F.col("last_escalates"), F.lit("resolved")).alias("h"))
    assert as_set(flags, "m", "h") == [(1, False), (2, True)]


def test_retention(spark):
    rows = [("a", START), ("a", START + dt.timedelta(days=40)), ("b", START), ("a", None)]
    df = spark.createDataFrame(rows, "scope string, created_at timestamp_ntz")
    kept, removed = lc.purge_log(df, "created_at", "2024-02-15 00:00:00", 30, ("scope", "a"))
    assert (kept.count(), removed.count()) == (3, 1)
    kept, removed = lc.purge_log(df, "created_at", "2024-02-15 00:00:00", 30)
    assert (kept.count(), removed.count()) == (2, 2)


def test_children_and_variants(spark):
    parents = spark.createDataFrame([(1,), (2,)], "p int")
    children = spark.createDataFrame([(1, i, f"c{i}") for i in range(5)], "p int, i int, name string")
    nested = {r["p"]: r for r in lc.nest_last_children(parents, children, "p", ["i"], ["name"], 3).collect()}
    assert nested[1]["child_count"] == 5 and [c["name"] for c in nested[1]["last_children"]] == ["c2", "c3", "c4"]
    assert nested[2]["child_count"] == 0 and nested[2]["last_children"] is None
    assert lc.attach_children(parents, children, "p").count() == 6
    steps = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(8)], "m int, i int, again boolean")
    got = lc.reply_variant(steps, ["m"], ["i"], F.col("again"), F.floor(F.col("i") / 3)).orderBy("i").collect()
    assert [r["reply_variant"][-1] for r in got] == list("12233112")


def test_document_status(spark):
    df = spark.createDataFrame([(True, ""), (False, "too   short " * 40)], "ok boolean, why string")
    good, bad = (r[0] for r in df.select(lc.document_status(F.col("ok"), F.col("why"))).collect())
    assert good["status"] == "indexed" and bad["status"] == "failed" and len(bad["status_message"]) <= 223


def test_children_are_attached_in_tasks_of_bounded_rows(spark):
    parents = spark.createDataFrame([(i, f"p{i}") for i in range(40)] + [(3, "again"), (None, "none"), (7, "p7")], "p long, name string")
    children = spark.createDataFrame([(i % 30, i) for i in range(90)] + [(7, 1000 + i) for i in range(60)] + [(None, 5), (99, 6)], "p long, c long")

    def rows(df):
        return sorted(map(tuple, df.select("p", "name", "c", "has_child").collect()), key=repr)

    whole = lc.attach_children(parents, children, "p")
    cut = lc.attach_children(parents, children, "p", task_rows=10)
    left = parents.join(children.withColumn("has_child", F.lit(True)), "p", "left").fillna(False, ["has_child"])
    assert rows(cut) == rows(whole) == rows(left)
    tasks = -(-(parents.count() + children.count()) // 10)
    assert f", {tasks}), REPARTITION_BY_NUM" in cut._jdf.queryExecution().executedPlan().toString()
