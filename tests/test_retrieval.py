from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from postroom.operators import retrieval as rt


def vectors(spark, count, dims, seed, hot="a"):
    rng = random.Random(seed)
    rows = [
        (i, hot if i % 3 == 0 else rng.choice("bcd"), [round(rng.uniform(-1, 1), 3) for _ in range(dims)]) for i in range(count)
    ]
    return rows, spark.createDataFrame(rows, "id bigint, category string, embedding array<double>")


def test_blocks_do_not_change_the_result(spark):
    q_rows, queries = vectors(spark, 20, 8, 1)
    c_rows, corpus = vectors(spark, 90, 8, 2)
    odd = spark.createDataFrame([(500, "a", [1.0, 2.0])], "id bigint, category string, embedding array<double>")
    for block_rows in (7, 4096):
        found = rt.vector_recall(queries, corpus.union(odd), query_key="id", corpus_key="id", limit=5, group="category", block_rows=block_rows)
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], []).append((r["recall_rank"], r["row_id"]))
        for qid, category, q in q_rows:
            scored = []
            for cid, other, c in c_rows:
                if other == category:
                    a, b = np.array(q), np.array(c)
                    scored.append((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 9), cid))
            want = [(n + 1, cid) for n, (_, cid) in enumerate(sorted(scored)[:5])]
            assert sorted(got[qid]) == want


def test_hashed_vectors_are_unit_length(spark):
    df = spark.createDataFrame([(1, "refund refund login"), (2, ""), (3, "重复扣费 refund")], "id bigint, t string")
    rows = {r["id"]: r["embedding"] for r in rt.hashed_vectors(df, "id", "t", 32).collect()}
    assert all(len(v) == 32 for v in rows.values()) and not any(rows[2])
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-4 and abs(sum(x * x for x in rows[3]) - 1) < 1e-4


def test_retrieve_prefers_the_right_document(spark):
    chunks = spark.createDataFrame(
        [
            ("c1", "Login help", "login.md#chunk-1", "Reset your password with the newest reset link.", "technical", "indexed"),
            ("c2", "Service", "sla.md#chunk-1", "Response time table of the service desk.", "technical", "indexed"),
            ("c3", "Refunds", "refund.md#chunk-1", "A duplicate charge is refunded after a check.", "refund", "indexed"),
            ("c4", "Login help", "old.md#chunk-1", "Reset your password with the newest reset link.", "technical", "failed"),
        ],
        "chunk_id string, title string, source string, content string, category string, status string",
    )
    queries = spark.createDataFrame(
        [("q1", "My password reset link does not work", "technical"), ("q2", "duplicate charge", "other"), ("q3", "password reset", "billing")],
        "query_id string, text string, category string",
    )
    chunks = chunks.join(rt.hashed_vectors(chunks, "chunk_id", "content"), "chunk_id")
    queries = queries.join(rt.hashed_vectors(queries, "query_id", "text"), "query_id")
    hits = rt.retrieve(queries, chunks, limit=2)
    best = {r["query_id"]: r for r in hits.filter("hit_rank = 1").collect()}
    assert best["q1"]["row_id"] == "c1" and best["q1"]["category_score"] > 0.65
    assert best["q2"]["row_id"] == "c3" and best["q2"]["category_score"] == 0.0
    assert best["q3"]["row_id"] == "c1", "without rows of its category a query looks everywhere"
    assert hits.filter("row_id = 'c4'").count() == 0
    nested = {r["query_id"]: r["knowledge_hits"] for r in rt.nest_hits(hits).collect()}
    # the service table shares no term and no token with q1: 0.65 * 0.18 is below the minimum score
    assert [h["row_id"] for h in nested["q1"]] == ["c1"]
    assert all([h["hit_rank"] for h in hit_list] == list(range(1, len(hit_list) + 1)) for hit_list in nested.values())


def test_vector_repair_touches_only_wrong_lengths(spark):
    df = spark.createDataFrame([(1, "some text", [1.0] * 16), (2, "some text", [1.0]), (3, "some text", None)],
                               "id bigint, t string, embedding array<double>")
    rows = {r["id"]: r["embedding"] for r in rt.repair_vectors(df, "id", "t", 16).collect()}
    assert rows[1] == [1.0] * 16 and rows[2] == rows[3] and len(rows[2]) == 16


def test_both_ways_of_recall_agree(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, [0.0] * 8, "a"), (901, [], "a")], "id bigint, embedding array<double>, g string")
    options = {"query_key": "id", "corpus_key": "id", "limit": 5, "group": "g", "exclude_self": True}
    sent = rt.vector_recall(df, df, **options).collect()
    blocks = rt.vector_recall(df, df, **options, sent_queries=10, block_rows=40).collect()
    assert sorted(sent) == sorted(blocks) and len(sent) == 301 * 5


def test_block_matcher_is_the_plain_ranking():
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(90, 4)), 0)  # many ties, some zero vectors
    vectors[5, 1] = np.nan
    ids = rng.permutation(90)
    ids[7] = ids[8]  # a repeated id leaves out both of its rows
    queries, corpus = (pd.DataFrame({name: ids, "vector": list(vectors)}) for name in ("query_id", "row_id"))
    for limit in (1, 5, 200):
        got = rt._block_matcher(limit, True)(queries, corpus)
        by_row = got.groupby("query_id").size()
        assert by_row.drop(ids[7]).eq(min(limit, 89)).all() and by_row[ids[7]] == 2 * min(limit, 88)
        for query_id in set(ids.tolist()) - {ids[7]}:
            own = vectors[ids == query_id][0]
            scale = np.linalg.norm(own) * np.linalg.norm(vectors, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.round(np.where(scale > 0, vectors @ own / scale, 0.0), 9) + 0.0
            plain = sorted(((-s, i) for s, i in zip(np.nan_to_num(scores, nan=-9).tolist(), ids.tolist()) if i != query_id))[:limit]
            mine = got[got["query_id"] == query_id]
            assert mine["row_id"].tolist() == [i for _, i in plain]


def test_scores_are_made_for_few_queries_at_a_time(monkeypatch):
    vectors = list(np.random.default_rng(4).normal(size=(50, 8)))
    sides = [pd.DataFrame({name: range(50), "vector": vectors}) for name in ("query_id", "row_id")]
    whole = rt._block_matcher(3, True)(*sides).reset_index(drop=True)
    shapes, divide = [], np.round
    monkeypatch.setattr(rt, "SCORED_PAIRS", 200)
    monkeypatch.setattr(np, "round", lambda scores, digits: shapes.append(scores.shape) or divide(scores, digits))
    assert rt._block_matcher(3, True)(*sides).reset_index(drop=True).equals(whole)
    assert len(shapes) == 13 and max(shapes) == (4, 50)


def test_repair_hashes_texts_before_any_join(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "c"), (2, "d e"), (3, None), (4, "f"), (None, "g")], "id long, t string")
    stored = spark.createDataFrame([(1, [0.5]), (2, [1.0] * 16), (2, None), (4, [2.0] * 16), (4, [2.0] * 16)], "id long, embedding array<double>")

    def rows(df):
        return sorted(((r["id"], r["embedding"]) for r in df.collect()), key=repr)

    joined = rt.repair_vectors(texts.join(stored, "id", "left"), "id", "t", 16)
    apart = rt.repair_vectors(texts.select("id").join(stored, "id", "left"), "id", "t", 16, texts=texts)
    assert rows(apart) == rows(joined)
    plan = apart._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(n for n, line in enumerate(plan) if "Generate" in line)
    depth = plan[at].index("Generate")
    below = [line for line in plan[at + 1 :] if len(line) - len(line.lstrip(" :+-")) > depth]
    assert below and not any("Join" in line for line in below)


def test_few_pairs_are_scored_twice_and_the_best_are_among_them():
    rng = np.random.default_rng(3)
    left, right = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(90, 24)), rng.normal(size=(3000, 24))))
    rows, columns = rt._candidates(left.astype(np.float32), right.astype(np.float32), 8)
    assert len(rows) < 2 * 8 * len(left)
    found = set(zip(rows.tolist(), columns.tolist(), strict=True))
    for i, scores in enumerate(left @ right.T):
        assert {(i, int(j)) for j in np.argsort(-scores)[:8]} <= found


def test_block_matcher_equals_a_plain_ranking():
    rng = np.random.default_rng(4)
    for kind in ("plain", "copies", "all copies", "zeros", "tiny", "repeated ids"):
        v, ids = rng.normal(size=(700, 12)), rng.permutation(700)
        if kind in ("copies", "all copies"):
            v[: 200 if kind == "copies" else 700] = v[0]
        v[5:9] *= {"zeros": 0.0, "tiny": 1e-170}.get(kind, 1.0)
        ids = ids // 3 if kind == "repeated ids" else ids
        for limit, itself in ((1, True), (8, True), (8, False), (900, True)):
            got = rt._block_matcher(limit, itself)(
                pd.DataFrame({"query_id": ids[:60], "vector": list(v[:60])}), pd.DataFrame({"row_id": ids, "vector": list(v)})
            )
            want = []
            for q in range(60):
                scale = np.linalg.norm(v[q]) * np.linalg.norm(v, axis=1)
                scores = np.where(scale > 0, v @ v[q] / np.where(scale > 0, scale, 1), 0).round(9) + 0.0
                ranked = sorted((-scores[j], ids[j]) for j in range(700) if not (itself and ids[j] == ids[q]))
                want += [(ids[q], i, -s) for s, i in ranked[:limit]]
            got = sorted(zip(got["query_id"], got["row_id"], got["similarity"], strict=True))
            assert len(got) == len(want)
            for a, b in zip(got, sorted(want), strict=True):
                assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-9, kind
