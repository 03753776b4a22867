"""Approximate forms against the exact ones: near duplicates by signatures, recall by inverted lists."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postroom.operators import dedup, retrieval


def families(rng, families_n, copies):
    """Texts of 60 words; copies with two words changed, some far ones, and a line that all of them hold."""
    rows, number = [], 0
    for f in range(families_n):
        base = [f"word{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(5000)}"
            rows.append((number, "licensed under the common terms " + " ".join(words)))
            number += 1
    return rows


def test_signatures_find_what_the_exact_mode_finds(spark):
    rng = random.Random(2)
    rows = families(rng, 30, 6) + [(1000, None), (1001, ""), (1002, "ab"), (1003, "abc"), (1004, "short text here"), (1005, "short text here!")]
    docs = spark.createDataFrame(rows, "id long, text string")
    exact = {r["id"]: r for r in dedup.similar_bodies(docs, key="id", text="text", threshold=(7, 10)).collect()}
    fast = {r["id"]: r for r in dedup.similar_bodies_approximate(docs, key="id", text="text", threshold=(7, 10)).collect()}
    assert len(exact) > 100 and set(fast) <= set(exact) and len(fast) >= 0.9 * len(exact)
    assert all(fast[i]["similar_id"] < i and fast[i]["similarity"] >= 0.7 for i in fast)
    assert dedup.similar_bodies_approximate(docs.limit(0), key="id", text="text").count() == 0
    merged = dedup.near_duplicates(docs, key="id", text="text", threshold=(7, 10), approximate=True)
    assert merged.count() == len(rows) - 1  # as in the exact mode, a null text has no body to compare


def test_keys_per_body_are_bounded_whatever_the_family(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame(families(rng, 1, 400), "id long, text string")
    bodies = dedup._bodies(docs, "id", "text", 12)
    keys = dedup._band_keys(bodies, 12, 32, 4)
    assert keys.groupBy("id").count().agg(F.max("count")).first()[0] == 32
    found = dedup.similar_bodies_approximate(docs, key="id", text="text", threshold=(7, 10))
    assert found.count() >= 0.9 * (bodies.count() - 1)


def test_signature_equals_a_plain_one(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog " * 3), (2, "tiny"), (3, "exactly 12 c")], "id long, text string")
    bodies = dedup._bodies(docs, "id", "text", 12)
    hashes = {r["id"]: r["s"] for r in bodies.select("id", dedup._shingles(F.col("body"), 12).alias("s")).collect()}
    with pytest.raises(ValueError):
        dedup._band_keys(bodies, 12, 3, 4)
    rows = {}
    for r in dedup._band_keys(bodies, 12, 4, 2).collect():
        rows.setdefault(r["id"], []).append(r["token"])
    for key, values in hashes.items():
        least = {}
        for v in values:
            least[(v >> 61) + 4] = min(v, least.get((v >> 61) + 4, v))
        signature = []
        for place in range(8):
            at = next((b for b in range(place, 8) if b in least), min(least))
            signature.append(least[at])
        wanted = spark.createDataFrame([(b, signature[2 * b : 2 * b + 2]) for b in range(4)], "b int, s array<long>").select(F.xxhash64("b", "s")).collect()
        assert rows[key] == [w[0] for w in wanted]


def test_lists_recall_nine_in_ten_on_clusters(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(24, 16))
    vectors = [(i, (middles[i % 24] + 0.25 * rng.normal(size=16)).tolist(), f"g{i % 2}") for i in range(1200)]
    odd = [(5000, [0.0] * 16, "g0"), (5001, [1.0, 2.0], "g0"), (5002, None, "g1"), (5003, [], None)]
    rows = spark.createDataFrame([*vectors, *odd], "id long, embedding array<double>, kind string").repartition(4)
    asked = rows.filter("id % 100 = 0")
    names = {"query_key": "id", "corpus_key": "id", "limit": 10, "exclude_self": True}
    centers = retrieval.learn_lists(rows, lists=24)
    assert centers.shape == (24, 16)

    def hits(df):
        return {(r["query_id"], r["row_id"]) for r in df.collect()}

    exact = hits(retrieval.vector_recall(asked.filter("id < 5000"), rows, **names))
    few = hits(retrieval.indexed_recall(asked.filter("id < 5000"), rows, centers, probes=4, **names))
    assert len(exact & few) >= 0.9 * len(exact)
    # all lists: the same rows, sent or in blocks, also per group
    whole = retrieval.vector_recall(asked, rows, group="kind", **names)
    for sent, block in ((5000, 4096), (0, 64)):
        every = retrieval.indexed_recall(asked, rows, centers, probes=24, group="kind", sent_queries=sent, block_rows=block, **names)
        assert hits(every) == hits(whole)
    stored = retrieval.with_lists(rows, centers, name="_near").withColumn("_list", F.get("_near", F.lit(0)))
    assert stored.groupBy("id").count().filter("count > 1").isEmpty() and stored.filter("_list IS NULL").isEmpty()
    assert hits(retrieval.indexed_recall(asked.filter("id < 5000"), stored, centers, probes=4, **names)) == few
    empty = rows.limit(0)
    assert retrieval.indexed_recall(asked, empty, retrieval.learn_lists(empty, lists=4), probes=2, **names).count() == 0
