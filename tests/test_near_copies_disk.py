"""What the near-copy joins keep and shuffle: texts, not eight bytes for each of their shingles."""

from __future__ import annotations

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest

from postroom.llm import jaccard_join
from postroom.operators import dedup as dd


def stored_bytes(spark) -> int:
    found = spark.sparkContext.getCheckpointDir()
    return sum(p.stat().st_size for p in Path(urlparse(found).path).rglob("*") if p.is_file()) if found else 0


@pytest.mark.parametrize("threshold", [(92, 100), (7, 10)])
def test_near_copies_are_verified_without_stored_shingles(spark, threshold):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    rows = [(i, f"{base[:-50]}{i:050d}") for i in range(30)]
    docs = spark.createDataFrame(rows, "id long, t string")
    before = stored_bytes(spark)
    got = {r["id"]: r["similar_id"] for r in dd.similar_bodies(docs, key="id", text="t", threshold=threshold).collect()}
    assert got == dict.fromkeys(range(1, 30), 0)
    assert stored_bytes(spark) - before < 4 * sum(len(t) for _, t in rows)


def test_only_ranked_shingles_are_counted(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000))) for i in range(20)]
    bodies = dd._bodies(spark.createDataFrame(rows, "id long, t string"), "id", "t", 12, (92, 100))
    assert all(0.08 < r["n_ranked"] / r["n"] < 0.24 for r in bodies.collect())


def test_pairs_are_verified_from_their_texts(spark):
    words = [f"w{i}" for i in range(102)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-3], "x", "y", "z"]), 3: " ".join([*words[:-30], *("v" * 30)]), 4: " ".join(words)}
    table = spark.createDataFrame([(10 * k, t) for k, t in texts.items()], "print long, text string")
    pairs = spark.createDataFrame([(1, 2, 10, 20), (1, 3, 10, 30), (1, 4, 10, 40)], "a long, b long, pa long, pb long")
    for percent in (94, 95):
        got = sorted(map(tuple, jaccard_join.verified(pairs, table, percent, 3).collect()))
        # 100 windows of three words each, 97 of them shared by 1 and 2: 97 of 103
        assert got == ([(1, 2), (1, 4)] if 9700 >= percent * 103 else [(1, 4)])
