"""Shingles of whole batches, and how few pairs of bodies are compared."""

from __future__ import annotations

import random

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from postroom.functions import shingles as sh
from postroom.operators import dedup as dd


def test_hashes_are_those_of_spark(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé一ñ1") for _ in range(n)) for n in (1, 5, 11, 12, 13, 40, 300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, body string")
    for size in (3, 12, 30):
        wanted = {r["i"]: sorted(r["s"]) for r in rows.select("i", dd._shingles(F.col("body"), size).alias("s")).collect()}
        assert {i: s.tolist() for i, s in enumerate(sh.shingle_hashes(texts, size))} == wanted
    beyond = "a𠀀b𠀁c𠀂d"  # a character beyond 16 bits is one, as in SQL
    assert {v & 0xFFFFFFFFFFFFFFFF for v in sh.shingle_hashes([beyond], 3)[0].tolist()} == {
        xxhash.xxh64_intdigest(beyond[i : i + 3].encode(), 42) for i in range(5)
    }
    longs = sh.distinct(sh.shingle_hashes(texts, 12)[-1])
    ranked = spark.createDataFrame([(int(v),) for v in longs], "t long").filter(dd._ranked(F.col("t"), 7, 10)).count()
    assert dd._ranked_of(longs, 7, 10) == ranked


def test_pieces_are_bounded_and_whole():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 900, 1, 1, 1, 2000, 3)])], names=["t"])
    parts = list(sh.pieces(batch, "t", rows=3, size=1000))
    assert [r for p in parts for r in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or sum(map(len, p.column("t").to_pylist())) <= 1000) for p in parts)


def test_texts_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = word(60)
    rows = [(i, passage + word(7) * 90) for i in range(40)]
    rows += [(100, rows[7][1] + rows[7][1][-7:]), (101, passage)]
    compared = []

    def counted(pairs, *rest, verify=dd._verified):
        compared.append(pairs.distinct().count())
        return verify(pairs, *rest)

    monkeypatch.setattr(dd, "_verified", counted)
    docs = spark.createDataFrame(rows, "id long, t string")
    found = {r["id"]: r["similar_id"] for r in dd.similar_bodies(docs, key="id", text="t", threshold=(7, 10)).collect()}
    assert found == {100: 7}
    assert sum(compared) < 60  # 780 pairs share the passage; 40 are of the passage itself
