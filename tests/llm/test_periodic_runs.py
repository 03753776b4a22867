"""Runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from postroom.llm import periodic_runs


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def sequences(rng):
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 6])
        root = [rng.randrange(letters) for _ in range(rng.randrange(1, 14))]
        body = root * rng.randrange(1, 9)
        cut = body[rng.randrange(3) : len(body) - rng.randrange(3)]
        yield [rng.randrange(letters) for _ in range(rng.randrange(8))] + cut + [rng.randrange(letters) for _ in range(rng.randrange(8))]
    base = [0, 1]
    for _ in range(9):
        base = base + [1 - x for x in base]
    yield base  # overlap-free: no run at all
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    yield b
    yield [0] * 3000
    yield ([0] * 7 + [1]) * 5 + [0] * 40


def test_runs_equal_a_plain_search():
    docs = list(sequences(random.Random(3)))
    # one by one, and laid end to end
    letters, bounds = [], [0]
    for doc in docs:
        letters += [x + 10 * bounds[-1] for x in doc]
        bounds.append(len(letters))
    together = periodic_runs.runs_of(np.array(letters), np.array(bounds))
    for doc, runs in zip(docs, together, strict=True):
        assert runs == plain_runs(doc) == periodic_runs.runs_of(np.array(doc, np.int64), np.array([0, len(doc)]))[0]
    assert sum(map(len, together)) > 200


def test_successor_is_the_next_greater_value():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 65, 300):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletMatrix(values)
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + rng.integers(1, n + 1, 200))
        asked = rng.integers(0, n, 200)
        got = tree.successor(low, high, asked)
        for at, lo, hi, x in zip(got, low, high, asked, strict=True):
            above = [v for v in values[lo:hi] if v > x]
            assert at == (min(above) if above else -1)


def test_rows_equal_plain_ones(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a", "a " * 6, "a b " * 3000, "x\x0by\x1cz " * 9, "日本 " * 7, "la la la la la land of of of of of of"]
    texts += [" ".join(f"w{rng.randrange(rng.choice([2, 5, 300]))}" for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(4, "a " * 6, None, None)] * 2 + [(None, "b " * 20, None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, start int")
    got = periodic_runs.find_runs(docs, plant=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    ).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert sum(r["n_runs"] for r in got) > 20
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    plain = {r["doc_id"]: r["collapsed"] for r in periodic_runs.find_runs(docs).collect()}
    assert plain[8] == "la la la la la land of"  # five are no run yet


def test_portions_do_not_matter():
    docs = [(i, [f"w{i % 3}"] * (i + 5) + ["end"]) for i in range(30)]
    whole = list(periodic_runs.portion_rows(docs))
    assert whole == [row for doc in docs for row in periodic_runs.portion_rows([doc])]


def test_query_equals_plain_rows(spark):
    from pathlib import Path

    from postroom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    assert got == {plain_row(d["doc_id"], d["text"]) for d in docs}
