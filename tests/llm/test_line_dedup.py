"""Common lines against a plain count, on odd tables, and the runs batch by batch."""

from __future__ import annotations

import hashlib
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postroom.llm import line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(texts, least_docs=10, least_chars=1):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    lines = [(t or "").split("\n") for t in texts]
    found = Counter(k for ls in lines for k in {key(x) for x in ls} if len(k) >= least_chars)
    rows = []
    for ls in lines:
        kept = [x for x in ls if found[key(x)] < least_docs or len(key(x)) < least_chars]
        rows.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return rows


def texts_of(rng, n):
    pool = [f"Line {i} ÄÖ É" for i in range(40)] + ["", "  ", "\tAll Rights Reserved\r", "all rights reserved", "ÉTÉ", "été", "x" * 5000]
    texts = ["\n".join(rng.choice(pool[: rng.choice([5, 20, len(pool)])]) + rng.choice(["", " ", f" {rng.randrange(9)}"])
                       for _ in range(rng.choice([1, 3, 12]))) for _ in range(n)]
    return [*texts, None, "", "\n", "\n\n", "a\x0bb", "same\nsame\nsame", "Line 1 ÄÖ É\n" * 3000]


@pytest.mark.parametrize("sent_bytes", [line_dedup.SENT_BYTES, 0])
def test_equals_a_plain_count(spark, sent_bytes):
    texts = texts_of(random.Random(sent_bytes), 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(docs, sent_bytes=sent_bytes, batches=5).collect()}
    wanted = plain(texts)
    assert [(got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) for i in range(len(texts))] == wanted
    assert sum(w[1] for w in wanted) > 500 and got[len(texts) - 1]["n_dropped"] == 3000


def test_odd_rows_and_names(spark):
    schema = "doc_id long, text string, n_lines string, _one int, _batch int, hashes int, h int"
    rows = [(i, "Shared\nown " + str(i), "x", 1, 2, 3, 4) for i in range(9)]
    rows += [(3, "shared ", None, None, None, None, None)] * 2 + [(None, None, None, None, None, None, None), (None, "SHARED\nx", "x", 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    out = line_dedup.drop_common_lines(docs)
    assert out.columns == ["doc_id", "text", "_one", "_batch", "hashes", "h", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=repr)
    wanted = [(r[0], *(lambda w: (w[2], w[0], w[1]))(w)) for r, w in zip(rows, plain([r[1] for r in rows]), strict=True)]
    assert got == sorted(wanted, key=repr)
    empty = line_dedup.drop_common_lines(docs.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_rare_keys_and_short_keys_stay(spark):
    docs = spark.createDataFrame([(i, f"ab\nabc\n{i}") for i in range(3)], "doc_id long, text string")
    rows = line_dedup.drop_common_lines(docs, least_docs=3, least_chars=3).collect()
    assert {r["text"] for r in rows} == {f"ab\n{i}" for i in range(3)}
    assert line_dedup.drop_common_lines(docs, least_docs=4).agg(F.sum("n_dropped")).first()[0] == 0


def test_runs_merge_level_by_level_and_leave_out_known_keys(spark):
    runs = line_dedup.LineRuns(spark, 4, least_docs=3)
    rng, counts = random.Random(5), Counter()
    for number in range(7):
        batch = [[rng.randrange(30) for _ in range(rng.randrange(4))] for _ in range(6)] + [[-1, -1, None]] * 3
        counts.update(h for hs in batch for h in set(hs) if h is not None)
        runs.add(spark.createDataFrame([(hs,) for hs in batch], "hashes array<long>"))
        common = {r["h"]: r["n"] for r in runs.common().collect()}
        assert set(common) == {h for h, n in counts.items() if n >= 3}
        assert common[-1] == 3  # counted in the first batch only, known after it
        assert sum(len(level) << k for k, level in enumerate(runs.levels)) == number + 1
        assert all(len(level) <= 2 for level in runs.levels)
    tables = [name for level in runs.levels for name in level]
    runs.close()
    assert not any(spark.catalog.tableExists(name) for name in tables)


def test_query_digest(spark):
    from pathlib import Path

    from postroom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = {(d["doc_id"], w[0], w[1], hashlib.sha256(w[2].encode()).hexdigest()) for d, w in zip(docs, plain([d["text"] for d in docs]), strict=True)}
    assert {tuple(r) for r in QUERIES["op11_line_dedup"](spark, folder).collect()} == wanted
