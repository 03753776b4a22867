"""Neighbours, forms and roots against a plain search."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from postroom.llm import spelling_variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def gaps(word):
    return {word[:i] + "*" + word[i + 1 :] for i in range(len(word))}, {word[:i] + word[i + 1 :] for i in range(len(word))}


def plain(docs, spoil=True):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoil and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    met = {}
    for w in counts:
        changed, shorter = gaps(w)
        for k in changed:
            met.setdefault(k, set()).add(w)
        for k in shorter:
            if k in counts:
                met.setdefault((k, "+"), set()).update((k, w))
    near = {w: set() for w in counts}
    for ws in met.values():
        for a in ws:
            near[a].update(b for b in ws if one_apart(a, b))
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda b: (-counts[b], b), default=None)
        if best and counts[best] >= 10 * counts[w]:
            form[w] = best
    rows = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return rows


def test_neighbours_equal_a_plain_search(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(500)}
    words |= {"x" * n for n in (1, 2, 3, 9, 10, 300, 301)} | {"y" * 3000, "y" * 1500 + "z" + "y" * 1499, "y" * 2999}
    words = sorted(words)
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    pairs = spelling_variants.neighbours(df).distinct().collect()
    got = {(words[r["a"]], words[r["b"]]) for r in pairs}
    assert len(got) == len(pairs)
    assert got == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_rows_equal_plain_ones(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 10))) for _ in range(12)]
    docs = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(1, 60)):
            w = rng.choice(base[: rng.choice([2, 12])])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "z", w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 and "é" not in w else w)
        docs.append((i, rng.choice([" ", "-", "1"]).join(words)))
    docs += [(None, "Variant variant VARIANT variants"), (None, None), (5, ""), (6, "q" * 2000 + " " + "q" * 2000), (6, "q" * 1999 + " " + "q" * 1999), (7, "ÀÖ×÷ÿÀÖ× ÀÖ×÷ÿÀÖ×")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = spelling_variants.group_variants(df, spoil=True).collect()
    assert {tuple(r) for r in got} == plain(docs) and len(got) == len({r["word"] for r in got})
    assert sum(r["form"] is not None for r in got) > 20 and any(r["root"] not in (r["word"], r["form"]) for r in got)
    assert spelling_variants.group_variants(df.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    steps = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w11"), ("b", "a")]
    got = {r["word"]: r["root"] for r in spelling_variants.roots(spark.createDataFrame(steps, "word string, form string")).collect()}
    assert got == {w: "w11" for w, _ in steps}


def test_query_equals_plain_rows(spark):
    from postroom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in QUERIES["op12_spelling_variants"](spark, folder).collect()} == plain(docs)
