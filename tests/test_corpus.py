from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postroom.functions.lexicon import PREPROCESS_FLAGS  # noqa: F401
from postroom.operators import corpus as cp
from postroom.operators import dedup as dd


def test_sections_follow_headings(spark):
    text = "intro\n\n# One\n\na\n\nb\n\n# Empty\n\n# Two\n\nNotes:\n\nc"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [(s["section_title"], s["blocks"]) for s in cp.with_sections(df, "t").collect()[0]["sections"]]
    assert got == [("", ["intro"]), ("One", ["a", "b"]), ("Notes", ["Notes:", "c"])]


def _pack(pieces, limit, overlap):
    """Brute force of greedy packing for single-line pieces no longer than the limit."""
    chunks, now = [], ""
    for piece in pieces:
        if now and len(now) + 1 + len(piece) > limit:
            chunks.append(now)
            tail = ""
            if len(now) > overlap:
                tail = now[-overlap:].strip()
                tail = tail[max(tail.rfind("."), tail.rfind("。")) + 1:].strip()
            joined = f"{tail} {piece}" if tail else piece
            now = joined if len(joined) <= limit else piece
        else:
            now = f"{now} {piece}" if now else piece
    return chunks + [now] if now else chunks


@pytest.mark.parametrize("limit,overlap", [(60, 20), (100, 30), (25, 10)])
def test_packing_equals_brute_force(spark, limit, overlap):
    rng = random.Random(limit)
    rows = []
    for i in range(30):
        pieces = [
            " ".join("abcdefgh"[: rng.randint(1, 8)] for _ in range(rng.randint(1, 3)))[: limit] + rng.choice(["", "."])
            for _ in range(rng.randint(1, 25))
        ]
        rows.append((i, [p[:limit].strip() for p in pieces]))
    df = spark.createDataFrame(rows, "id int, p array<string>")
    got = {r["id"]: r["c"] for r in df.select("id", cp.pack_pieces(F.col("p"), limit, overlap).alias("c")).collect()}
    for i, pieces in rows:
        assert got[i] == _pack(pieces, limit, overlap)


def test_chunks_cover_the_text_and_respect_the_limit(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "refund", "login", "epsilon"]

    def paragraph():
        return " ".join(
            " ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) + "." for _ in range(rng.randint(1, 30))
        )

    docs = [(i, "\n\n".join(["# Part"] + [paragraph() for _ in range(5)] + ["x" * rng.randint(1, 2500)])) for i in range(8)]
    df = spark.createDataFrame(docs, "id int, t string").withColumns({"title": F.lit("T"), "source": F.lit("s.md")})
    rows = cp.chunk_documents(df, key="id", text="t", title="title", source="source", overlap_chars=0).collect()
    for i, text in docs:
        mine = sorted((r for r in rows if r["id"] == i), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert all(0 < len(r["content"]) <= 900 for r in mine)
        assert all(r["section_title"] == "Part" for r in mine)
        assert mine[0]["chunk_source"] == "s.md#chunk-1"
        squeezed = "".join("".join(r["content"].split()) for r in mine)
        assert squeezed == "".join(text.removeprefix("# Part").split())


def _brute(rows, numerator, denominator, size=12):
    def key(text):
        return "".join(c for c in text.lower() if c.isalnum() or c == "_")

    def shingles(k):
        return {k} if len(k) <= size else {k[i:i + size] for i in range(len(k) - size + 1)}

    first = {}
    for i, text in sorted(rows):
        first.setdefault(key(text), i)
    bodies = sorted((i, k) for k, i in first.items() if k)
    hits = {}
    for n, (i, k) in enumerate(bodies):
        for j, m in bodies[:n]:
            low, high = sorted((k, m), key=len)
            if low in high:
                top, bottom = len(low), len(high)
            else:
                a, b = shingles(k), shingles(m)
                top, bottom = len(a & b), len(a | b)
            if top * denominator >= bottom * numerator:
                hits[i] = (j, round(top / bottom, 9))
                break
    return {i: (first[key(t)], *hits.get(first[key(t)], (None, None))) for i, t in rows}


@pytest.mark.parametrize("threshold", [(92, 100), (7, 10), (55, 100)])
def test_near_duplicates_equal_brute_force(spark, threshold):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(30, 160))) for _ in range(12)]
    boiler = "this licence text stands in very many of the documents here. "
    rows = []
    for i in range(120):
        text = rng.choice(base) if i % 3 else base[0]
        cut = list(text)
        for _ in range(rng.randint(0, 3)):
            cut[rng.randrange(len(cut))] = rng.choice("xyz")
        text = "".join(cut)
        kind = i % 7
        text = boiler + text if kind == 0 else text[: -rng.randint(1, 9)] if kind == 1 else text
        rows.append((i, text))
    rows += [(200, "abc"), (201, "abcd"), (202, "a b c"), (203, ""), (204, "abcdefghij"), (205, "abcdefghijkl"), (206, "xabcdefghijk"),
             (207, "bcdefghijklmn"), (208, "z" * 60), (209, "z" * 40)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    got = {
        r["id"]: (r["first_id"], r["similar_id"], None if r["similarity"] is None else round(r["similarity"], 9))
        for r in dd.near_duplicates(df, key="id", text="t", threshold=threshold).collect()
    }
    assert got == _brute(rows, *threshold)


def test_precheck_decisions(spark):
    rows = [
        (1, "The refund policy of this company is described in this text at length.", "Refund policy", "a/refund.md"),
        (2, "The refund policy of this company is described in this text at length.", "Other", "b/other.md"),
        (3, "The refund policy of this company is described in this text at length!!", "Third", "b/third.md"),
        (4, "Entirely different words stand here, and nothing is shared with the rest.", "Unrelated", "c/Refund.txt"),
        (5, "Yet another body without any overlap to what was written earlier on.", "The Refund Policy, 2nd", "d/new.md"),
        (6, "Something fresh: an onboarding guide for new members of the team.", "Guide", "d/guide.md"),
    ]
    df = spark.createDataFrame(rows, "id bigint, t string, title string, source string")
    got = {r["id"]: (r["decision"], r["reason"]) for r in dd.precheck(df, key="id", text="t", title="title", source="source").collect()}
    assert got == {
        1: ("accept", ""), 2: ("reject", "content_hash"), 3: ("confirm", "content_similarity"),
        4: ("confirm", "same_filename"), 5: ("confirm", "similar_title"), 6: ("accept", ""),
    }
