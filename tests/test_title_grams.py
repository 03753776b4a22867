"""Title lookup: same rows as comparing all titles, and grams that are shuffled as numbers."""

from __future__ import annotations

import random
import re

from postroom.operators import dedup as dd


def test_titles_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "invoice", "refund policy", "quarterly report of the team", "x1", "说明"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for i in range(60)]
    rows += [(3, "refund policy"), (None, "invoice"), (70, None), (71, "!!"), (72, "Refund, Policy")]
    found = dd.similar_titles(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    keyed = [(i, re.sub("[^0-9a-z一-鿿]+", "", (t or "").lower())) for i, t in rows]
    firsts = {}
    for i, k in keyed:
        if k and i is not None:
            firsts[k] = min(i, firsts.get(k, i))
    plain = []
    for i, k in keyed:
        near = [first for other, first in firsts.items() if k and (k in other or other in k)]
        if i is not None and near and min(near) < i:
            plain.append((i, min(near)))
    assert sorted(map(tuple, found.collect())) == sorted(plain)


def test_grams_are_numbers(spark):
    df = spark.createDataFrame([(1, "one title"), (2, "one title more")], "id long, t string")
    plan = dd.similar_titles(df, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    grams = [line for line in plan.splitlines() if "Generate explode" in line]
    assert grams and all(re.search(r"\[_gram#\d+L\]", line) for line in grams)
