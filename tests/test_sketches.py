"""Mergeable percentiles, and the usage job run again and again."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postroom.operators import sketches as sk
from postroom.streaming import jobs

RATIOS = {"low": 0.01, "half": 0.5, "high": 0.99}


def test_merged_sketches_stay_close_to_exact_ranks(spark):
    rng = random.Random(7)
    rows = [("hot", i % 9, rng.lognormvariate(0, 3)) for i in range(30_000)] + [("few", 0, float(v)) for v in (3, 1, 2)]
    rows += [("one", 0, 5.0)] * 50 + [("none", 0, None), ("none", 1, float("nan")), (None, 0, 4.0), ("few", 1, None)]
    df = spark.createDataFrame(rows, "k string, day int, v double")
    daily = sk.sketch_values(df, ["k", "day"], F.col("v"))
    merged = sk.merge_sketches(daily, ["k"])
    found = {r["k"]: r.asDict() for r in sk.sketched_quantiles(merged, ["k"], RATIOS).collect()}
    assert set(found) == {"hot", "few", "one", None}
    assert {k: r["n"] for k, r in found.items()} == {"hot": 30_000, "few": 3, "one": 50, None: 1}
    assert (found["one"]["low"], found["one"]["high"], found["few"]["half"], found[None]["half"]) == (5.0, 5.0, 2.0, 4.0)
    values = sorted(v for k, _, v in rows if k == "hot")
    for name, ratio in RATIOS.items():
        at = sum(v <= found["hot"][name] for v in values) / len(values)
        assert abs(at - ratio) <= 0.02
    errors = sk.rank_errors(df, sk.sketched_quantiles(merged, ["k"], RATIOS), ["k"], F.col("v"), RATIOS).collect()
    assert {r["k"]: r["n"] for r in errors} == {"hot": 30_000, "few": 3, "one": 50}  # a null key joins nothing
    assert all(r[f"{name}_error"] <= 0.02 for r in errors for name in RATIOS)
    assert sk.merge_sketches(daily.limit(0), ["k"]).count() == 0


def test_closed_days_are_written_once_and_late_rows_left_out(spark):
    start = datetime(2024, 1, 1, 12)

    def arrived(*days):
        rows = [(start + timedelta(days=d), "a", 1, 2) for d in days]
        return spark.createDataFrame(rows, "ts timestamp_ntz, k string, input_tokens long, output_tokens long")

    runs = [arrived(0, 1, 3), arrived(0, 1, 2, 4), arrived(), arrived(3, 3, 8), arrived(4)]
    got = jobs.drain_runs(runs, "test", lambda s: jobs.daily_usage(s, "ts", "1 day", ["k"])).collect()
    # After the first run the watermark is noon of day 2: days 0 and 1 are closed. After the second, noon of day 3: day 2 is.
    assert sorted((r["day"].day - 1, r["messages"]) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 1)]
