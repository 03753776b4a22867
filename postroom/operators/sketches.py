"""Approximate percentiles that merge: quantile sketches per key and day, kept as a column.

A sketch is some kilobytes whatever the number of values, so a day's sketches are stored once and any range of days is
answered by merging them; no value is read again and none is sorted. The exact form is ``sequence.nearest_rank``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values a sketch keeps at its top level. The rank of an answer is off by about 2.6 / SKETCH_SIZE of all values at most (99 %).
SKETCH_SIZE = 400


def sketch_values(df: DataFrame, key: Sequence[str], value: Column, size: int = SKETCH_SIZE) -> DataFrame:
    """``key, sketch``: one sketch per key, of its values that are neither null nor NaN; keys without any have no row."""
    wanted = df.select(*key, value.cast("double").alias("_value")).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    return wanted.groupBy(*key).agg(F.kll_sketch_agg_double("_value", F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, key: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """``key, sketch`` over all rows of a coarser key; partial merges run before the shuffle."""
    return sketches.groupBy(*key).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, key: Sequence[str], ratios: Mapping[str, float]) -> DataFrame:
    """``key, n`` and one column per named ratio."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(ratio)).alias(name) for name, ratio in ratios.items()]
    return sketches.select(*key, F.kll_sketch_get_n_double("sketch").alias("n"), *found)


def rank_errors(
    df: DataFrame, quantiles: DataFrame, key: Sequence[str], value: Column, ratios: Mapping[str, float]
) -> DataFrame:
    """``key, n, <name>_error``: how far, as a share of all values, each answer lies from where it should be.

    0 where the wanted rank is among those of the answer. One pass over the values, against one row per key.
    """
    met = df.select(*key, value.cast("double").alias("_value")).join(quantiles.drop("n"), list(key))
    met = met.filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    counts = [c for name in ratios for c in (
        F.count_if(F.col("_value") < F.col(name)).alias(f"_{name}_below"), F.count_if(F.col("_value") <= F.col(name)).alias(f"_{name}_upto"),
    )]
    counted = met.groupBy(*key).agg(F.count("*").alias("n"), *counts)
    errors = [
        F.greatest(F.col(f"_{name}_below") / F.col("n") - ratio, ratio - F.col(f"_{name}_upto") / F.col("n"), F.lit(0.0)).alias(f"{name}_error")
        for name, ratio in ratios.items()
    ]
    return counted.select(*key, "n", *errors)
