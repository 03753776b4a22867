"""Ordered per-key operators that survive hot keys.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here a
key's timeline is cut into *stretches* by a monotone expression of the order
columns (a day, a value range). Windows run inside one stretch; what crosses a
stretch border travels through a summary with one row per (key, stretch).

Operators that follow one another keep the stretch column (``keep_stretch``): the
rows are then already where the next windows need them and are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = "_stretch"


def _stretched(df: DataFrame, key: Sequence[str], order: Sequence[str], stretch: Column):
    cut = df if STRETCH in df.columns else df.withColumn(STRETCH, stretch)
    inside = Window.partitionBy(*key, "_stretch").orderBy(*order)
    across = Window.partitionBy(*key).orderBy("_stretch")
    return cut, inside, across


def with_previous(
    df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, stretch: Column, name: str,
    keep_stretch: bool = False,
) -> DataFrame:
    """Add ``name``: ``value`` of the row before, over the whole key, null on its first row."""
    cut, inside, across = _stretched(df, key, order, stretch)
    local = (
        cut.withColumn("_value", value)
        .withColumn("_before", F.lag("_value").over(inside))
        .withColumn("_nth", F.row_number().over(inside))
    )
    carried = (
        cut.withColumn("_value", value)
        .groupBy(*key, "_stretch")
        .agg(F.max_by("_value", F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .drop("_last")
    )
    joined = (
        local.join(carried, [*key, STRETCH], "left")
        .withColumn(name, F.when(F.col("_nth") == 1, F.col("_carry")).otherwise(F.col("_before")))
        .drop("_value", "_before", "_nth", "_carry")
    )
    return joined if keep_stretch else joined.drop(STRETCH)


def with_running_sum(
    df: DataFrame, key: Sequence[str], order: Sequence[str], amount: Column, stretch: Column, name: str
) -> DataFrame:
    """Add ``name``: sum of ``amount`` from the key's first row to this one."""
    cut, inside, across = _stretched(df, key, order, stretch)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.sum(amount).over(upto))
    carried = (
        cut.groupBy(*key, "_stretch")
        .agg(F.sum(amount).alias("_total"))
        .withColumn("_carry", F.sum("_total").over(earlier))
        .drop("_total")
    )
    return (
        local.join(carried, [*key, "_stretch"], "left")
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_local", "_carry", "_stretch")
    )


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], stretch: Column, name: str) -> DataFrame:
    """Add ``name``: position of the row within its key, from 1."""
    return with_running_sum(df, key, order, F.lit(1).cast("long"), stretch, name)


def keep_changes(
    df: DataFrame, key: Sequence[str], order: Sequence[str], compared: Sequence[str], stretch: Column,
    keep_stretch: bool = False,
) -> DataFrame:
    """Drop rows equal to their predecessor on the ``compared`` columns."""
    state = F.struct(*compared)
    paired = with_previous(df, key, order, state, stretch, "_previous", keep_stretch)
    changed = F.col("_previous").isNull() | ~F.col("_previous").eqNullSafe(state)
    return paired.filter(changed).drop("_previous")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. ``max_by`` combines on the map side, so a hot key stays small."""
    rest = [name for name in df.columns if name not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*key, *[F.col("_row")[name].alias(name) for name in rest])
    )


def newest(df: DataFrame, key: Sequence[str], order: Sequence[Column], count: int, rank: str = "_rank") -> DataFrame:
    """First ``count`` rows per key in the given order; the limit runs before the shuffle too."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(
        F.col(rank) <= count
    )


def nearest_rank(
    df: DataFrame, key: Sequence[str], value: str, ratio: float, stretch: Column, name: str = "percentile"
) -> DataFrame:
    """Exact nearest-rank percentile per key, at index ``round_half_even((n - 1) * ratio)``.

    Equal values are counted first; positions come from running counts over value
    ranges, so no task sorts a whole key.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    placed = with_running_sum(counts, key, [value], F.col("_n"), stretch, "_upto")
    totals = df.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.count("*").alias("_all"))
    target = F.bround((F.col("_all") - 1) * F.lit(ratio), 0).cast("long") + 1
    hit = (F.col("_upto") >= target) & (F.col("_upto") - F.col("_n") < target)
    return placed.join(totals, list(key)).filter(hit).select(*key, F.col(value).alias(name), F.col("_all").alias("n"))
