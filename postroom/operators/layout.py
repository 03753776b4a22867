"""Reading order and quality of recognised pages, from a table of words.

A page's words and blocks are grouped by page, which a physical page bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.functions.scoring import safe_ratio
from postroom.functions.text import clean_line, join_words, readable_ratio, strip

# FIXED VALUES: page geometry and quality weights.
NARROW_SHARE = 0.58
CENTER_SLACK = 0.02
COLUMN_SLACK = 0.08
MINIMUM_BLOCKS = 4
MINIMUM_COLUMN_BLOCKS = 2
QUALITY_WEIGHTS = {"confidence": 0.55, "readability": 0.30, "structure": 0.15, "symbols": 0.20}
SUSPICIOUS = r"[�□■◆◇]|\\x[0-9a-fA-F]{2}"
SHORT_BLOCK_CHARS = 8


def usable_words(words: DataFrame) -> DataFrame:
    """Drop blank words and those without a confidence; confidence becomes 0-1."""
    return (
        words.withColumns({"text": clean_line(F.coalesce("text", F.lit(""))), "conf": F.col("conf").cast("double")})
        .filter((F.col("text") != "") & (F.coalesce("conf", F.lit(-1.0)) >= 0))
        .withColumn("conf", F.col("conf") / 100.0)
    )


def build_blocks(words: DataFrame, page: Sequence[str]) -> DataFrame:
    """Words to lines to blocks, with bounding box and area-weighted confidence."""
    area = F.greatest(F.lit(1), F.col("width") * F.col("height"))
    lines = words.groupBy(*page, "block", "par", "line").agg(
        join_words(
            F.transform(
                F.array_sort(F.collect_list(F.struct("left", "word", "text"))), lambda item: item["text"]
            )
        ).alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.sum(area).alias("area"),
        F.sum(F.col("conf") * area).alias("weighted"),
    )
    blocks = lines.groupBy(*page, "block", "par").agg(
        strip(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("top", "text")))),
                    lambda item: item["text"],
                ),
                "\n",
            )
        ).alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max("right").alias("right"),
        F.max("bottom").alias("bottom"),
        safe_ratio(F.sum("weighted"), F.sum("area")).alias("confidence"),
    )
    return blocks.filter(F.col("text") != "").withColumns(
        {
            "width": F.greatest(F.lit(1), F.col("right") - F.col("left")),
            "height": F.greatest(F.lit(1), F.col("bottom") - F.col("top")),
        }
    ).drop("right", "bottom")


def reading_order(blocks: DataFrame, page: Sequence[str]) -> DataFrame:
    """Add ``zone``, ``position``, ``multi_column`` and ``reordered``.

    With two columns the order is: above them, left, between, right, below.
    """
    whole = Window.partitionBy(*page)
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    sized = blocks.withColumns(
        {
            "_left": F.min("left").over(whole),
            "_width": F.greatest(F.lit(1), F.max(right).over(whole) - F.min("left").over(whole)),
            "_count": F.count("*").over(whole),
        }
    )
    center = F.col("_left") + F.col("_width") / 2
    middle = F.col("left") + F.col("width") / 2
    narrow = F.col("width") <= F.col("_width") * NARROW_SHARE
    side = (
        F.when(
            narrow & (middle < center - F.col("_width") * CENTER_SLACK) & (right <= center + F.col("_width") * COLUMN_SLACK),
            "left",
        )
        .when(
            narrow
            & (middle > center + F.col("_width") * CENTER_SLACK)
            & (F.col("left") >= center - F.col("_width") * COLUMN_SLACK),
            "right",
        )
        .otherwise("none")
    )
    sided = sized.withColumn("_side", side)

    def bound(fn, value: Column, name: str) -> Column:
        return fn(F.when(F.col("_side") == name, value)).over(whole)

    framed = sided.withColumns(
        {
            "_l_n": F.count_if(F.col("_side") == "left").over(whole),
            "_r_n": F.count_if(F.col("_side") == "right").over(whole),
            "_l_top": bound(F.min, F.col("top"), "left"),
            "_r_top": bound(F.min, F.col("top"), "right"),
            "_l_bottom": bound(F.max, bottom, "left"),
            "_r_bottom": bound(F.max, bottom, "right"),
        }
    )
    enough = (F.col("_count") >= MINIMUM_BLOCKS) & (F.least("_l_n", "_r_n") >= MINIMUM_COLUMN_BLOCKS)
    overlap = F.least("_l_bottom", "_r_bottom") > F.greatest("_l_top", "_r_top")
    zone = (
        F.when(~F.col("multi_column"), 0)
        .when(F.col("_side") == "left", 2)
        .when(F.col("_side") == "right", 4)
        .when(bottom < F.least("_l_top", "_r_top"), 1)
        .when(F.col("top") > F.greatest("_l_bottom", "_r_bottom"), 5)
        .otherwise(3)
    )
    by_page = Window.partitionBy(*page)
    placed = (
        framed.withColumn("multi_column", F.coalesce(enough & overlap, F.lit(False)))
        .withColumn("zone", zone)
        .withColumns(
            {
                "_plain": F.row_number().over(by_page.orderBy("top", "left", "block", "par")),
                "position": F.row_number().over(by_page.orderBy("zone", "top", "left", "block", "par")),
            }
        )
    )
    moved = F.max((F.col("_plain") != F.col("position")).cast("int")).over(whole) == 1
    helpers = [name for name in placed.columns if name.startswith("_")]
    return placed.withColumn("reordered", moved).drop(*helpers)


def page_report(ordered: DataFrame, words: DataFrame, page: Sequence[str]) -> DataFrame:
    """Page text in reading order with confidence and quality score."""
    length = F.greatest(F.lit(1), F.length("text"))
    trust = words.groupBy(*page).agg(
        safe_ratio(F.sum(F.col("conf") * length), F.sum(length)).alias("average_confidence")
    )
    pages = ordered.groupBy(*page).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda item: item["text"]), "\n\n"
        ).alias("text"),
        F.count("*").alias("blocks"),
        F.count_if(F.length("text") < SHORT_BLOCK_CHARS).alias("short_blocks"),
        F.bool_or("multi_column").alias("multi_column"),
        F.bool_or("reordered").alias("layout_reordered"),
    )
    return pages.join(trust, list(page)).withColumn("quality_score", quality_score())


def quality_score() -> Column:
    """0-1 from columns text, average_confidence, blocks and short_blocks."""
    text = F.col("text")
    symbols = F.least(
        F.lit(1.0),
        F.regexp_count(text, F.lit(SUSPICIOUS)) / F.greatest(F.lit(1), F.length(text)) * F.lit(20.0),
    )
    structure = F.lit(1.0) - safe_ratio(F.col("short_blocks"), F.greatest(F.lit(1), F.col("blocks")))
    mixed = (
        F.col("average_confidence") * QUALITY_WEIGHTS["confidence"]
        + readable_ratio(text) * QUALITY_WEIGHTS["readability"]
        + structure * QUALITY_WEIGHTS["structure"]
        - symbols * QUALITY_WEIGHTS["symbols"]
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)), 4)
    return F.when(strip(text) == "", F.lit(0.0)).otherwise(score)


def combine_parts(parts: DataFrame, page: Sequence[str], position: str) -> DataFrame:
    """Merge the parts of a page: ordered text, mean scores, any-flags, first repair model."""
    filled = F.when(strip(F.col("text")) != "", F.struct(position, "text"))
    return parts.groupBy(*page).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(filled)), lambda p: p["text"]), "\n\n").alias("text"),
        F.avg("average_confidence").alias("average_confidence"),
        F.avg("quality_score").alias("quality_score"),
        F.bool_or("multi_column").alias("multi_column"),
        F.bool_or("layout_reordered").alias("layout_reordered"),
        F.bool_or(F.coalesce("repair_model", F.lit("")) != "").alias("repaired"),
        F.coalesce(
            F.min_by("repair_model", F.when(F.col("repair_model") != "", F.col(position))), F.lit("")
        ).alias("repair_model"),
    )


def page_context(pages: DataFrame, descriptions: DataFrame, page: Sequence[str], position: str) -> DataFrame:
    """Join the ordered, non-empty image descriptions of each page to it."""
    filled = descriptions.withColumn("description", strip(F.col("description"))).filter(F.col("description") != "")
    merged = filled.groupBy(*page).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(position, "description"))), lambda d: d["description"]), "\n"
        ).alias("visual_context")
    )
    return pages.join(merged, list(page), "left").withColumn("visual_context", F.coalesce("visual_context", F.lit("")))


def pick_best(alternatives: DataFrame, key: Sequence[str], score: Column, position: str, value: str) -> DataFrame:
    """Best-scored alternative per key, the earlier one on ties."""
    return alternatives.groupBy(*key).agg(
        F.max_by(F.col(value), F.struct(score.alias("score"), (-F.col(position)).alias("order"))).alias(value)
    )
