"""File sources: text corpora and labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom import schemas
from postroom.functions.text import source_stem
from postroom.operators.expectations import judge


def read_corpus(spark: SparkSession, root: str, suffixes=(".md", ".txt")) -> DataFrame:
    """All text files below ``root``: source (path below it), stem, text, size.

    Files of other kinds arrive as already parsed tables.
    """
    pattern = "*.{" + ",".join(s.lstrip(".") + "," + s.lstrip(".").upper() for s in suffixes) + "}"
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
        .select(
            F.col("value").alias("text"),
            F.url_decode(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_size").alias("size_bytes"),
        )
    )
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    return files.select(
        F.substring_index("path", base, -1).alias("source"),
        source_stem(F.col("path")).alias("stem"),
        F.regexp_replace("text", "^﻿", "").alias("text"),
        "size_bytes",
    )


def read_cases(spark: SparkSession, path: str, limit: int = 0, quarantine: bool = False) -> DataFrame:
    """Labelled cases from JSON lines, with defaults; blank lines are skipped.

    A line that is no JSON object, or a case without id, fails when the rows are used. With
    ``quarantine`` such lines stay as rows, with the line in ``bad_line`` and why in ``problem``.
    Ids that occur twice and an empty file are found by ``check_cases``.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value")
    parsed = lines.select("value", F.from_json("value", f"{schemas.CASE}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("case"))
    problem = F.when(F.col("case").isNull() | F.col("case._bad").isNotNull(), "unreadable").when(F.col("case.id").isNull(), "no id")
    raw = parsed.select("case.*", problem.alias("problem"), F.when(problem.isNotNull(), F.col("value")).alias("bad_line")).drop("_bad")
    if not quarantine:
        failed = F.raise_error(F.concat_ws(": ", "problem", "bad_line"))
        raw = raw.withColumn("id", F.when(F.col("problem").isNotNull(), failed.cast("string")).otherwise(F.col("id"))).drop("problem", "bad_line")
    cases = raw.withColumns(
        {
            "expected_category": F.coalesce("expected_category", F.lit("other")),
            "expected_risk": F.coalesce("expected_risk", F.lit("low")),
            "expected_sources": F.coalesce("expected_sources", F.array().cast("array<string>")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
        }
    )
    return cases.limit(limit) if limit > 0 else cases


def check_cases(cases: DataFrame, expected: int | None = None) -> DataFrame:
    """One row of findings: cases, duplicate ids, and whether the set may be used."""
    counted = cases.groupBy("id").agg(F.count("*").alias("n"))
    totals = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.count_if(F.col("n") > 1).alias("duplicate_ids")
    )
    size_ok = F.col("cases") > 0 if expected is None else F.col("cases") == expected
    return judge(totals, {"size": size_ok, "unique_ids": F.col("duplicate_ids") == 0})


def expand_scenarios(scenarios: DataFrame, languages=("zh", "en"), prefix: str = "ext") -> DataFrame:
    """Each scenario once per language, with a composed id and tags.

    Columns: category, number, slug, risk, sources, support, and per language
    subject_<l> and body_<l>.
    """
    versions = F.array(
        *[
            F.struct(
                F.lit(tag).alias("language"), F.col(f"subject_{tag}").alias("subject"), F.col(f"body_{tag}").alias("body")
            )
            for tag in languages
        ]
    )
    rows = scenarios.select("category", "number", "slug", "risk", "sources", "support", F.inline_outer(versions))
    group = F.when(F.col("support"), F.col("category")).otherwise(F.lit("nonsupport"))
    label = F.when(F.col("support"), F.col("category")).otherwise(F.lit("non_support"))
    return rows.select(
        F.format_string(f"{prefix}-%s-%s-%02d", group, "language", "number").alias("id"),
        "language",
        "subject",
        "body",
        F.col("support").alias("expected_support"),
        F.when(F.col("support"), F.col("category")).otherwise(F.lit("other")).alias("expected_category"),
        F.when(F.col("support"), F.col("risk")).otherwise(F.lit("low")).alias("expected_risk"),
        F.when(F.col("support"), F.col("sources")).otherwise(F.array().cast("array<string>")).alias("expected_sources"),
        F.array(label, F.col("slug"), F.col("language"), F.lit("extended")).alias("tags"),
    )
