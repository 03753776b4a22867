"""Row expectations and validation of model-output JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions.text import strip

VERDICT_SCHEMA = (
    "category string, is_support_request boolean, confidence double, risk_level string, "
    "risk_flags array<string>, should_escalate boolean, reason string"
)


def judge(df: DataFrame, expectations: Mapping[str, Column]) -> DataFrame:
    """Add ``is_valid`` and ``broken``, the names of the expectations a row does not meet."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in expectations.items()])
    )
    return df.withColumn("broken", broken).withColumn("is_valid", F.size("broken") == 0)


def split_valid(df: DataFrame, expectations: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with reasons)."""
    judged = judge(df, expectations)
    return judged.filter("is_valid").drop("is_valid", "broken"), judged.filter(~F.col("is_valid")).drop("is_valid")


def message_expectations() -> dict[str, Column]:
    """Minimum lengths of a new message."""
    return {
        name: F.length(name) >= size
        for name, size in (("customer_name", 1), ("customer_email", 3), ("subject", 1), ("body", 10))
    }


def document_expectations() -> dict[str, Column]:
    """Bounds of a hand-made document."""
    return {
        "title": F.length("title").between(1, 120),
        "source": F.length(F.coalesce("source", F.lit(""))) <= 160,
        "content": F.length("content") >= 20,
    }


def strip_fence(text: Column) -> Column:
    """Remove a markdown code fence around a JSON answer."""
    trimmed = strip(text)
    inner = F.regexp_replace(F.regexp_replace(trimmed, r"(?iU)^```(?:json)?\s*", ""), r"(?U)\s*```$", "")
    return strip(F.when(trimmed.startswith("```"), inner).otherwise(trimmed))


def parse_verdicts(df: DataFrame, raw: str) -> DataFrame:
    """Add ``verdict`` (null when invalid) and ``verdict_errors``."""
    parsed = df.withColumn("_parsed", F.from_json(strip_fence(F.col(raw)), VERDICT_SCHEMA))
    p = F.col("_parsed")
    checked = judge(
        parsed,
        {
            "category": p["category"].isin(*lx.CATEGORIES),
            "is_support_request": p["is_support_request"].isNotNull(),
            "confidence": p["confidence"].between(0, 1),
            "risk_level": p["risk_level"].isin(*lx.RISK_LEVELS),
            "should_escalate": p["should_escalate"].isNotNull(),
            "reason": p["reason"].isNotNull(),
        },
    )
    return (
        checked.withColumn("verdict", F.when(F.col("is_valid"), p))
        .withColumnRenamed("broken", "verdict_errors")
        .drop("_parsed", "is_valid")
    )
