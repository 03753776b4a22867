"""Usage, cost, queue and display reports; templates and localised notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.session import broadcast_if_small

USAGE_COUNTERS = (
    "llm_calls",
    "semantic_llm_calls",
    "draft_llm_calls",
    "embedding_calls",
    "input_tokens",
    "output_tokens",
    "embedding_tokens",
    "rag_latency_ms",
)


def cost(prices: Mapping[str, float] = lx.PRICES_PER_MILLION) -> Column:
    """Cost of the token columns at a price per million, six decimals."""
    total = F.lit(0.0)
    for name, price in prices.items():
        total = total + F.coalesce(F.col(name), F.lit(0)) / F.lit(1_000_000.0) * F.lit(price)
    return F.round(total, 6)


def usage_by(events: DataFrame, key: Sequence[str], prices: Mapping[str, float] = lx.PRICES_PER_MILLION) -> DataFrame:
    """Counters added up per key; missing ones count as zero."""
    present = [name for name in USAGE_COUNTERS if name in events.columns]
    summed = events.groupBy(*key).agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in present])
    return summed.withColumn("estimated_cost", cost({k: v for k, v in prices.items() if k in present}))


def _recent(moment: Column, as_of: str) -> Column:
    """Two ranges of ``moment`` with literal ends, which a scan can be given."""
    now = F.expr(f"TIMESTAMP_NTZ'{as_of}'")
    midnight = F.expr(f"CAST(CAST(TIMESTAMP_NTZ'{as_of}' AS DATE) AS TIMESTAMP_NTZ)")
    same_day = (moment >= midnight) & (moment < midnight + F.expr("INTERVAL 1 DAY"))
    return same_day | moment.between(now - F.expr("INTERVAL 24 HOURS"), now)


def is_today_or_recent(moment: Column, as_of: str) -> Column:
    """Same calendar day as ``as_of`` (also later that day), or within the 24 hours before it; false for null."""
    return F.coalesce(_recent(moment, as_of), F.lit(False))


def recent_usage(messages: DataFrame, updated_at: str, as_of: str, by: Sequence[str] = ()) -> DataFrame:
    """Messages, tokens and cost of today or the last 24 hours."""
    tokens = sum((F.coalesce(F.col(n), F.lit(0)) for n in ("input_tokens", "output_tokens", "embedding_tokens")), F.lit(0))
    return (
        messages.filter(_recent(F.col(updated_at), as_of))
        .groupBy(*by)
        .agg(
            F.count("*").alias("messages"),
            F.sum(tokens).alias("tokens"),
            F.round(F.sum(F.coalesce("estimated_cost", F.lit(0.0))), 6).alias("cost"),
        )
    )


def queue_counters(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dashboard counters over columns status and priority."""
    status = F.col("status")
    return messages.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(status == "human_review").alias("in_review"),
        F.count_if(F.col("priority") == "high").alias("high_priority"),
        F.count_if(status.isin("processed", "ready_to_send")).alias("processed"),
        F.count_if(status == "ready_to_send").alias("ready"),
    )


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default: Column) -> DataFrame:
    """Left join of a small table with a default for missing keys."""
    joined = df.join(broadcast_if_small(table.select(*keys, F.col(value).alias("_found"))), list(keys), "left")
    return joined.withColumn(value, F.coalesce("_found", default)).drop("_found")


def review_notes(spark: SparkSession, rows: Sequence[tuple[str, str, str]] = lx.REVIEW_NOTES) -> DataFrame:
    return spark.createDataFrame(list(rows), "language string, action string, note string")


def with_review_note(actions: DataFrame, notes: DataFrame) -> DataFrame:
    """Keep a written note, else the standard one of the action and language."""
    written = F.when(F.coalesce("note", F.lit("")) != "", F.col("note"))
    standard = notes.withColumnRenamed("note", "_standard")
    joined = actions.join(broadcast_if_small(standard), ["language", "action"], "left")
    return joined.withColumn("note", F.coalesce(written, "_standard")).drop("_standard")


def merge_templates(
    messages: DataFrame,
    templates: DataFrame,
    values: Mapping[str, Column],
    *,
    keys: Sequence[str] = ("category", "language", "variant"),
    fallback: Mapping[str, str] | None = None,
    name: str = "draft_reply",
) -> DataFrame:
    """Fill the message's template; ``{field}`` marks are replaced by ``values``.

    Unknown categories take the template of ``fallback`` (category ``other``).
    """
    fallback = fallback or {"category": "other"}
    own = templates.select(*keys, F.col("template").alias("_own"))
    spare_keys = [key for key in keys if key not in fallback]
    spare = templates
    for key, value in fallback.items():
        spare = spare.filter(F.col(key) == value)
    spare = spare.select(*spare_keys, F.col("template").alias("_spare"))
    filled = messages.join(broadcast_if_small(own), list(keys), "left").join(
        broadcast_if_small(spare), spare_keys, "left"
    )
    body = F.coalesce("_own", "_spare")
    for field, value in values.items():
        body = F.replace(body, F.lit("{" + field + "}"), value)
    return filled.withColumn(name, body).drop("_own", "_spare")


def variant_of(bodies: Column, variant: Column) -> Column:
    """Body for ``alternative-n``; other variants take the first."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(variant, r"-(\d{1,9})$", 1), F.lit("999999999")), F.lit(1))
    return F.element_at(bodies, F.pmod(number.cast("int") - 1, F.size(bodies)) + 1)


def capability_answer(
    evidence: Column, capabilities: Sequence[tuple[str, Sequence[str]]], lead: str, tail: str, none: str, separator: str
) -> Column:
    """Answer that lists the capabilities whose marks occur in the evidence."""
    lowered = F.lower(evidence)
    named = F.array_compact(
        F.array(
            *[
                F.when(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: lowered.contains(m)), F.lit(label))
                for label, marks in capabilities
            ]
        )
    )
    listed = F.concat(F.lit(lead), F.array_join(named, separator), F.lit(tail))
    return F.when(F.size(named) > 0, listed).otherwise(F.lit(none))
