"""Quality metrics of labelled runs. Everything is a partial aggregate or a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions.scoring import safe_ratio
from postroom.functions.text import document_source
from postroom.operators.sequence import newest


def _f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def binary_metrics(results: DataFrame, expected: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix, accuracy, precision, recall and F1 of two boolean columns."""
    e, p = F.col(expected), F.col(predicted)
    counts = results.groupBy(*by).agg(
        F.count_if(e & p).alias("true_positive"),
        F.count_if(~e & p).alias("false_positive"),
        F.count_if(e & ~p).alias("false_negative"),
        F.count_if(~e & ~p).alias("true_negative"),
        F.count("*").alias("cases"),
    )
    precision = safe_ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_positive"))
    recall = safe_ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_negative"))
    return counts.withColumns(
        {
            "accuracy": F.round(safe_ratio(F.col("true_positive") + F.col("true_negative"), F.col("cases")), 4),
            "precision": F.round(precision, 4),
            "recall": F.round(recall, 4),
            "f1": F.round(_f1(precision, recall), 4),
        }
    )


def _label_counts(results: DataFrame, expected: str, predicted: str, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per label from a single pass: the fixed labels become an array of counters."""
    e, p = F.col(expected), F.col(predicted)
    counters = []
    for i, label in enumerate(labels):
        counters += [
            F.count_if((e == label) & (p == label)).alias(f"_tp{i}"),
            F.count_if(~e.eqNullSafe(F.lit(label)) & (p == label)).alias(f"_fp{i}"),
            F.count_if((e == label) & ~p.eqNullSafe(F.lit(label))).alias(f"_fn{i}"),
        ]
    counted = results.groupBy(*by).agg(
        *counters, F.count("*").alias("cases"), F.count_if(e.eqNullSafe(p)).alias("_correct")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.col(f"_tp{i}").alias("tp"),
                F.col(f"_fp{i}").alias("fp"),
                F.col(f"_fn{i}").alias("fn"),
            )
            for i, label in enumerate(labels)
        ]
    )
    return counted.select(*by, "cases", "_correct", F.inline_outer(rows))


def label_metrics(
    results: DataFrame, expected: str, predicted: str, labels: Sequence[str] = lx.METRIC_CATEGORIES, by: Sequence[str] = ()
) -> DataFrame:
    """Support, precision, recall and F1 for each of the fixed labels."""
    rows = _label_counts(results, expected, predicted, labels, by)
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select(
        *by,
        "label",
        (F.col("tp") + F.col("fn")).alias("support"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(_f1(precision, recall), 4).alias("f1"),
    )


def macro_metrics(
    results: DataFrame, expected: str, predicted: str, labels: Sequence[str] = lx.METRIC_CATEGORIES, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, and the mean of the unrounded F1 over all fixed labels, seen or not."""
    rows = _label_counts(results, expected, predicted, labels, by)
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (
        rows.withColumn("_f1", _f1(precision, recall))
        .groupBy(*by)
        .agg(
            F.max("cases").alias("cases"),
            F.round(safe_ratio(F.max("_correct"), F.max("cases")), 4).alias("accuracy"),
            F.round(F.avg("_f1"), 4).alias("macro_f1"),
        )
    )


def both_support(results: DataFrame, expected: str = "expected_support", predicted: str = "predicted_support", error: str = "error") -> DataFrame:
    """Category and risk are only judged on rows that are, and were taken for, support requests."""
    return results.filter(F.col(expected) & F.col(predicted) & (F.coalesce(F.col(error), F.lit("")) == ""))


def language_accuracy(results: DataFrame, expected: str, predicted: str, error: str) -> DataFrame:
    clean = F.coalesce(F.col(error), F.lit("")) == ""
    return results.agg(
        F.round(
            safe_ratio(F.count_if(clean & (F.col(expected) == F.col(predicted))), F.count_if(clean)), 4
        ).alias("language_accuracy"),
        F.count_if(~clean).alias("errors"),
    )


def dataset_profile(cases: DataFrame, *, support: str, language: str, tags: str) -> DataFrame:
    """Counts of all cases, by support flag, language and tag as (dimension, value, cases).

    Each case is turned into its counters first, so one aggregate serves all of them.
    """
    counters = F.concat(
        F.array(
            F.struct(F.lit("all").alias("dimension"), F.lit("cases").alias("value")),
            F.struct(F.lit("support").alias("dimension"), F.when(F.col(support), "support").otherwise("non_support").alias("value")),
            F.struct(F.lit("language").alias("dimension"), F.col(language).alias("value")),
        ),
        F.transform(tags, lambda tag: F.struct(F.lit("tag").alias("dimension"), tag.alias("value"))),
    )
    return cases.select(F.inline_outer(counters)).groupBy("dimension", "value").agg(F.count("*").alias("cases"))


def source_matches(actual: Column, expected: Column) -> Column:
    """Equal, or ``actual`` ends with ``/expected``; case and chunk suffix do not count."""
    a, e = F.lower(document_source(actual)), F.lower(document_source(expected))
    return (a == e) | a.endswith(F.concat(F.lit("/"), e))


def distinct_sources(hits: DataFrame, query: str, source: str, rank: str, limit: int = 3) -> DataFrame:
    """First ``limit`` distinct documents per query, in order of their best rank."""
    best = hits.groupBy(query, document_source(F.col(source)).alias("source")).agg(F.min(rank).alias("_best"))
    return newest(best, [query], [F.col("_best"), F.col("source")], limit, "source_rank").drop("_best")


def retrieval_judgements(cases: DataFrame, retrieved: DataFrame, query: str, expected: str) -> DataFrame:
    """Per case: rank of the first relevant document and number of relevant ones.

    ``retrieved`` has query, source and source_rank; ``expected`` is an array column.
    """
    joined = cases.select(query, expected).join(retrieved, query, "left")
    relevant = F.exists(expected, lambda item: source_matches(F.col("source"), item))
    relevant = F.coalesce(relevant, F.lit(False))
    return joined.groupBy(query).agg(
        F.min(F.when(relevant, F.col("source_rank"))).alias("first_relevant"), F.count_if(relevant).alias("relevant")
    )


def retrieval_metrics(judged: DataFrame, by: Sequence[str] = (), slots: int = 3) -> DataFrame:
    """Recall@1, Recall@3, MRR and P@3; precision always divides by the number of slots."""
    first = F.col("first_relevant")
    return judged.groupBy(*by).agg(
        F.count("*").alias("evaluated_cases"),
        F.round(F.avg(F.when(first == 1, 1.0).otherwise(0.0)), 4).alias("recall_at_1"),
        F.round(F.avg(F.when(first.isNotNull(), 1.0).otherwise(0.0)), 4).alias("recall_at_3"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / first, F.lit(0.0))), 4).alias("mrr"),
        F.round(F.avg(F.col("relevant") / F.lit(float(slots))), 4).alias("precision_at_3"),
    )


def failures(results: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with the names of their failed checks; rows without any are dropped."""
    failed = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()])
    )
    return results.withColumn("failed_metrics", failed).filter(F.size("failed_metrics") > 0)


def case_checks(with_retrieval: bool = False) -> dict[str, Column]:
    """The checks of a standard case result."""
    support = F.col("expected_support") & F.col("predicted_support")
    checks = {
        "support_detection": F.col("expected_support") != F.col("predicted_support"),
        "category": support & (F.col("expected_category") != F.col("predicted_category")),
        "risk": support & (F.col("expected_risk") != F.col("predicted_risk")),
        "language": F.col("expected_language") != F.col("predicted_language"),
    }
    if with_retrieval:
        hit = F.exists(
            F.slice("retrieved_sources", 1, 3),
            lambda actual: F.exists("expected_sources", lambda item: source_matches(actual, item)),
        )
        checks["rag_recall_at_3"] = F.col("expected_support") & (F.size("expected_sources") > 0) & ~hit
    checks["runtime_error"] = F.coalesce(F.col("error"), F.lit("")) != ""
    return checks
