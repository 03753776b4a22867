"""Quality metrics over labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import matching as mt
from postroom.functions import scoring as sc
from postroom.operators import evaluation as ev
from postroom.operators import sequence as seq
from postroom.operators import sketches as sk
from postroom.plans import rules as ru
from postroom.plans import sql
from postroom.plans.registry import Tables, query
from postroom.sources.corpus_files import check_cases, expand_scenarios

LABELS = ("good", "poor", "toxic", "unseen")
_SPLIT = "CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 10 < 7 THEN 'calibration' ELSE 'holdout' END"
_RESULTS_SQL = f"""results AS (SELECT d.doc_id, d.lang AS expected_language,
      {sql.language('lower(text)', ru.SCRIPTS, ru.DEFAULT_LANGUAGE)} AS predicted_language,
      toxic = 1 AS expected_flag, {sql.bounded('lower(text)', ru.INSULTS)} AS predicted_flag,
      CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'good' END AS expected_label,
      CASE WHEN {sql.bounded('lower(text)', ru.INSULTS)} THEN 'toxic' WHEN n_chars < 400 THEN 'poor' ELSE 'good' END AS predicted_label,
      CASE WHEN n_chars % 50 = 0 THEN 'failed' ELSE '' END AS error, source, d.n_chars,
      {_SPLIT} AS split FROM documents d JOIN labels USING (doc_id))"""


def results(t: Tables) -> DataFrame:
    insulted = mt.has_bounded("t", ru.INSULTS)
    docs = t.spread("documents").withColumn("t", F.lower("text")).select(
        "doc_id",
        F.col("lang").alias("expected_language"),
        mt.language_tag("t", ru.SCRIPTS, ru.DEFAULT_LANGUAGE).alias("predicted_language"),
        insulted.alias("predicted_flag"),
        F.when(insulted, "toxic").when(F.col("n_chars") < 400, "poor").otherwise("good").alias("predicted_label"),
        F.when(F.col("n_chars") % 50 == 0, "failed").otherwise("").alias("error"),
        "source",
        "n_chars",
        sc.evaluation_split(F.col("doc_id").cast("string")).alias("split"),
    )
    labels = t.labels.select(
        "doc_id",
        (F.col("toxic") == 1).alias("expected_flag"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("good").alias("expected_label"),
    )
    return docs.join(labels, "doc_id")


_BINARY = """count(*) FILTER (expected_flag AND predicted_flag) AS tp, count(*) FILTER (NOT expected_flag AND predicted_flag) AS fp,
      count(*) FILTER (expected_flag AND NOT predicted_flag) AS fn, count(*) FILTER (NOT expected_flag AND NOT predicted_flag) AS tn"""


@query(
    f"""WITH {_RESULTS_SQL}, c AS (SELECT {_BINARY}, count(*) AS n FROM results),
    m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS r FROM c)
    SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, n AS cases,
      round((tp + tn) / n, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall,
      round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM m"""
)
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix and scores of the insult rule."""
    return ev.binary_metrics(results(Tables(spark, sf)), "expected_flag", "predicted_flag")


_LABEL_SQL = f"""labels_list AS (SELECT unnest({sql.lister(LABELS)}) AS label),
    counts AS (SELECT {{by}} label, count(*) FILTER (expected_label = label AND predicted_label = label) AS tp,
        count(*) FILTER (expected_label <> label AND predicted_label = label) AS fp,
        count(*) FILTER (expected_label = label AND predicted_label <> label) AS fn,
        count(*) FILTER (expected_label = predicted_label) AS correct, count(*) AS cases
      FROM results CROSS JOIN labels_list GROUP BY ALL),
    pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS r FROM counts),
    scored AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""


@query(
    f"""WITH {_RESULTS_SQL}, {_LABEL_SQL.format(by='')}
    SELECT label, tp + fn AS support, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1 FROM scored"""
)
def label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-label scores over a fixed label list, one of which never occurs."""
    return ev.label_metrics(results(Tables(spark, sf)), "expected_label", "predicted_label", LABELS)


@query(
    f"""WITH {_RESULTS_SQL}, {_LABEL_SQL.format(by='split,')}
    SELECT split, max(cases) AS cases, round(max(correct) / max(cases), 4) AS accuracy, round(avg(f), 4) AS macro_f1
    FROM scored GROUP BY split"""
)
def split_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and macro-F1 on the calibration and holdout splits."""
    return ev.macro_metrics(results(Tables(spark, sf)), "expected_label", "predicted_label", LABELS, ["split"])


@query(
    f"""WITH {_RESULTS_SQL}
    SELECT round((count(*) FILTER (error = '' AND expected_language = predicted_language)) / (count(*) FILTER (error = '')), 4)
      AS language_accuracy, count(*) FILTER (error <> '') AS errors FROM results"""
)
def language_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of right language tags among rows without error."""
    return ev.language_accuracy(results(Tables(spark, sf)), "expected_language", "predicted_language", "error")


@query(
    f"""WITH {_RESULTS_SQL}, tags AS (SELECT unnest([expected_label, source, expected_label]) AS tag FROM results)
    SELECT 'all' AS dimension, 'cases' AS value, count(*) AS cases FROM results
    UNION ALL SELECT 'support', CASE WHEN expected_flag THEN 'support' ELSE 'non_support' END, count(*) FROM results GROUP BY 2
    UNION ALL SELECT 'language', expected_language, count(*) FROM results GROUP BY 2
    UNION ALL SELECT 'tag', tag, count(*) FROM tags GROUP BY 2"""
)
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Cases by flag, language and tag."""
    cases = results(Tables(spark, sf)).withColumn("tags", F.array("expected_label", "source", "expected_label"))
    return ev.dataset_profile(cases, support="expected_flag", language="expected_language", tags="tags")


@query(
    f"""WITH {_RESULTS_SQL}, f AS (SELECT doc_id, {sql.compact((
        "CASE WHEN expected_flag <> predicted_flag THEN 'support_detection' END",
        "CASE WHEN expected_flag AND predicted_flag AND expected_label <> predicted_label THEN 'category' END",
        "CASE WHEN expected_language <> predicted_language THEN 'language' END",
        "CASE WHEN NOT (lower('kb/' || source || '.md') = lower(source || '.md') OR ends_with(lower('kb/' || source || '.md'), '/' || 'src' || (doc_id % 20) || '.md')) THEN 'rag_recall_at_3' END",
        "CASE WHEN error <> '' THEN 'runtime_error' END"))} AS failed FROM results)
    SELECT doc_id, array_to_string(failed, ',') AS failed_metrics FROM f WHERE len(failed) > 0"""
)
def failure_explain(spark: SparkSession, sf: str) -> DataFrame:
    """Cases that fail a check, with the names of the failed checks."""
    rows = results(Tables(spark, sf))
    both = F.col("expected_flag") & F.col("predicted_flag")
    actual = F.concat(F.lit("kb/"), F.col("source"), F.lit(".md#chunk-"), (F.col("n_chars") % 9).cast("string"))
    wanted = F.concat(F.lit("SRC"), (F.col("doc_id") % 20).cast("string"), F.lit(".md"))
    failed = ev.failures(
        rows,
        {
            "support_detection": F.col("expected_flag") != F.col("predicted_flag"),
            "category": both & (F.col("expected_label") != F.col("predicted_label")),
            "language": F.col("expected_language") != F.col("predicted_language"),
            "rag_recall_at_3": ~ev.source_matches(actual, wanted),
            "runtime_error": F.col("error") != "",
        },
    )
    return failed.select("doc_id", F.array_join("failed_metrics", ",").alias("failed_metrics"))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, value AS p95, n FROM r WHERE i = round_even((n - 1) * 0.95, 0)::BIGINT + 1"""
)
def nearest_rank_p95(spark: SparkSession, sf: str) -> DataFrame:
    """Exact nearest-rank P95 of the event value per type."""
    events = Tables(spark, sf).events.select("event_type", "value")
    return seq.nearest_rank(events, ["event_type"], "value", 0.95, F.floor("value"), "p95")


@query(
    """SELECT event_type, count(value) AS n, count(DISTINCT ts::DATE) AS days, true AS p50_close, true AS p95_close, true AS p99_close
    FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def percentile_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the event value per type from daily sketches, merged, with their rank checked against all values."""
    events = Tables(spark, sf).events.select("event_type", F.to_date("ts").alias("day"), "value")
    ratios = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    daily = sk.sketch_values(events, ["event_type", "day"], F.col("value"))
    merged = sk.merge_sketches(daily, ["event_type"])
    days = daily.groupBy("event_type").agg(F.count("day").alias("days"))
    errors = sk.rank_errors(events, sk.sketched_quantiles(merged, ["event_type"], ratios), ["event_type"], F.col("value"), ratios)
    close = [(F.col(f"{name}_error") <= 0.02).alias(f"{name}_close") for name in ratios]
    return errors.join(days, "event_type").select("event_type", "n", "days", *close)


@query(
    """WITH s AS (SELECT item_id, 'bench' AS category, item_id % 5 > 0 AS support, split_part(text, ' ', 1) AS slug,
        text AS body FROM benchmark),
    l AS (SELECT *, unnest(['zh', 'en']) AS language FROM s)
    SELECT 'ext-' || CASE WHEN support THEN category ELSE 'nonsupport' END || '-' || language || '-' || lpad(item_id::VARCHAR, greatest(2, length(item_id::VARCHAR))::INT, '0') AS id,
      language, CASE language WHEN 'zh' THEN '主题 ' || slug ELSE slug END AS subject, sha256(CASE language WHEN 'zh' THEN '正文' || body ELSE body END) AS body_hash,
      support AS expected_support, CASE WHEN support THEN category ELSE 'other' END AS expected_category,
      CASE WHEN support THEN 'medium' ELSE 'low' END AS expected_risk,
      CASE WHEN support THEN 'bench.md' ELSE '' END AS expected_sources,
      CASE WHEN support THEN category ELSE 'non_support' END || ',' || slug || ',' || language || ',extended' AS tags FROM l"""
)
def scenario_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text as a scenario in two languages."""
    text = F.col("text")
    slug = F.substring_index("text", " ", 1)
    scenarios = Tables(spark, sf).benchmark.select(
        F.lit("bench").alias("category"),
        F.col("item_id").alias("number"),
        slug.alias("slug"),
        F.lit("medium").alias("risk"),
        F.array(F.lit("bench.md")).alias("sources"),
        (F.col("item_id") % 5 > 0).alias("support"),
        F.concat(F.lit("主题 "), slug).alias("subject_zh"),
        F.concat(F.lit("正文"), text).alias("body_zh"),
        slug.alias("subject_en"),
        text.alias("body_en"),
    )
    rows = expand_scenarios(scenarios)
    return rows.select(
        "id",
        "language",
        "subject",
        F.sha2("body", 256).alias("body_hash"),
        "expected_support",
        "expected_category",
        "expected_risk",
        F.array_join("expected_sources", ",").alias("expected_sources"),
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    """SELECT sum(n)::BIGINT AS cases, count(*) FILTER (n > 1) AS duplicate_ids,
      CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'unique_ids' ELSE '' END AS broken
    FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"""
)
def case_set_check(spark: SparkSession, sf: str) -> DataFrame:
    """Uniqueness and size findings of a case set; conversation ids repeat."""
    found = check_cases(Tables(spark, sf).conversations.select(F.col("conv_id").cast("string").alias("id")))
    return found.select("cases", "duplicate_ids", F.array_join("broken", ",").alias("broken"))
