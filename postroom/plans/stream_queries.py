"""Streaming jobs over the event and document files, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.operators.triage import preprocess
from postroom.plans import lifecycle_queries as lq
from postroom.plans import rules as ru
from postroom.plans import sql
from postroom.plans import triage_queries as tq
from postroom.plans.registry import Tables, query
from postroom.schemas import EVENT
from postroom.streaming import jobs

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RUNS, DELAYED_DAYS = 4, 4
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


@query(
    """SELECT ts::DATE AS day, event_type, count(*) AS messages, sum(floor(value))::BIGINT AS input_tokens,
      sum(event_id % 50)::BIGINT AS output_tokens FROM events GROUP BY ALL"""
)
def stream_usage_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily usage as a windowed stream in complete mode."""
    events = jobs.table_stream(spark, sf, "events", EVENT).select(
        "ts", "event_type", F.floor("value").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens")
    )
    return jobs.drain(jobs.daily_usage(events, "ts", "1 day", ["event_type"]), "daily", "complete")


@query(
    f"""WITH e AS (SELECT *, ts::DATE AS day, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)
        + CASE WHEN event_id % 10 = 0 THEN {DELAYED_DAYS} ELSE 0 END AS arrival FROM events WHERE ts IS NOT NULL),
    r AS (SELECT *, arrival * {RUNS} // (SELECT max(arrival) + 1 FROM e) AS run FROM e),
    w AS (SELECT run, max(ts) AS top FROM r GROUP BY run),
    m AS (SELECT run, max(top) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM w)
    SELECT day, event_type, count(*) AS messages, sum(floor(value))::BIGINT AS input_tokens, sum(event_id % 50)::BIGINT AS output_tokens
    FROM r JOIN m USING (run)
    WHERE (mark IS NULL OR day + INTERVAL 1 DAY > mark) AND day + INTERVAL 1 DAY <= (SELECT max(ts) FROM r) - INTERVAL 1 DAY
    GROUP BY day, event_type"""
)
def stream_usage_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Daily usage as a job run again and again, in append mode: a tenth of the events arrives four days late.

    A day is written once, when the watermark has passed its end; rows that come later than that are left out.
    """
    events = Tables(spark, sf).events.filter("ts IS NOT NULL").select(
        "ts", "event_type", F.floor("value").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"),
        F.when(F.col("event_id") % 10 == 0, DELAYED_DAYS).otherwise(0).alias("late"),
    )
    first = events.agg(F.min("ts").alias("ts")).first()["ts"]
    arrival = F.datediff("ts", F.lit(first).cast("date")) + F.col("late")
    days = (events.agg(F.max(arrival).alias("last")).first()["last"] or 0) + 1
    run = F.floor(arrival * RUNS / F.lit(days))
    arrivals = (events.filter(run == number).drop("late") for number in range(RUNS))
    return jobs.drain_runs(arrivals, "closed", lambda stream: jobs.daily_usage(stream, "ts", "1 day", ["event_type"]))


@query("SELECT DISTINCT event_type AS provider, user_id AS message_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental import: repeated message ids inside the watermark are dropped."""
    events = jobs.table_stream(spark, sf, "events", EVENT).select(
        "ts", F.col("event_type").alias("provider"), F.col("user_id").alias("message_id")
    )
    kept = jobs.new_messages(events, ["provider", "message_id"], "ts", "60 days", lambda df: df)
    return jobs.drain(kept.select("provider", "message_id"), "dedup")


@query(
    f"""SELECT conv_id, turn, {sql.language('t', ru.SCRIPTS, ru.DEFAULT_LANGUAGE)} AS language,
      array_to_string({sql.labels('t', ru.FLAGS)}, ',') AS flags
    FROM (SELECT *, lower(text) AS t FROM conversations WHERE role = 'user')"""
)
def stream_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Row-wise triage of the message stream: language and flags."""
    messages = jobs.table_stream(spark, sf, "conversations", CONVERSATIONS).filter("role = 'user'")
    flagged = preprocess(
        messages.withColumn("t", F.lower("text")), "t", flags=ru.FLAGS, scripts=ru.SCRIPTS, default_language=ru.DEFAULT_LANGUAGE
    )
    rows = flagged.select("conv_id", "turn", "language", F.array_join("preprocessing_flags", ",").alias("flags"))
    return jobs.drain(rows, "triage")


@query(
    f"""WITH {tq.USER_SQL}, {tq.assessed_sql('messages')}
    SELECT conv_id, turn, language, category, confidence, risk_level, risk_score, risk_level = 'high' AS should_escalate,
           array_to_string(preprocessing_flags, ',') AS flags, array_to_string(matched_terms, ',') AS matched,
           array_to_string(risk_flags, ' | ') AS reasons
    FROM assessed"""
)
def stream_import(spark: SparkSession, sf: str) -> DataFrame:
    """The message stream as a job: new ids only, flags, category, risk and escalation, stored per micro-batch."""
    messages = jobs.table_stream(spark, sf, "conversations", CONVERSATIONS).filter("role = 'user'")

    def chain(batch: DataFrame) -> DataFrame:
        judged = tq.assessed(batch.withColumn("t", F.lower("text")))
        return judged.select(
            "conv_id", "turn", "language", "category", "confidence", "risk_level", "risk_score",
            (F.col("risk_level") == "high").alias("should_escalate"), F.array_join("preprocessing_flags", ",").alias("flags"),
            F.array_join("matched_terms", ",").alias("matched"), F.array_join("risk_flags", " | ").alias("reasons"),
        )

    folder = jobs.new_folder(spark, "import")
    jobs.import_messages(
        messages, f"{folder}/rows", key=["conv_id", "turn"], order=["text"], chain=chain, checkpoint=f"{folder}/checkpoint"
    ).awaitTermination()
    return jobs.imported(spark, f"{folder}/rows")


@query(
    f"""WITH {lq.TICKETS_SQL}, n AS (SELECT user_id, count(*) AS events FROM ticket_log GROUP BY user_id)
    SELECT user_id, arg_max(status, ticket_number) AS status, any_value(events) AS events
    FROM tickets JOIN n USING (user_id) GROUP BY user_id"""
)
def stream_entity_state(spark: SparkSession, sf: str) -> DataFrame:
    """Ticket status per user, kept as streaming state."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, jobs.ROCKSDB)
    try:
        events = jobs.table_stream(spark, sf, "events", EVENT).filter("event_type <> 'view'")
        acted = events.withColumn("action", lq._mapped(lq.TICKET_ACTIONS))
        state = jobs.entity_state(acted, "user_id", "ts", "event_id", "action", lx.TICKET_STATUS)
        return jobs.drain(state, "state", "update", ["user_id"])
    finally:
        spark.conf.set(STATE_STORE, before)


@query()
def stream_corpus_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream into a bucketed chunk table; chunks per document read back."""
    folder = jobs.new_folder(spark, "corpus")
    documents = jobs.table_stream(spark, sf, "documents", DOCUMENTS).withColumn("title", F.col("source"))
    jobs.upsert_corpus(
        documents, f"{folder}/chunks", key="doc_id", text="text", title="title", source="source",
        checkpoint=f"{folder}/checkpoint", buckets=8,
    ).awaitTermination()
    chunks = spark.read.parquet(f"{folder}/chunks")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
