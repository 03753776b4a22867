"""Usage, queue and template reports; page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions import matching as mt
from postroom.functions import text as tx
from postroom.operators import layout as ly
from postroom.operators import lifecycle as lc
from postroom.operators import reporting as rp
from postroom.plans import lifecycle_queries as lq
from postroom.plans import rules as ru
from postroom.plans import sql
from postroom.plans.registry import Tables, query

AS_OF = "2024-01-15 06:00:00"
PAGE_WORDS = 240
_TOKENS = r"""greatest(1, round_even((length(text) - length(o)) / 4.0::DOUBLE + length(o) / 1.6::DOUBLE, 0))::BIGINT"""


@query(
    rf"""WITH m AS (SELECT *, regexp_replace(text, '[\x00-\x7f]', '', 'g') AS o FROM conversations),
    u AS (SELECT conv_id, CASE WHEN role = 'user' THEN {_TOKENS} ELSE 0 END AS i,
        CASE WHEN role = 'assistant' THEN {_TOKENS} ELSE 0 END AS a, CASE WHEN role <> 'assistant' THEN {_TOKENS} ELSE 0 END AS e FROM m),
    s AS (SELECT conv_id, sum(i)::BIGINT AS input_tokens, sum(a)::BIGINT AS output_tokens, sum(e)::BIGINT AS embedding_tokens FROM u GROUP BY conv_id)
    SELECT *, round(input_tokens / 1000000.0::DOUBLE * 1.0::DOUBLE + output_tokens / 1000000.0::DOUBLE * 2.0::DOUBLE
      + embedding_tokens / 1000000.0::DOUBLE * 0.08::DOUBLE, 6) AS estimated_cost FROM s"""
)
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and cost of every conversation."""
    tokens = tx.byte_class_tokens(F.col("text"))
    usage = Tables(spark, sf).conversations.select(
        "conv_id",
        F.when(F.col("role") == "user", tokens).otherwise(0).alias("input_tokens"),
        F.when(F.col("role") == "assistant", tokens).otherwise(0).alias("output_tokens"),
        F.when(F.col("role") != "assistant", tokens).otherwise(0).alias("embedding_tokens"),
    )
    return rp.usage_by(usage, ["conv_id"])


@query(
    f"""SELECT event_type, count(*) AS messages, sum(event_id % 100 + user_id)::BIGINT AS tokens,
      round(sum(value) / 1000, 4) AS cost FROM events
    WHERE ts::DATE = DATE '2024-01-15' OR ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}' GROUP BY event_type"""
)
def recent_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, tokens and cost of the day or the last 24 hours."""
    usage = Tables(spark, sf).events.select(
        "event_type",
        "ts",
        (F.col("event_id") % 100).alias("input_tokens"),
        F.col("user_id").alias("output_tokens"),
        F.lit(None).cast("bigint").alias("embedding_tokens"),
        (F.col("value") / 1000).alias("estimated_cost"),
    )
    return rp.recent_usage(usage, "ts", AS_OF, ["event_type"]).withColumn("cost", F.round("cost", 4))


def queue_messages(t: Tables) -> DataFrame:
    """One row per user: status, priority, confidence, ticket, flags."""
    log = lq.actions(t)
    order = ["ts", "event_id"]
    last_ticket = lc.seq.latest(lq.tickets(t).select("user_id", "ticket_number", "status"), ["user_id"], ["ticket_number"])
    facts = t.events.groupBy("user_id").agg(
        F.max("value").alias("top"), (F.count("*") % 100 / 100.0).alias("confidence"), F.bool_or(F.col("value") > 220).alias("strong_grounding")
    )
    return (
        facts.join(lc.message_status(log, "user_id", order), "user_id", "left")
        .join(lc.escalation_history(log, "user_id", order), "user_id", "left")
        .join(last_ticket.select("user_id", F.col("status").alias("ticket_status")), "user_id", "left")
        .withColumns(
            {
                "status": F.coalesce("status", F.lit("new")),
                "priority": F.when(F.col("top") > 250, "high").when(F.col("top") > 200, "medium").otherwise("low"),
            }
        )
    )


_QUEUE_SQL = f"""{lq._ACTIONS_SQL}, {lq.TICKETS_SQL},
    facts AS (SELECT user_id, max(value) AS top, (count(*) % 100 / 100.0)::DOUBLE AS confidence, bool_or(value > 220) AS strong FROM events GROUP BY user_id),
    acted AS (SELECT user_id, arg_max(CASE action WHEN 'approve' THEN 'ready_to_send' WHEN 'revise' THEN 'needs_revision'
          WHEN 'escalate' THEN 'escalated' ELSE 'human_review' END, (ts, event_id)) AS status,
        bool_or(action = 'approve') AS approved,
        arg_max(action, (ts, event_id)) FILTER (action IN ('escalate', 'undo_escalate')) = 'escalate' AS last_escalates
      FROM actions GROUP BY user_id),
    last_ticket AS (SELECT user_id, arg_max(status, ticket_number) AS ticket_status FROM tickets GROUP BY user_id),
    q AS (SELECT user_id, coalesce(status, 'new') AS status, CASE WHEN top > 250 THEN 'high' WHEN top > 200 THEN 'medium' ELSE 'low' END AS priority,
        confidence, strong, coalesce(approved, false) AS approved,
        coalesce(status, 'new') = 'escalated' OR coalesce(ticket_status IN ('open', 'assigned'), false) AS active,
        coalesce(last_escalates, coalesce(ticket_status IN ('open', 'assigned', 'resolved'), false)) AS history
      FROM facts LEFT JOIN acted USING (user_id) LEFT JOIN last_ticket USING (user_id))"""


@query(
    f"""WITH {_QUEUE_SQL} SELECT priority, count(*) AS total, count(*) FILTER (status = 'human_review') AS in_review,
      count(*) FILTER (priority = 'high') AS high_priority, count(*) FILTER (status IN ('processed', 'ready_to_send')) AS processed,
      count(*) FILTER (status = 'ready_to_send') AS ready FROM q GROUP BY priority"""
)
def queue_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Dashboard counters by priority."""
    return rp.queue_counters(queue_messages(Tables(spark, sf)), ["priority"])


_GENERAL = """CASE WHEN status = 'ready_to_send' THEN approved OR history
      ELSE status IN ('human_review', 'needs_revision', 'escalated') OR priority = 'high' END"""


@query(
    f"""WITH {_QUEUE_SQL} SELECT user_id, status, priority, NOT active AS agent_sees, {_GENERAL} AS admin_review,
      active OR history AS manager_review, ({_GENERAL}) AND NOT active AS agent_review,
      status = 'ready_to_send' AND priority = 'low' AND confidence >= 0.78 AND strong AND NOT approved AND NOT history AS low_risk_ready,
      active OR history AS in_escalation_queue, status = 'ready_to_send' AND NOT history AS agent_can_send FROM q"""
)
def queue_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Visibility and queues of every message for the three roles."""
    admin, manager, agent = (lc.queue_flags(role) for role in ("admin", "manager", "agent"))
    return queue_messages(Tables(spark, sf)).select(
        "user_id",
        "status",
        "priority",
        lc.visible_to("agent", F.col("status"), F.col("ticket_status")).alias("agent_sees"),
        admin["in_review_queue"].alias("admin_review"),
        manager["in_review_queue"].alias("manager_review"),
        agent["in_review_queue"].alias("agent_review"),
        admin["low_risk_ready"].alias("low_risk_ready"),
        admin["in_escalation_queue"].alias("in_escalation_queue"),
        agent["can_send"].alias("agent_can_send"),
    )


@query(
    """WITH r AS (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 60),
    v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')
    SELECT count(*) AS ready, count(v.user_id) AS viewed, count(*) > 0 AND count(*) = count(v.user_id) AS can_bulk_send
    FROM r LEFT JOIN v USING (user_id)"""
)
def bulk_send_ready(spark: SparkSession, sf: str) -> DataFrame:
    """May all ready messages be sent at once?"""
    events = Tables(spark, sf).events
    ready = events.groupBy("user_id").agg(F.max("value").alias("top")).filter("top > 60").select("user_id")
    return lc.bulk_send_ready(ready, events.filter("event_type = 'view'"), "user_id")


_TEMPLATE_ROWS = ", ".join("(" + ", ".join(sql.text(v) for v in row) + ")" for row in ru.TEMPLATES)


@query(
    f"""WITH m AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
    c AS (SELECT conv_id, turn, {sql.first_match('t', ru.VOTE)} AS category,
        {sql.language('t', ru.SCRIPTS, ru.DEFAULT_LANGUAGE)} AS language FROM m),
    templates(category, language, variant, template) AS (VALUES {_TEMPLATE_ROWS})
    SELECT conv_id, turn, c.category, c.language, replace(replace(replace(coalesce(a.template, b.template),
        '{{name}}', 'customer ' || conv_id), '{{category}}', c.category), '{{turn}}', turn::VARCHAR) AS draft_reply
    FROM c LEFT JOIN templates a ON a.category = c.category AND a.language = c.language
      LEFT JOIN templates b ON b.category = 'other' AND b.language = c.language"""
)
def template_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A reply draft for every turn from its category's template."""
    messages = Tables(spark, sf).conversations.withColumn("t", F.lower("text")).select(
        "conv_id",
        "turn",
        mt.first_match("t", ru.VOTE).alias("category"),
        mt.language_tag("t", ru.SCRIPTS, ru.DEFAULT_LANGUAGE).alias("language"),
        F.lit("default").alias("variant"),
    )
    templates = spark.createDataFrame(list(ru.TEMPLATES), "category string, language string, variant string, template string")
    values = {
        "name": F.concat(F.lit("customer "), F.col("conv_id").cast("string")),
        "category": F.col("category"),
        "turn": F.col("turn").cast("string"),
    }
    return rp.merge_templates(messages, templates, values).drop("variant")


_NOTE_ROWS = ", ".join("(" + ", ".join(sql.text(v) for v in row) + ")" for row in lx.REVIEW_NOTES)


@query(
    f"""WITH notes(language, action, note) AS (VALUES {_NOTE_ROWS}), {lq._ACTIONS_SQL}
    SELECT event_id, action, CASE WHEN value > 40 THEN 'written ' || event_id ELSE note END AS note
    FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'zh' ELSE 'en' END AS language FROM actions) LEFT JOIN notes USING (language, action)"""
)
def review_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Review notes: the written one, else the standard one of the language."""
    log = lq.actions(Tables(spark, sf)).select(
        "event_id",
        "action",
        F.when(F.col("user_id") % 2 == 0, "zh").otherwise("en").alias("language"),
        F.when(F.col("value") > 40, F.concat(F.lit("written "), F.col("event_id").cast("string"))).alias("note"),
    )
    return rp.with_review_note(log, rp.review_notes(spark)).select("event_id", "action", "note")


@query(
    """SELECT event_id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0)
        ELSE printf('%.1f MB', b / 1048576.0) END AS bytes,
      CASE WHEN m = 0 THEN '0 ms' WHEN m >= 10000 THEN printf('%.1f s', m / 1000.0) WHEN m >= 1000 THEN printf('%.2f s', m / 1000.0)
        ELSE m || ' ms' END AS latency,
      CASE WHEN c = 0 THEN '¥0' WHEN c < 0.000001 THEN '<¥0.000001' WHEN c < 0.01 THEN printf('¥%.6f', c) ELSE printf('¥%.4f', c) END AS cost
    FROM (SELECT event_id, event_id * user_id AS b, event_id % 20000 AS m, (event_id % 1000 / 8192.0)::DOUBLE AS c FROM events)"""
)
def display_units(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, latencies and costs as shown to people."""
    shown = Tables(spark, sf).events.select(
        "event_id",
        (F.col("event_id") * F.col("user_id")).alias("b"),
        (F.col("event_id") % 20000).alias("m"),
        (F.col("event_id") % 1000 / 8192.0).alias("c"),
    )
    return shown.select(
        "event_id",
        tx.display_bytes(F.col("b")).alias("bytes"),
        tx.display_latency(F.col("m")).alias("latency"),
        tx.display_cost(F.col("c")).alias("cost"),
    )


def page_words(t: Tables) -> DataFrame:
    """Benchmark texts set as two-column pages of 240 words: six words per block, three per line."""
    words = t.benchmark.select(F.col("item_id").alias("doc_id"), F.posexplode_outer(F.split("text", "[ \n]+")).alias("i", "text"))
    words = words.withColumns({"page": F.floor(F.col("i") / PAGE_WORDS).cast("int"), "i": F.col("i") % PAGE_WORDS})
    block = F.floor(F.col("i") / 6).cast("int")
    column = block % 2
    line = F.floor((F.col("i") % 6) / 3).cast("int")
    return words.select(
        "doc_id",
        "page",
        block.alias("block"),
        F.lit(0).alias("par"),
        line.alias("line"),
        F.col("i").alias("word"),
        (F.lit(50) + column * 550 + (F.col("i") % 3) * 90).alias("left"),
        (F.lit(100) + F.floor(block / 2).cast("int") * 80 + line * 20).alias("top"),
        (F.length("text") * 10).alias("width"),
        F.lit(15).alias("height"),
        F.when(F.col("i") % 13 == 12, -1).otherwise(60 + (F.length("text") * 7) % 40).alias("conf"),
        "text",
    )


_WORDS_SQL = r"""raw AS (SELECT item_id AS doc_id, unnest(l) AS text, unnest(range(0, len(l)))::INT AS k
      FROM (SELECT item_id, regexp_split_to_array(text, '[ \n]+') AS l FROM benchmark)),
    paged AS (SELECT doc_id, text, k // 240 AS page, k % 240 AS i FROM raw),
    boxed AS (SELECT doc_id, page, text, i, i // 6 AS block, (i % 6) // 3 AS line, 50 + ((i // 6) % 2) * 550 + (i % 3) * 90 AS l,
        100 + ((i // 6) // 2) * 80 + ((i % 6) // 3) * 20 AS t, length(text) * 10 AS w, 15 AS h,
        CASE WHEN i % 13 = 12 THEN -1 ELSE 60 + (length(text) * 7) % 40 END AS conf FROM paged),
    words AS (SELECT *, conf / 100.0::DOUBLE AS c, greatest(1, w * h) AS area FROM boxed WHERE conf >= 0 AND text <> ''),
    marked AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER p, '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]')
        THEN ' ' ELSE '' END || text AS piece FROM words WINDOW p AS (PARTITION BY doc_id, page, block, line ORDER BY l, i)),
    lines AS (SELECT doc_id, page, block, line, string_agg(piece, '' ORDER BY l, i) AS text, min(l) AS l, min(t) AS t, max(l + w) AS r, max(t + h) AS b,
        sum(area) AS area, sum(c * area) AS weighted FROM marked GROUP BY ALL),
    blocks AS (SELECT doc_id, page, block, string_agg(text, chr(10) ORDER BY t, text) AS text, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b,
        (sum(weighted) / sum(area))::DOUBLE AS confidence FROM lines GROUP BY ALL),
    sized AS (SELECT *, min(l) OVER d AS pl, greatest(1, max(r) OVER d - min(l) OVER d) AS pw, count(*) OVER d AS n FROM blocks
        WINDOW d AS (PARTITION BY doc_id, page)),
    sided AS (SELECT *, CASE WHEN r - l <= pw * 0.58 AND (l + r) / 2.0 < pl + pw / 2.0 - pw * 0.02 AND r <= pl + pw / 2.0 + pw * 0.08 THEN 'left'
        WHEN r - l <= pw * 0.58 AND (l + r) / 2.0 > pl + pw / 2.0 + pw * 0.02 AND l >= pl + pw / 2.0 - pw * 0.08 THEN 'right' ELSE 'none' END AS side FROM sized),
    framed AS (SELECT *, count(*) FILTER (side = 'left') OVER d AS ln, count(*) FILTER (side = 'right') OVER d AS rn,
        min(t) FILTER (side = 'left') OVER d AS lt, min(t) FILTER (side = 'right') OVER d AS rt,
        max(b) FILTER (side = 'left') OVER d AS lb, max(b) FILTER (side = 'right') OVER d AS rb FROM sided WINDOW d AS (PARTITION BY doc_id, page)),
    zoned AS (SELECT *, coalesce(n >= 4 AND least(ln, rn) >= 2 AND least(lb, rb) > greatest(lt, rt), false) AS multi FROM framed),
    placed AS (SELECT *, CASE WHEN NOT multi THEN 0 WHEN side = 'left' THEN 2 WHEN side = 'right' THEN 4 WHEN b < least(lt, rt) THEN 1
        WHEN t > greatest(lb, rb) THEN 5 ELSE 3 END AS zone FROM zoned),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY t, l, block) AS plain,
        row_number() OVER (PARTITION BY doc_id, page ORDER BY zone, t, l, block) AS position FROM placed)"""


def page_blocks(t: Tables) -> tuple[DataFrame, DataFrame]:
    words = ly.usable_words(page_words(t))
    return ly.reading_order(ly.build_blocks(words, ["doc_id", "page"]), ["doc_id", "page"]), words


@query(
    f"""WITH {_WORDS_SQL} SELECT doc_id, page, block, text, l AS "left", t AS top, (r - l)::INT AS width, (b - t)::INT AS height,
      round(confidence, 6) AS confidence, zone, position FROM ordered"""
)
def page_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of all pages in reading order."""
    ordered, _ = page_blocks(Tables(spark, sf))
    return ordered.select(
        "doc_id",
        "page",
        "block",
        "text",
        "left",
        "top",
        "width",
        "height",
        F.round("confidence", 6).alias("confidence"),
        "zone",
        F.col("position").cast("long").alias("position"),
    )


@query(
    rf"""WITH {_WORDS_SQL},
    trust AS (SELECT doc_id, page, (sum(c * greatest(1, length(text))) / sum(greatest(1, length(text))))::DOUBLE AS conf FROM words GROUP BY doc_id, page),
    pages AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text, count(*) AS blocks,
        count(*) FILTER (length(text) < 8) AS short, bool_or(multi) AS multi_column, bool_or(plain <> position) AS layout_reordered FROM ordered GROUP BY doc_id, page),
    q AS (SELECT *, length(regexp_replace(text, '[^一-鿿A-Za-z0-9，。！？、；：,.!?;:''"()\[\]《》<>/\-_\s]', '', 'g')) / length(text) AS readable,
        least(1.0, len(regexp_extract_all(text, '[�□■◆◇]|\\x[0-9a-fA-F]{{2}}')) / length(text) * 20.0) AS symbols FROM pages JOIN trust USING (doc_id, page))
    SELECT doc_id, page, sha256(text) AS text_hash, blocks, multi_column, layout_reordered, round(conf, 6) AS average_confidence,
      round(greatest(0.0, least(1.0, conf * 0.55::DOUBLE + readable * 0.30::DOUBLE + (1.0::DOUBLE - short / blocks) * 0.15::DOUBLE
        - symbols::DOUBLE * 0.20::DOUBLE)), 4)::DOUBLE AS quality_score FROM q"""
)
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Text, confidence and quality score of all pages."""
    ordered, words = page_blocks(Tables(spark, sf))
    report = ly.page_report(ordered, words, ["doc_id", "page"])
    return report.select(
        "doc_id",
        "page",
        F.sha2("text", 256).alias("text_hash"),
        "blocks",
        "multi_column",
        "layout_reordered",
        F.round("average_confidence", 6).alias("average_confidence"),
        "quality_score",
    )


@query(
    """WITH p AS (SELECT doc_id, doc_id // 3 AS page, n_chars, source FROM documents),
    k AS (SELECT page, count(*) AS parts, round(avg(n_chars), 4) AS average_confidence, bool_or(n_chars > 2000) AS multi_column,
        coalesce(arg_min(source, doc_id) FILTER (source <> 'src1'), '') AS repair_model,
        string_agg(source, chr(10) || chr(10) ORDER BY doc_id) AS text FROM p GROUP BY page)
    SELECT page, average_confidence, multi_column, repair_model, text FROM k"""
)
def page_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a page merged into one: ordered text, means, flags, first repair model."""
    parts = Tables(spark, sf).documents.select(
        F.floor(F.col("doc_id") / 3).alias("page"),
        "doc_id",
        F.col("source").alias("text"),
        F.col("n_chars").cast("double").alias("average_confidence"),
        F.lit(1.0).alias("quality_score"),
        (F.col("n_chars") > 2000).alias("multi_column"),
        F.lit(False).alias("layout_reordered"),
        F.when(F.col("source") != "src1", F.col("source")).otherwise("").alias("repair_model"),
    )
    return ly.combine_parts(parts, ["page"], "doc_id").select(
        "page", F.round("average_confidence", 4).alias("average_confidence"), "multi_column", "repair_model", "text"
    )


@query(
    """WITH d AS (SELECT conv_id, turn // 4 AS page, turn, trim(text, ' ' || chr(10)) AS description FROM conversations WHERE role = 'assistant')
    SELECT conv_id, page, sha256(coalesce(c, '')) AS context_hash FROM (SELECT DISTINCT conv_id, turn // 4 AS page FROM conversations) p
    LEFT JOIN (SELECT conv_id, page, string_agg(description, chr(10) ORDER BY turn) AS c FROM d WHERE description <> '' GROUP BY conv_id, page)
      USING (conv_id, page)"""
)
def page_context(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions of a page, in order, joined to it; four turns of a conversation stand for a page."""
    talks = Tables(spark, sf).conversations.withColumn("page", F.floor(F.col("turn") / 4))
    descriptions = talks.filter("role = 'assistant'").select("conv_id", "page", "turn", F.col("text").alias("description"))
    joined = ly.page_context(talks.select("conv_id", "page").distinct(), descriptions, ["conv_id", "page"], "turn")
    return joined.select("conv_id", "page", F.sha2("visual_context", 256).alias("context_hash"))
