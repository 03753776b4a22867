"""Queries over event logs: import, upsert, versions, actions, tickets, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.operators import lifecycle as lc
from postroom.operators import sequence as seq
from postroom.plans.registry import Tables, query
from postroom.session import cut_lineage
from postroom.sources import tables as tb

ACTIONS = {"signup": "approve", "click": "revise", "error": "escalate", "purchase": "undo_escalate"}
TICKET_ACTIONS = {"signup": "open", "click": "assign", "purchase": "resolve", "error": "return_to_review"}
IMPORT_LIMIT = 300
AS_OF = "2024-01-31 00:00:00"


def _case(mapping: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _mapped(mapping: dict[str, str]):
    return lc._mapped(mapping, F.col("event_type"))


def day():
    return F.to_date("ts")


@query(
    f"""WITH newest AS (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
    marked AS (SELECT n.*, k.event_id IS NULL AS is_new FROM (SELECT * FROM newest WHERE r <= {IMPORT_LIMIT}) n
      LEFT JOIN (SELECT DISTINCT event_type, event_id FROM events WHERE ts < TIMESTAMP '2024-01-27') k
      USING (event_type, event_id))
    SELECT event_type, count(*) FILTER (is_new) AS queued_count, count(*) FILTER (NOT is_new) AS skipped_count
    FROM marked GROUP BY event_type"""
)
def incremental_import(spark: SparkSession, sf: str) -> DataFrame:
    """Newest messages per provider against the ids already stored."""
    events = Tables(spark, sf).events
    marked = lc.split_import(
        events,
        events.filter(F.col("ts") < F.lit("2024-01-27").cast("timestamp_ntz")),
        ["event_type", "event_id"],
        [F.col("ts").desc(), F.col("event_id").desc()],
        IMPORT_LIMIT,
        "event_type",
    )
    return lc.import_counts(marked, "event_type")


@query(
    """WITH changes AS (
      SELECT o_orderkey, o_custkey, 'R' AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice, 2 AS revision
      FROM orders WHERE o_orderpriority = '1-URGENT'
      UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, 2 FROM orders WHERE o_orderstatus = 'P')
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 1 AS revision FROM orders
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes) UNION ALL SELECT * FROM changes"""
)
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert of changed and new orders by key."""
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    stored = orders.drop("o_orderpriority").withColumn("revision", F.lit(1))
    changed = orders.filter("o_orderpriority = '1-URGENT'").select(
        "o_orderkey",
        "o_custkey",
        F.lit("R").alias("o_orderstatus"),
        F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"),
        F.lit(2).alias("revision"),
    )
    new = stored.filter("o_orderstatus = 'P'").withColumns(
        {"o_orderkey": F.col("o_orderkey") + 100000000, "revision": F.lit(2)}
    )
    return lc.upsert(stored, changed.unionByName(new), ["o_orderkey"])


@query(
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
      max(ts) AS ts FROM events GROUP BY user_id"""
)
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Newest event of every user."""
    events = Tables(spark, sf).events.select("user_id", "event_id", "event_type", "ts")
    return seq.latest(events, ["user_id"], ["ts", "event_id"])


_HISTORY_SQL = """revisions AS (
      SELECT user_id, event_id, ts, event_type AS title, (floor(value / 25))::BIGINT AS content FROM events),
    compared AS (
      SELECT *, lag(event_id) OVER w IS NULL AS is_first, lag(title) OVER w AS p_title, lag(content) OVER w AS p_content
      FROM revisions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    versions AS (
      SELECT user_id, event_id, title, content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_number
      FROM compared WHERE is_first OR title IS DISTINCT FROM p_title OR content IS DISTINCT FROM p_content)"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    revisions = Tables(spark, sf).events.select(
        "user_id", "event_id", "ts", F.col("event_type").alias("title"), F.floor(F.col("value") / 25).alias("content")
    )
    return lc.version_history(revisions, ["user_id"], ["ts", "event_id"], ["title", "content"], day()).drop("ts")


def _stored_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The version table as it would be stored, for queries that read it several times."""
    return cut_lineage(_versions(spark, sf))


@query(f"WITH {_HISTORY_SQL} SELECT * FROM versions")
def version_history(spark: SparkSession, sf: str) -> DataFrame:
    """Version numbers of the revisions that change something."""
    return _versions(spark, sf)


@query(
    f"""WITH {_HISTORY_SQL}, targets AS (
      SELECT user_id, ceil(max(version_number) / 2.0)::BIGINT AS target_version FROM versions GROUP BY user_id)
    SELECT user_id, max(version_number) AS current_version, count(*) AS versions, sum(event_id)::BIGINT AS id_sum
    FROM versions LEFT JOIN targets USING (user_id)
    WHERE target_version IS NULL OR version_number <= target_version GROUP BY user_id"""
)
def version_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Roll all documents back to the middle of their history."""
    versions = _stored_versions(spark, sf)
    targets = (
        versions.groupBy("user_id")
        .agg(F.ceil(F.max("version_number") / F.lit(2.0)).alias("target_version"))
    )
    return (
        lc.restore_version(versions, targets, "user_id")
        .groupBy("user_id")
        .agg(
            F.max("version_number").alias("current_version"),
            F.count("*").alias("versions"),
            F.sum("event_id").alias("id_sum"),
        )
    )


@query(
    f"""WITH {_HISTORY_SQL}, requests AS (
      SELECT user_id, max(version_number) AS version_number FROM versions GROUP BY user_id
      UNION ALL SELECT user_id, 1 FROM versions WHERE version_number = 2),
    current AS (SELECT user_id, max(version_number) AS c FROM versions GROUP BY user_id)
    SELECT user_id, count(*) AS versions, min(version_number) AS first_version,
           (SELECT count(*) FROM requests r WHERE r.user_id = v.user_id AND r.version_number = c.c) AS rejected
    FROM versions v JOIN current c USING (user_id)
    WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.user_id = v.user_id AND r.version_number = v.version_number
                      AND r.version_number < c.c)
    GROUP BY user_id, c.c"""
)
def version_delete_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Delete first and current versions; the current ones are refused."""
    versions = _stored_versions(spark, sf)
    requests = (
        versions.groupBy("user_id")
        .agg(F.max("version_number").alias("version_number"))
        .unionByName(
            versions.filter("version_number = 2").select("user_id", F.lit(1).cast("long").alias("version_number"))
        )
    )
    kept, rejected = lc.delete_versions(versions, requests, "user_id")
    refused = rejected.groupBy("user_id").agg(F.count("*").alias("rejected"))
    return (
        kept.groupBy("user_id")
        .agg(F.count("*").alias("versions"), F.min("version_number").alias("first_version"))
        .join(refused, "user_id", "left")
        .withColumn("rejected", F.coalesce("rejected", F.lit(0)))
    )


@query(
    """WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, event_id, event_type FROM c WHERE p IS NULL OR p <> event_type"""
)
def suppress_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Drop an action equal to the one before it."""
    events = Tables(spark, sf).events.select("user_id", "event_id", "event_type", "ts")
    return seq.keep_changes(events, ["user_id"], ["ts", "event_id"], ["event_type"], day()).drop("ts")


_ACTIONS_SQL = f"actions AS (SELECT *, {_case(ACTIONS)} AS action FROM events WHERE event_type <> 'view')"


def actions(t: Tables) -> DataFrame:
    return t.events.filter("event_type <> 'view'").withColumn("action", _mapped(ACTIONS))


@query(
    f"""WITH {_ACTIONS_SQL}
    SELECT user_id, arg_max(CASE action WHEN 'approve' THEN 'ready_to_send' WHEN 'revise' THEN 'needs_revision'
        WHEN 'escalate' THEN 'escalated' ELSE 'human_review' END, (ts, event_id)) AS status,
      arg_max(action, (ts, event_id)) AS last_action, bool_or(action = 'approve') AS has_approval,
      arg_max(props, (ts, event_id)) FILTER (action = 'revise') AS draft_reply,
      arg_max(action, (ts, event_id)) FILTER (action IN ('escalate', 'undo_escalate')) = 'escalate' AS last_escalates
    FROM actions GROUP BY user_id"""
)
def last_relevant_action(spark: SparkSession, sf: str) -> DataFrame:
    """Status, draft and escalation flag of each message after its review log."""
    log = actions(Tables(spark, sf))
    status = lc.message_status(log, "user_id", ["ts", "event_id"], draft="props")
    return status.join(lc.escalation_history(log, "user_id", ["ts", "event_id"]), "user_id", "left")


TICKETS_SQL = f"""ticket_log AS (
      SELECT *, {_case(TICKET_ACTIONS)} AS action, 'op' || (event_id % 7) AS operator FROM events WHERE event_type <> 'view'),
    prior AS (SELECT *, lag(action) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ticket_log),
    numbered AS (SELECT *, (sum(CASE WHEN p IS NULL OR (action = 'open' AND p IN ('resolve', 'return_to_review')) THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS ticket_number FROM prior),
    tickets AS (SELECT user_id, ticket_number,
        coalesce(arg_max(CASE action WHEN 'assign' THEN 'assigned' WHEN 'resolve' THEN 'resolved' ELSE 'returned' END, (ts, event_id))
            FILTER (action <> 'open'), 'open') AS status,
        min(ts) AS opened_at, max(ts) AS updated_at, arg_min(operator, (ts, event_id)) AS created_by,
        coalesce(arg_max(operator, (ts, event_id)) FILTER (action = 'assign'),
                 arg_min(operator, (ts, event_id)) FILTER (action IN ('resolve', 'return_to_review')), '') AS assigned_to,
        count(*) AS event_count
      FROM numbered GROUP BY user_id, ticket_number)"""


def ticket_log(t: Tables) -> DataFrame:
    return t.events.filter("event_type <> 'view'").select(
        "user_id",
        "event_id",
        "ts",
        _mapped(TICKET_ACTIONS).alias("action"),
        F.concat(F.lit("op"), (F.col("event_id") % 7).cast("string")).alias("operator"),
    )


def tickets(t: Tables) -> DataFrame:
    return lc.tickets(ticket_log(t), "user_id", ["ts", "event_id"], day())


@query(f"WITH {TICKETS_SQL} SELECT * FROM tickets")
def ticket_state(spark: SparkSession, sf: str) -> DataFrame:
    """All escalation tickets with their state, folded from the action log."""
    return tickets(Tables(spark, sf))


@query(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
        - 0 AS n, coalesce(sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events)
    SELECT user_id, event_id, 'alternative-' || (b % 3 + 1)::BIGINT AS reply_variant FROM c"""
)
def reply_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Reply style that the next regeneration would take, at each event."""
    events = Tables(spark, sf).events.select("user_id", "event_id", "event_type", "ts")
    return lc.reply_variant(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", day()).select(
        "user_id", "event_id", "reply_variant"
    )


@query(
    f"""SELECT event_type, count(*) FILTER (NOT doomed) AS kept, count(*) FILTER (doomed) AS removed FROM (
      SELECT *, ts < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND event_type = 'error' AS doomed FROM events) GROUP BY event_type"""
)
def retention_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Purge of one scope of an audit log by age: rows kept and removed."""
    kept, removed = lc.purge_log(Tables(spark, sf).events, "ts", AS_OF, 14, ("event_type", "error"))
    return (
        kept.select("event_type", F.lit(1).alias("k"), F.lit(0).alias("r"))
        .unionByName(removed.select("event_type", F.lit(0).alias("k"), F.lit(1).alias("r")))
        .groupBy("event_type")
        .agg(F.sum("k").alias("kept"), F.sum("r").alias("removed"))
    )


@query(
    """WITH eligible AS (SELECT o_orderkey FROM orders
        WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY AND o_orderstatus IN ('F', 'P'))
    SELECT l_returnflag, l_linestatus, count(*) AS traces, round(sum(l_quantity), 2) AS quantity,
        l_orderkey IN (SELECT o_orderkey FROM eligible) AS removed
    FROM lineitem GROUP BY l_returnflag, l_linestatus, removed"""
)
def trace_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Purge of the lines of closed, old orders."""
    t = Tables(spark, sf)
    parents = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus")
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    kept, removed = lc.purge_traces(
        lines, parents, "l_orderkey", "o_orderdate", "o_orderstatus", "1998-01-01 00:00:00", 365, ("F", "P")
    )
    both = kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))
    return both.groupBy("l_returnflag", "l_linestatus", "removed").agg(
        F.count("*").alias("traces"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    """WITH last AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r,
        count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    nested AS (SELECT l_orderkey, max(n) AS n,
        string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS c
      FROM last WHERE r <= 3 GROUP BY l_orderkey)
    SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS child_count, coalesce(c, '') AS last_children
    FROM orders LEFT JOIN nested ON o_orderkey = l_orderkey"""
)
def nested_children(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their line count and the last three lines in order."""
    t = Tables(spark, sf)
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = lc.nest_last_children(
        t.orders.select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], [], 3
    )
    shown = F.transform(
        "last_children", lambda c: F.concat_ws(":", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string"))
    )
    return nested.select(
        "o_orderkey", "o_orderstatus", "child_count", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("last_children")
    )


@query(
    """SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_orderkey IS NOT NULL AS has_child
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"""
)
def ordered_children(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with all their lines in long form."""
    t = Tables(spark, sf)
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return lc.attach_children(t.orders.select("o_orderkey", "o_orderstatus"), lines, "o_orderkey")


@query(
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events"""
)
def child_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every event within its user."""
    events = Tables(spark, sf).events.select("user_id", "event_id", "ts")
    return seq.numbered(events, ["user_id"], ["ts", "event_id"], day(), "position").drop("ts")


@query("SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred newest log rows; the limit is the report."""
    events = Tables(spark, sf).events.select("event_id", "user_id", "event_type", "ts")
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query(
    """SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, 'indexed' AS status, lang
    FROM documents LEFT JOIN labels USING (doc_id)"""
)
def schema_evolution(spark: SparkSession, sf: str) -> DataFrame:
    """Old rows without the label columns next to new ones: missing columns take their default."""
    t = Tables(spark, sf)
    docs = t.documents.select("doc_id", "lang")
    old = docs.join(t.labels.select("doc_id"), "doc_id", "left_anti")
    new = docs.join(t.labels, "doc_id")
    defaults = {"quality": F.lit(-1), "toxic": F.lit(0), "status": F.lit("indexed")}
    merged = new.unionByName(old, allowMissingColumns=True)
    return tb.evolve(merged, defaults).select("doc_id", "quality", "toxic", "status", "lang")


@query(
    f"""SELECT coalesce({_case(ACTIONS)}, event_type) AS scope, count(*) AS rows, min(ts) AS first_at, max(ts) AS last_at,
      round(sum(value), 4) AS detail_total FROM events GROUP BY 1"""
)
def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of all events with a JSON detail, read back per scope."""
    events = Tables(spark, sf).events
    rows = tb.audit_rows(
        events.withColumn("action", F.coalesce(_mapped(ACTIONS), F.col("event_type"))),
        scope="email",
        action="review",
        title=F.col("action"),
        summary=F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string")),
        detail=["event_id", "value", "action"],
        at=F.col("ts"),
    )
    detail = F.from_json("detail", "event_id bigint, value double, action string")
    return (
        rows.select(detail.alias("d"), "created_at")
        .groupBy(F.col("d.action").alias("scope"))
        .agg(
            F.count("*").alias("rows"),
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("last_at"),
            F.round(F.sum("d.value"), 4).alias("detail_total"),
        )
    )


@query(
    """SELECT event_type, (SELECT count(*) > 0 FROM events e WHERE e.event_type = t.event_type AND value > 500) AS has_large,
      count(*) AS known FROM events t GROUP BY event_type"""
)
def existence_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Does a provider have a message above a value, and how many are known?"""
    return (
        Tables(spark, sf)
        .events.groupBy("event_type")
        .agg(F.bool_or(F.col("value") > 500).alias("has_large"), F.count("*").alias("known"))
    )
