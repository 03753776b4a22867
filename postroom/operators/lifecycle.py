"""Import, upsert, versions, review actions, tickets and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions.text import snippet
from postroom.operators import sequence as seq


def _mapped(values: Mapping[str, str], column: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in values.items() for part in pair])
    return F.try_element_at(table, column)


def split_import(
    incoming: DataFrame, known: DataFrame, key: Sequence[str], newest_first: Sequence[Column], limit: int, source: str
) -> DataFrame:
    """Newest ``limit`` rows per source, each marked ``is_new`` unless its key is known."""
    candidates = seq.newest(incoming, [source], newest_first, limit).drop("_rank")
    seen = known.select(*key).distinct().withColumn("_seen", F.lit(True))
    return (
        candidates.join(seen, list(key), "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")
    )


def import_counts(marked: DataFrame, source: str) -> DataFrame:
    return marked.groupBy(source).agg(
        F.count_if("is_new").alias("queued_count"), F.count_if(~F.col("is_new")).alias("skipped_count")
    )


def upsert(existing: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Changed rows replace stored ones with the same key; also replaces children by parent key."""
    touched = changes.select(*key).distinct()
    return existing.join(touched, list(key), "left_anti").unionByName(changes, allowMissingColumns=True)


def version_history(
    revisions: DataFrame, key: Sequence[str], order: Sequence[str], compared: Sequence[str], stretch: Column
) -> DataFrame:
    """Drop revisions equal to the one before; number the rest from 1."""
    kept = seq.keep_changes(revisions, key, order, compared, stretch, keep_stretch=True)
    return seq.numbered(kept, key, order, stretch, "version_number")


def restore_version(versions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Roll back: keep versions up to ``target_version``, which becomes the current one."""
    joined = versions.join(targets.select(key, "target_version"), key, "left")
    kept = joined.filter(F.col("target_version").isNull() | (F.col("version_number") <= F.col("target_version")))
    return kept.drop("target_version")


def delete_versions(versions: DataFrame, requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(remaining, rejected): the current version of a document cannot be deleted."""
    current = versions.groupBy(key).agg(F.max("version_number").alias("_current"))
    judged = requests.join(current, key)
    allowed = judged.filter(F.col("version_number") < F.col("_current")).select(key, "version_number")
    rejected = judged.filter(F.col("version_number") == F.col("_current")).select(key, "version_number")
    return versions.join(allowed, [key, "version_number"], "left_anti"), rejected


def message_status(
    actions: DataFrame, key: str, order: Sequence[str], action: str = "action", draft: str | None = None
) -> DataFrame:
    """Status after the last review action; ``revise`` with a text also replaces the draft."""
    known = actions.filter(F.col(action).isin(*lx.ACTION_STATUS))
    at = F.struct(*order)
    aggregates = [
        F.max_by(_mapped(lx.ACTION_STATUS, F.col(action)), at).alias("status"),
        F.max_by(F.col(action), at).alias("last_action"),
        F.bool_or(F.col(action) == "approve").alias("has_approval"),
    ]
    if draft:
        edited = (F.col(action) == "revise") & (F.coalesce(F.col(draft), F.lit("")) != "")
        aggregates.append(F.max_by(F.col(draft), F.when(edited, at)).alias("draft_reply"))
    return known.groupBy(key).agg(*aggregates)


def escalation_history(actions: DataFrame, key: str, order: Sequence[str], action: str = "action") -> DataFrame:
    """True where the last of escalate / undo_escalate is an escalation, null without either."""
    relevant = F.when(F.col(action).isin("escalate", "undo_escalate"), F.struct(*order))
    return actions.groupBy(key).agg((F.max_by(F.col(action), relevant) == "escalate").alias("last_escalates"))


def has_escalation_history(last_escalates: Column, ticket_status: Column) -> Column:
    fallback = F.coalesce(ticket_status.isin("open", "assigned", "resolved"), F.lit(False))
    return F.coalesce(last_escalates, fallback)


def has_active_escalation(status: Column, ticket_status: Column) -> Column:
    active = F.coalesce(ticket_status.isin(*lx.ACTIVE_TICKETS), F.lit(False))
    return (F.coalesce(status, F.lit("")) == "escalated") | active


def tickets(
    events: DataFrame, key: str, order: Sequence[str], stretch: Column, action: str = "action", operator: str = "operator"
) -> DataFrame:
    """Tickets per message from a log of open / assign / resolve / return_to_review.

    ``open`` reuses a ticket that is open or assigned; every other action works on
    the newest ticket and creates one if there is none. So a ticket starts on the
    first event and on each ``open`` right after a resolve or return.
    """
    log = seq.with_previous(events, [key], order, F.col(action), stretch, "_prior", keep_stretch=True)
    starts = F.col("_prior").isNull() | (
        (F.col(action) == "open") & F.col("_prior").isin("resolve", "return_to_review")
    )
    log = log.withColumn("_starts", starts.cast("long"))
    log = seq.with_running_sum(log, [key], order, F.col("_starts"), stretch, "ticket_number")
    at = F.struct(*order)
    ends = F.col(action).isin("resolve", "return_to_review")
    assigned = F.max_by(F.col(operator), F.when(F.col(action) == "assign", at))
    closed_by = F.min_by(F.col(operator), F.when(ends, at))
    last_status = F.max_by(_mapped(lx.TICKET_STATUS, F.col(action)), F.when(F.col(action) != "open", at))
    return log.groupBy(key, "ticket_number").agg(
        F.coalesce(last_status, F.lit("open")).alias("status"),
        F.min(order[0]).alias("opened_at"),
        F.max(order[0]).alias("updated_at"),
        F.min_by(F.col(operator), at).alias("created_by"),
        F.coalesce(assigned, closed_by, F.lit("")).alias("assigned_to"),
        F.count("*").alias("event_count"),
    )


def reply_variant(
    steps: DataFrame, key: Sequence[str], order: Sequence[str], is_regeneration: Column, stretch: Column
) -> DataFrame:
    """Cycle of reply styles: regenerations before this one, modulo 3, plus 1."""
    counted = seq.with_running_sum(steps, key, order, is_regeneration.cast("long"), stretch, "_upto")
    before = F.col("_upto") - is_regeneration.cast("long")
    return counted.withColumn("reply_variant", F.concat(F.lit("alternative-"), (before % 3 + 1).cast("string"))).drop(
        "_upto"
    )


def is_expired(created_at: Column, as_of: str, days: int) -> Column:
    return created_at < F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {days} DAYS")


def purge_log(log: DataFrame, created_at: str, as_of: str, days: int = 180, scope: tuple[str, str] | None = None):
    """(kept, removed) audit rows by age; ``scope`` = (column, value) limits the purge."""
    doomed = F.coalesce(is_expired(F.col(created_at), as_of, days), F.lit(False))
    if scope:
        doomed = doomed & F.coalesce(F.col(scope[0]) == scope[1], F.lit(False))
    return log.filter(~doomed), log.filter(doomed)


def purge_traces(
    traces: DataFrame, parents: DataFrame, key: str, updated_at: str, status: str, as_of: str, days: int = 30,
    closed: Sequence[str] = lx.CLOSED_STATUSES,
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) trace rows; rows of closed parents older than ``days`` go."""
    eligible = parents.filter(is_expired(F.col(updated_at), as_of, days) & F.col(status).isin(*closed)).select(key)
    return traces.join(eligible, key, "left_anti"), traces.join(eligible, key, "left_semi")


def document_status(valid: Column, reason: Column, message: str = "Indexed.") -> Column:
    """Struct (status, status_message): processing ends as indexed, or failed with a short reason."""
    return F.struct(
        F.when(valid, F.lit("indexed")).otherwise(F.lit("failed")).alias("status"),
        F.when(valid, F.lit(message)).otherwise(snippet(reason, 220)).alias("status_message"),
    )


ROWS_OF_A_TASK = 500_000


def attach_children(parents: DataFrame, children: DataFrame, key: str, task_rows: int = ROWS_OF_A_TASK) -> DataFrame:
    """Parents with their children in long form; whole whatever the number of children.

    An inner join plus the childless parents. The join has a task per ``task_rows`` rows, as rows that compress well
    would else fill one task's memory. The children of a parent with more than that many take part in a join of their
    own, which may split them over tasks; a left join does not allow that for its right side.
    """
    rows = parents.count() + children.count()
    counts = children.groupBy(key).agg(F.count("*").alias("_children"))
    if rows > task_rows:
        tasks = max(children.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))
        hot = F.broadcast(counts.filter(F.col("_children") > task_rows).select(key))  # at most one in task_rows rows
        dealt = parents.repartition(tasks, key)
        even = dealt.join(children.join(hot, key, "left_anti").repartition(tasks, key), key)
        joined = even.unionByName(parents.join(hot, key, "left_semi").join(children.join(hot, key, "left_semi"), key))
    else:
        dealt = parents
        joined = parents.join(children, key)
    childless = dealt.join(counts.select(key), key, "left_anti").withColumn("has_child", F.lit(False))
    return joined.withColumn("has_child", F.lit(True)).unionByName(childless, allowMissingColumns=True)


def nest_last_children(
    parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], count: int = 3
) -> DataFrame:
    """Parents with the last ``count`` children as an ordered array, and the full child count.

    Shows the end of a history the way a detail view does; the whole list stays
    available from :func:`attach_children`.
    """
    last = seq.newest(children, [key], [F.col(name).desc() for name in order], count)
    nested = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *fields))).alias("last_children"))
    totals = children.groupBy(key).agg(F.count("*").alias("child_count"))
    return (
        parents.join(totals, key, "left")
        .join(nested, key, "left")
        .withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    )


def visible_to(role: str, status: Column, ticket_status: Column) -> Column:
    """Agents lose sight of a message while its escalation is active."""
    return F.lit(True) if role != "agent" else ~has_active_escalation(status, ticket_status)


def queue_flags(role: str = "admin") -> dict[str, Column]:
    """Queue membership over columns status, priority, confidence, ticket_status,
    last_escalates, has_approval and strong_grounding."""
    status, priority = F.col("status"), F.col("priority")
    active = has_active_escalation(status, F.col("ticket_status"))
    history = has_escalation_history(F.col("last_escalates"), F.col("ticket_status"))
    approved = F.coalesce(F.col("has_approval"), F.lit(False))
    done = status.isin("irrelevant", "sent", "processed")
    listed = status.isin("human_review", "needs_revision", "escalated") | (priority == "high")
    general = F.when(status == "ready_to_send", approved | history).otherwise(listed)
    if role == "manager":
        general = active | history
    review = ~done & general
    if role == "agent":
        review = review & ~active
    ready = status == "ready_to_send"
    return {
        "in_review_queue": review,
        "low_risk_ready": ready & (priority == "low") & (F.col("confidence") >= lx.BULK_READY_CONFIDENCE)
        & F.col("strong_grounding") & ~approved & ~history,
        "in_escalation_queue": active | history,
        "can_send": ready & ~history if role == "agent" else ready,
    }


def bulk_send_ready(ready: DataFrame, viewed: DataFrame, key: str) -> DataFrame:
    """One row: can all ready messages be sent at once, i.e. has each been viewed?"""
    seen = viewed.select(key).distinct().withColumn("_viewed", F.lit(1))
    counts = ready.join(seen, key, "left").agg(F.count("*").alias("ready"), F.count("_viewed").alias("viewed"))
    return counts.withColumn("can_bulk_send", (F.col("ready") > 0) & (F.col("ready") == F.col("viewed")))
