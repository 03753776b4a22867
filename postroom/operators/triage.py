"""Message triage: flags, relevance gates, category, risk, routing.

One message is one row and every step is a projection, so the whole chain stays
in the scan's stage; nothing shuffles before retrieval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions import matching as mt
from postroom.functions import scoring as sc


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def analysis_context(subject: Column, body: Column, attachments: Column | None = None) -> Column:
    """Subject, body and one line per attachment (its preview only if there is one)."""
    base = F.concat_ws("\n\n", subject, body)
    if attachments is None:
        return base

    def line(item: Column) -> Column:
        kind = F.when(F.coalesce(item["content_type"], F.lit("")) == "", "unknown").otherwise(item["content_type"])
        head = F.concat(item["filename"], F.lit(" ("), kind, F.lit(", "), item["size_bytes"].cast("string"), F.lit(" bytes)"))
        shown = F.coalesce(item["text_preview"], F.lit("")) != ""
        return F.when(shown, F.concat_ws(": ", head, item["text_preview"])).otherwise(head)

    listed = F.array_join(F.transform(attachments, line), "\n")
    return F.when(F.coalesce(F.size(attachments), F.lit(0)) <= 0, base).otherwise(
        F.concat(base, F.lit("\n\nAttachments:\n"), listed)
    )


def preprocess(
    messages: DataFrame,
    text: str,
    *,
    flags=lx.PREPROCESS_FLAGS,
    scripts=lx.LANGUAGE_SCRIPTS,
    default_language: str = lx.DEFAULT_LANGUAGE,
    attachments: str | None = None,
) -> DataFrame:
    """Add ``language`` and the ordered ``preprocessing_flags``; ``text`` is lower case."""
    found = mt.matched_labels(text, flags)
    if attachments:
        found = F.concat(
            found, F.when(F.size(attachments) > 0, F.array(F.lit("has_attachment"))).otherwise(_empty_strings())
        )
    return messages.withColumns(
        {"language": mt.language_tag(text, scripts, default_language), "preprocessing_flags": found}
    )


def vote_category(messages: DataFrame, text: str, rules=lx.CATEGORY_VOTE, default: str = "other") -> DataFrame:
    """Add ``category``, ``confidence`` and ``matched_terms``."""
    won, votes = F.col("_best.votes") > 0, F.col("_best.votes")
    grown = F.least(F.lit(lx.VOTE_MAX_CONFIDENCE), F.lit(lx.VOTE_BASE_CONFIDENCE) + votes * F.lit(lx.VOTE_STEP_CONFIDENCE))
    return (
        messages.withColumn("_best", mt.best_ballot(text, rules))
        .withColumns(
            {
                "category": F.when(won, F.col("_best.category")).otherwise(F.lit(default)),
                "confidence": F.when(won, F.round(grown, 2)).otherwise(F.lit(lx.VOTE_NO_MATCH_CONFIDENCE)),
                "matched_terms": F.when(won, F.col("_best.matched")).otherwise(_empty_strings()),
            }
        )
        .drop("_best")
    )


def _signals(rules: lx.RiskRules, holder: str, category: str, flags: str) -> dict[str, str]:
    """Condition texts: base signals in a struct column, ``category:x``, ``flag:x`` and derived ones."""
    signals = {name: f"{holder}.{name}" for name in rules.terms}
    for rule in [*rules.derived.values(), *(step.rule for step in rules.steps)]:
        for name in [name for group in rule.any_of for name in group] + list(rule.unless):
            kind, _, value = name.partition(":")
            if kind == "category" and value:
                signals[name] = f"coalesce({category} = {mt.literal(value)}, false)"
            elif kind == "flag" and value:
                signals[name] = f"coalesce(array_contains({flags}, {mt.literal(value)}), false)"
    for name, rule in rules.derived.items():
        signals[name] = mt.rule_sql(rule, signals)
    return signals


def assess_risk(
    messages: DataFrame,
    text: str,
    *,
    rules: lx.RiskRules = lx.RISK,
    category: str = "category",
    flags: str = "preprocessing_flags",
    language: str = "language",
) -> DataFrame:
    """Add ``risk_level``, ``risk_score`` and ``risk_flags``.

    The score is the highest step that applies. A reset rule brings a score below
    its limit back to zero with a flag of its own.
    """
    found = F.struct(*[mt.has_bounded(text, terms).alias(name) for name, terms in rules.terms.items()])
    signals = _signals(rules, "_signals", category, flags)

    def in_language(texts: dict[str, str]) -> str:
        others = [(f"{language} = {mt.literal(k)}", mt.literal(v)) for k, v in texts.items() if k != rules.default_language]
        standard = mt.literal(texts[rules.default_language])
        return mt.case_sql(others, standard) if others else standard

    hits = [(mt.rule_sql(step.rule, signals), step) for step in rules.steps]
    score = ", ".join(f"CASE WHEN {hit} THEN {step.score} ELSE 0 END" for hit, step in hits)
    reasons = ", ".join(f"CASE WHEN {hit} THEN {in_language(step.flags)} END" for hit, step in hits)
    cleared = f"({mt.rule_sql(rules.reset, signals)} AND _score < {rules.reset_below})" if rules.reset else "false"
    notes = f"CASE WHEN {cleared} THEN array({in_language(rules.reset_flags)}) ELSE _reasons END" if rules.reset else "_reasons"
    levels = [(f"risk_score >= {minimum}", mt.literal(name)) for minimum, name in rules.levels]
    return (
        messages.withColumn("_signals", found)
        .withColumns(
            {
                "_score": F.expr(f"greatest(0, {score})"),
                "_reasons": F.expr(f"array_distinct(array_compact(array({reasons})))"),
            }
        )
        .withColumns(
            {"risk_score": F.expr(f"CASE WHEN {cleared} THEN 0 ELSE _score END"), "risk_flags": F.expr(notes)}
        )
        .withColumn("risk_level", F.expr(mt.case_sql(levels, mt.literal(rules.default_level))))
        .drop("_signals", "_score", "_reasons")
    )


def relevance_gate(
    messages: DataFrame,
    text: str,
    sender: str,
    *,
    rules: lx.GateRules = lx.GATE,
    uncertain_other: Column | None = None,
) -> DataFrame:
    """Add ``is_support`` and ``gate_reason``: the first step that holds rejects the message."""
    found = {name: mt.has_raw(text, terms) for name, terms in rules.terms.items()}
    found.update({name: mt.has_raw(sender, terms) for name, terms in rules.sender_terms.items()})
    found.update(
        {name: mt.has_raw(text, terms) | mt.has_raw(sender, terms) for name, terms in rules.either_terms.items()}
    )
    found["uncertain_other"] = F.lit(False) if uncertain_other is None else F.coalesce(uncertain_other, F.lit(False))
    signals = {name: f"_gate.{name}" for name in found}
    steps = [(mt.rule_sql(step.rule, signals), mt.literal(step.reason)) for step in rules.steps]
    return (
        messages.withColumn("_gate", F.struct(*[value.alias(name) for name, value in found.items()]))
        .withColumn("_rejected", F.expr(mt.case_sql(steps, "NULL")))
        .withColumns(
            {
                "is_support": F.col("_rejected").isNull(),
                "gate_reason": F.coalesce("_rejected", F.lit(rules.keep_reason)),
            }
        )
        .drop("_gate", "_rejected")
    )


def second_gate(
    messages: DataFrame,
    text: str,
    sender: str,
    *,
    analysis: str,
    verdict_is_support: Column | None = None,
    terms=lx.SECOND_GATE_TERMS,
    reasons=lx.SECOND_GATE_REASONS,
) -> DataFrame:
    """Add ``is_filtered`` and ``filter_reason`` from category, analysis text and an optional verdict.

    ``text``, ``sender`` and ``analysis`` name lower-case columns.
    """
    found = F.struct(
        mt.has_raw(analysis, terms["non_support"]).alias("in_analysis"),
        (mt.has_raw(text, terms["non_support"]) | mt.has_raw(sender, terms["non_support"])).alias("in_mail"),
        mt.has_raw(sender, terms["platform_sender"]).alias("platform"),
        mt.has_raw(text, terms["direct_request"]).alias("direct"),
    )
    other = F.coalesce(F.col("category") == "other", F.lit(False))
    signal = F.col("_found.in_analysis") | F.col("_found.in_mail") | F.col("_found.platform")
    reason = (
        F.when(other & F.col("_found.in_analysis"), F.lit(reasons["analysis"]))
        .when(other & signal & ~F.col("_found.direct"), F.lit(reasons["signals"]))
        .otherwise(F.lit(""))
    )
    if verdict_is_support is not None:
        reason = F.when(verdict_is_support.eqNullSafe(F.lit(False)), F.lit(reasons["verdict"])).otherwise(reason)
    return (
        messages.withColumn("_found", found)
        .withColumn("filter_reason", reason)
        .withColumn("is_filtered", F.col("filter_reason") != "")
        .drop("_found")
    )


def mark_irrelevant(messages: DataFrame, irrelevant: Column, language: str = "language") -> DataFrame:
    """Reset the outcome columns of rejected rows; others pass unchanged."""
    note = F.lit(lx.IRRELEVANT_NOTE["en"])
    for tag, value in lx.IRRELEVANT_NOTE.items():
        note = F.when(F.col(language) == tag, F.lit(value)).otherwise(note)
    defaults: dict[str, Column] = {
        "status": F.lit("irrelevant"),
        "category": F.lit("other"),
        "priority": F.lit("low"),
        "risk_level": F.lit("low"),
        "risk_flags": _empty_strings(),
        "should_escalate": F.lit(False),
        "draft_reply": F.lit(""),
        "review_note": note,
    }
    types = dict(messages.dtypes)
    if "knowledge_hits" in types:
        defaults["knowledge_hits"] = F.array().cast(types["knowledge_hits"])
    flagged = messages.withColumn("_irrelevant", F.coalesce(irrelevant, F.lit(False)))
    return flagged.withColumns(
        {
            name: F.when(F.col("_irrelevant"), value).otherwise(F.col(name))
            for name, value in defaults.items()
            if name in types
        }
    ).drop("_irrelevant")


def merge_risk(
    level: Column, flags: Column, rule_level: Column, rule_flags: Column, order: Sequence[str] = lx.RISK_LEVELS
) -> Column:
    """Struct (level, flags): the higher level, and both flag lists without repeats."""
    rules_win = sc.level_rank(rule_level, order) > sc.level_rank(level, order)
    return F.struct(
        F.when(rules_win, rule_level).otherwise(level).alias("level"),
        F.array_distinct(F.concat(flags, rule_flags)).alias("flags"),
    )


def apply_verdicts(messages: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Join validated model verdicts onto rule results; a verdict may raise the risk, never lower it.

    ``verdicts`` has ``key`` and a struct ``verdict``; messages without one keep the rules.
    """
    joined = messages.join(verdicts.select(key, "verdict"), key, "left")
    given = F.col("verdict").isNotNull()
    merged = merge_risk(
        F.col("verdict.risk_level"),
        F.coalesce(F.col("verdict.risk_flags"), _empty_strings()),
        F.col("risk_level"),
        F.col("risk_flags"),
    )
    return (
        joined.withColumn("_merged", F.when(given, merged))
        .withColumns(
            {
                "raised_by_rules": given & (F.col("_merged.level") != F.col("verdict.risk_level")),
                "category": F.coalesce(F.col("verdict.category"), F.col("category")),
                "confidence": F.coalesce(F.round(F.col("verdict.confidence"), 2), F.col("confidence")),
                "risk_level": F.coalesce(F.col("_merged.level"), F.col("risk_level")),
                "risk_flags": F.coalesce(F.col("_merged.flags"), F.col("risk_flags")),
            }
        )
        .withColumns({"priority": F.col("risk_level"), "should_escalate": F.col("risk_level") == "high"})
        .drop("_merged")
    )


def reliable_hits(hits: Column, minimum: str = "medium", limit: int | None = None) -> Column:
    """Hits of at least the given reliability, the first ``limit`` of them."""
    floor = lx.RELIABILITY_LEVELS.index(minimum)
    kept = F.filter(hits, lambda hit: sc.level_rank(hit["reliability"], lx.RELIABILITY_LEVELS) >= floor)
    return F.slice(kept, 1, limit) if limit else kept


def review_route(
    risk_level: Column, should_escalate: Column, category: Column, confidence: Column, hits: Column
) -> Column:
    """``ready_to_send`` for safe, certain and well-grounded messages, else ``human_review``."""
    grounded = F.size(reliable_hits(hits, "strong")) > 0
    known = category.isNotNull() & (category != "other")
    ready = (risk_level == "low") & ~should_escalate & known & (confidence >= lx.READY_CONFIDENCE) & grounded
    return F.when(F.coalesce(ready, F.lit(False)), F.lit("ready_to_send")).otherwise(F.lit("human_review"))


def analysis_reason(matched: Column, flags: Column, risk_level: Column, language: Column) -> Column:
    """One sentence on matched terms, flags and the final level, in the message language."""

    def listed(values: Column, separator: str, empty: str) -> Column:
        return F.when(F.size(values) > 0, F.array_join(values, separator)).otherwise(F.lit(empty))

    chinese = F.concat(
        F.lit("语义分析识别到分类线索："), listed(matched, "、", "无明显关键词"), F.lit("；预处理标记："),
        listed(flags, "、", "无强规则标记"), F.lit("；综合风险等级为 "), risk_level, F.lit("。"),
    )
    english = F.concat(
        F.lit("Semantic analysis found category signals: "), listed(matched, ", ", "no strong category signals"),
        F.lit("; preprocessing flags: "), listed(flags, ", ", "no strong rule flags"),
        F.lit("; final risk level is "), risk_level, F.lit("."),
    )
    return F.when(language == "zh", chinese).otherwise(english)


def triage(messages: DataFrame, *, subject: str, body: str, sender: str) -> DataFrame:
    """The full rule-only chain with the default rules, up to the two gates."""
    ready = messages.withColumns(
        {
            "_text": F.lower(analysis_context(F.col(subject), F.col(body))),
            "_sender": F.lower(F.col(sender)),
        }
    )
    ready = preprocess(ready, "_text")
    ready = relevance_gate(ready, "_text", "_sender")
    ready = assess_risk(vote_category(ready, "_text"), "_text")
    reason = analysis_reason(F.col("matched_terms"), F.col("preprocessing_flags"), F.col("risk_level"), F.col("language"))
    ready = ready.withColumn("analysis_reason", reason)
    ready = ready.withColumn("_analysis", F.lower(F.concat_ws("\n", "analysis_reason", F.array_join("risk_flags", " "))))
    ready = second_gate(ready, "_text", "_sender", analysis="_analysis")
    ready = ready.withColumns(
        {
            "status": F.lit("processed"),
            "priority": F.col("risk_level"),
            "should_escalate": F.col("risk_level") == "high",
        }
    )
    return mark_irrelevant(ready, ~F.col("is_support") | F.col("is_filtered")).drop("_text", "_sender", "_analysis")
