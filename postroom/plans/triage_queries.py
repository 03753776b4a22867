"""Queries over messages: flags, categories, risk, gates, verdicts, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import matching as mt
from postroom.functions import quality as ql
from postroom.functions import scoring as sc
from postroom.functions.lexicon import (
    CORRUPT_MARKERS,
    COMMON_HANZI,
    MOJIBAKE_MARKERS,
    MOJIBAKE_RUNS,
    VOTE_BASE_CONFIDENCE,
    VOTE_MAX_CONFIDENCE,
    VOTE_NO_MATCH_CONFIDENCE,
    VOTE_STEP_CONFIDENCE,
)
from postroom.operators import expectations as ex
from postroom.operators import triage as tr
from postroom.plans import rules as ru
from postroom.plans import sql
from postroom.plans.registry import Tables, query


def assessed(df: DataFrame) -> DataFrame:
    """Flags, category vote and risk over a lower-case column ``t``."""
    flagged = tr.preprocess(df, "t", flags=ru.FLAGS, scripts=ru.SCRIPTS, default_language=ru.DEFAULT_LANGUAGE)
    return tr.assess_risk(tr.vote_category(flagged, "t", ru.VOTE), "t", rules=ru.RISK)


def assessed_sql(source: str) -> str:
    """CTEs ending in ``assessed`` over a relation with a lower-case column ``t``."""
    votes = [
        "(" + " + ".join(f"contains(t, {sql.text(term)})::INT" for term in sorted(terms)) + f") AS v{i}"
        for i, (_, terms) in enumerate(ru.VOTE)
    ]
    matched = [
        sql.compact(f"CASE WHEN contains(t, {sql.text(term)}) THEN {sql.text(term)} END" for term in sorted(terms))
        + f" AS m{i}"
        for i, (_, terms) in enumerate(ru.VOTE)
    ]
    best = "greatest(" + ", ".join(f"v{i}" for i in range(len(ru.VOTE))) + ")"
    category = " ".join(f"WHEN v{i} = best THEN {sql.text(name)}" for i, (name, _) in enumerate(ru.VOTE))
    terms = " ".join(f"WHEN v{i} = best THEN m{i}" for i in range(len(ru.VOTE)))
    base = ", ".join(f"{sql.bounded('t', words)} AS {name}" for name, words in ru.RISK.terms.items())
    derived = ", ".join(f"{sql.holds(rule)} AS {name}" for name, rule in ru.RISK.derived.items())

    def flag(texts: dict[str, str]) -> str:
        return f"CASE WHEN language = 'de' THEN {sql.text(texts['de'])} ELSE {sql.text(texts['en'])} END"

    score = "greatest(0, " + ", ".join(
        f"CASE WHEN {sql.holds(step.rule)} THEN {step.score} ELSE 0 END" for step in ru.RISK.steps
    ) + ")"
    flags = sql.compact(f"CASE WHEN {sql.holds(step.rule)} THEN {flag(step.flags)} END" for step in ru.RISK.steps)
    distinct = "list_filter(raw_flags, lambda x, i: list_position(raw_flags, x) = i)"
    return f"""
    lang AS (
      SELECT *, {sql.language('t', ru.SCRIPTS, ru.DEFAULT_LANGUAGE)} AS language,
             {sql.labels('t', ru.FLAGS)} AS preprocessing_flags,
             {', '.join(votes)}, {', '.join(matched)}
      FROM {source}
    ),
    voted AS (
      SELECT *, CASE WHEN best = 0 THEN 'other' {category} END AS category,
             CASE WHEN best = 0 THEN {VOTE_NO_MATCH_CONFIDENCE}::DOUBLE
                  ELSE round(least({VOTE_MAX_CONFIDENCE}::DOUBLE,
                       {VOTE_BASE_CONFIDENCE}::DOUBLE + best * {VOTE_STEP_CONFIDENCE}::DOUBLE), 2) END AS confidence,
             CASE WHEN best = 0 THEN []::VARCHAR[] {terms} END AS matched_terms
      FROM (SELECT *, {best} AS best FROM lang)
    ),
    signalled AS (
      SELECT *, {base}, category = 'refund' AS category_refund, category = 'billing' AS category_billing,
             category = 'complaint' AS category_complaint,
             list_contains(preprocessing_flags, 'legal_risk') AS flag_legal_risk,
             list_contains(preprocessing_flags, 'business_blocked') AS flag_business_blocked
      FROM voted
    ),
    derived AS (SELECT *, {derived} FROM signalled),
    scored AS (SELECT *, {score} AS raw_score, {flags} AS raw_flags FROM derived),
    judged AS (
      SELECT *, {sql.holds(ru.RISK.reset)} AND raw_score < {ru.RISK.reset_below} AS cleared FROM scored
    ),
    assessed AS (
      SELECT *, CASE WHEN cleared THEN 0 ELSE raw_score END AS risk_score,
             CASE WHEN cleared THEN [{flag(ru.RISK.reset_flags)}] ELSE {distinct} END AS risk_flags,
             CASE WHEN cleared THEN 'low' WHEN raw_score >= 4 THEN 'high' WHEN raw_score >= 2 THEN 'medium'
                  ELSE 'low' END AS risk_level
      FROM judged
    )"""


USER_SQL = "messages AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')"


def user_messages(t: Tables) -> DataFrame:
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.lower("text").alias("t"))


@query(
    f"""WITH {USER_SQL}, {assessed_sql('messages')}
    SELECT conv_id, turn, language, category, confidence, risk_level, risk_score,
           array_to_string(preprocessing_flags, ',') AS flags,
           array_to_string(matched_terms, ',') AS matched, array_to_string(risk_flags, ' | ') AS reasons
    FROM assessed"""
)
def risk_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Language, flags, category and risk of every user message."""
    return assessed(user_messages(Tables(spark, sf))).select(
        "conv_id",
        "turn",
        "language",
        "category",
        "confidence",
        "risk_level",
        "risk_score",
        F.array_join("preprocessing_flags", ",").alias("flags"),
        F.array_join("matched_terms", ",").alias("matched"),
        F.array_join("risk_flags", " | ").alias("reasons"),
    )


@query(
    f"""WITH {USER_SQL}, {assessed_sql('messages')}
    SELECT language, category, risk_level, count(*) AS messages, round(avg(confidence), 6) AS mean_confidence
    FROM assessed GROUP BY ALL"""
)
def triage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Messages by language, category and risk level."""
    return (
        assessed(user_messages(Tables(spark, sf)))
        .groupBy("language", "category", "risk_level")
        .agg(F.count("*").alias("messages"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    )


@query(
    f"""WITH {USER_SQL}, {assessed_sql('messages')}
    SELECT conv_id, turn, 'Semantic analysis found category signals: '
        || CASE WHEN len(matched_terms) > 0 THEN array_to_string(matched_terms, ', ') ELSE 'no strong category signals' END
        || '; preprocessing flags: '
        || CASE WHEN len(preprocessing_flags) > 0 THEN array_to_string(preprocessing_flags, ', ') ELSE 'no strong rule flags' END
        || '; final risk level is ' || risk_level || '.' AS analysis_reason
    FROM assessed"""
)
def analysis_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Explanation sentence of every user message."""
    reason = tr.analysis_reason(
        F.col("matched_terms"), F.col("preprocessing_flags"), F.col("risk_level"), F.col("language")
    )
    return assessed(user_messages(Tables(spark, sf))).select("conv_id", "turn", reason.alias("analysis_reason"))


def _gate_sql() -> str:
    found = [f"{sql.raw('t', terms)} AS {name}" for name, terms in ru.GATE.terms.items()]
    found += [f"{sql.raw('s', terms)} AS {name}" for name, terms in ru.GATE.sender_terms.items()]
    found += [f"({sql.raw('t', terms)} OR {sql.raw('s', terms)}) AS {name}" for name, terms in ru.GATE.either_terms.items()]
    steps = " ".join(f"WHEN {sql.holds(step.rule)} THEN {sql.text(step.reason)}" for step in ru.GATE.steps)
    return f"""
    gate_signals AS (SELECT *, {', '.join(found)} FROM mails),
    gated AS (SELECT *, CASE {steps} END AS rejected FROM gate_signals)"""


DOC_SQL = "mails AS (SELECT doc_id, lang, n_chars, lower(text) AS t, lower(source) AS s FROM documents)"


def mails(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", "lang", "n_chars", F.lower("text").alias("t"), F.lower("source").alias("s"))


@query(
    f"""WITH {DOC_SQL}, {_gate_sql()}, {assessed_sql('gated')}
    SELECT doc_id, rejected IS NULL AS is_support, coalesce(rejected, 'support intent') AS gate_reason,
           CASE WHEN rejected IS NULL THEN 'processed' ELSE 'irrelevant' END AS status,
           CASE WHEN rejected IS NULL THEN category ELSE 'other' END AS category,
           CASE WHEN rejected IS NULL THEN risk_level ELSE 'low' END AS risk_level,
           CASE WHEN rejected IS NULL THEN len(risk_flags) ELSE 0 END AS flag_count
    FROM assessed"""
)
def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gate every document as a message from its source; rejected ones lose their outcome."""
    gated = tr.relevance_gate(mails(Tables(spark, sf)), "t", "s", rules=ru.GATE)
    ready = assessed(gated).withColumn("status", F.lit("processed"))
    return tr.mark_irrelevant(ready, ~F.col("is_support")).select(
        "doc_id",
        "is_support",
        "gate_reason",
        "status",
        "category",
        "risk_level",
        F.size("risk_flags").cast("long").alias("flag_count"),
    )


_SECOND = {
    "non_support": ("license", "clown", "payment dispute"),
    "platform_sender": ("src3", "src12"),
    "direct_request": ("antion", "pour", "nicht"),
}


@query(
    f"""WITH {DOC_SQL}, {assessed_sql('mails')},
    texts AS (SELECT *, lower(array_to_string(risk_flags, ' ')) AS a FROM assessed)
    SELECT doc_id,
      CASE WHEN category = 'other' AND {sql.raw('a', _SECOND['non_support'])} THEN 'analysis'
           WHEN category = 'other' AND ({sql.raw('a', _SECOND['non_support'])} OR {sql.raw('t', _SECOND['non_support'])}
                OR {sql.raw('s', _SECOND['non_support'])} OR {sql.raw('s', _SECOND['platform_sender'])})
                AND NOT {sql.raw('t', _SECOND['direct_request'])} THEN 'signals'
           ELSE '' END AS filter_reason
    FROM texts"""
)
def second_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Second filter, once the category is known."""
    ready = assessed(mails(Tables(spark, sf))).withColumn("a", F.lower(F.array_join("risk_flags", " ")))
    filtered = tr.second_gate(
        ready,
        "t",
        "s",
        analysis="a",
        terms=_SECOND,
        reasons={"verdict": "verdict", "analysis": "analysis", "signals": "signals"},
    )
    return filtered.select("doc_id", "filter_reason")


@query(
    f"""SELECT doc_id, {sql.first_match("lower(source || chr(10) || text)", ru.FIRST_MATCH)} AS category FROM documents"""
)
def first_match_category(spark: SparkSession, sf: str) -> DataFrame:
    """Category by the first rule that matches source or text."""
    docs = Tables(spark, sf).documents.select("doc_id", F.lower(F.concat_ws("\n", "source", "text")).alias("t"))
    return docs.select("doc_id", mt.first_match("t", ru.FIRST_MATCH).alias("category"))


def _class(marks) -> str:
    return "[" + "".join(marks) + "]"


def _n(pattern: str, column: str = "t") -> str:
    return f"len(regexp_extract_all({column}, {sql.text(pattern)}))"


_MOJIBAKE_SQL = " + ".join(
    [_n(_class(MOJIBAKE_MARKERS))]
    + [f"{_n(p.replace('u0080', 'x{80}').replace('u00ff', 'x{ff}'))} * {w}" for p, w in MOJIBAKE_RUNS]
)


@query(
    f"""WITH texts AS (
      SELECT 'document' AS kind, doc_id AS id, trim(text, ' ' || chr(10)) AS t FROM documents
      UNION ALL SELECT 'page', page_id, trim(html, ' ' || chr(10)) FROM pages),
    scores AS (
      SELECT kind, id, t, ({_MOJIBAKE_SQL})::BIGINT AS mojibake, {_n(_class(CORRUPT_MARKERS))} AS marks,
             {_n('[一-鿿]')} AS hanzi, {_n(_class(COMMON_HANZI))} AS common, {_n('[?]')} AS questions,
             {_n('[' + chr(92) + 'x{80}-' + chr(92) + 'x{9f}]')} AS controls,
             {_n('[' + chr(92) + 'x{e000}-' + chr(92) + 'x{f8ff}]')} AS private_use,
             {_n('[' + chr(92) + 'x{ac00}-' + chr(92) + 'x{d7af}]')} AS hangul
      FROM texts)
    SELECT kind, id, mojibake, t <> '' AND (contains(t, chr(65533)) OR contains(t, '????') OR contains(t, '锟')
        OR contains(t, '瑞-偶') OR marks >= 3 OR mojibake >= 4
        OR (hanzi >= 30 AND common / greatest(hanzi, 1) < 0.08) OR controls >= 2 OR private_use >= 2 OR hangul >= 2
        OR questions / greatest(length(t), 1) > 0.25) AS is_corrupted
    FROM scores"""
)
def corrupt_text_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Damage verdict and mojibake score of every document and page."""
    t = Tables(spark, sf)
    texts = t.spread("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    )
    return texts.select(
        "kind", "id", ql.mojibake_score(F.col("text")).alias("mojibake"), ql.is_corrupted(F.col("text")).alias("is_corrupted")
    )


_SOURCES = tuple(f"src{i}" for i in range(18))


@query(
    f"""SELECT d.doc_id, array_to_string({sql.compact((
        "CASE WHEN NOT length(text) >= 200 THEN 'text' END",
        "CASE WHEN NOT lang IN ('en','de','fr') THEN 'lang' END",
        f"CASE WHEN NOT list_contains({sql.lister(_SOURCES)}, source) THEN 'source' END",
        "CASE WHEN NOT coalesce(quality IN (0, 1), false) THEN 'quality' END",
        "CASE WHEN NOT n_chars BETWEEN 1 AND 30000 THEN 'n_chars' END"))}, ',') AS broken,
      CASE WHEN broken = '' THEN 'indexed' ELSE 'failed' END AS status
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def expectations_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Row expectations; every document is kept with what it breaks and its index status."""
    t = Tables(spark, sf)
    joined = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    judged = ex.judge(
        joined,
        {
            "text": F.length("text") >= 200,
            "lang": F.col("lang").isin("en", "de", "fr"),
            "source": F.col("source").isin(*_SOURCES),
            "quality": F.col("quality").isin(0, 1),
            "n_chars": F.col("n_chars").between(1, 30000),
        },
    )
    from postroom.operators.lifecycle import document_status

    return judged.withColumn("broken", F.array_join("broken", ",")).select(
        "doc_id", "broken", document_status(F.col("is_valid"), F.col("broken"))["status"].alias("status")
    )


_LABELLED_SQL = """mails AS (
      SELECT d.doc_id, d.lang, d.n_chars, lower(d.text) AS t, lower(d.source) AS s, l.quality, l.toxic
      FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled(t: Tables) -> DataFrame:
    return mails(t).join(t.labels, "doc_id", "left")


@query(
    f"""WITH {_LABELLED_SQL}, {assessed_sql('mails')},
    raw AS (SELECT *, n_chars % 5 = 4 OR quality IS NULL AS no_answer, n_chars % 11 = 0 AS cut,
        CASE WHEN n_chars % 7 = 0 THEN 'unknown' WHEN quality = 1 THEN 'technical' ELSE 'billing' END AS v_category,
        ((n_chars % 120) / 100.0)::DOUBLE AS v_confidence,
        CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END AS v_level FROM assessed),
    valid AS (SELECT *, NOT no_answer AND NOT cut AND v_category <> 'unknown' AND v_confidence <= 1 AS ok FROM raw)
    SELECT doc_id, ok AS has_verdict, CASE WHEN ok THEN v_category ELSE category END AS category,
      round(CASE WHEN ok THEN round(v_confidence, 2) ELSE confidence END, 4) AS confidence,
      CASE WHEN NOT ok THEN risk_level WHEN risk_level = 'high' OR v_level = 'high' THEN 'high'
           WHEN risk_level = 'medium' OR v_level = 'medium' THEN 'medium' ELSE 'low' END AS risk_level,
      array_to_string(CASE WHEN ok THEN list_concat(['model: ' || v_level], risk_flags) ELSE risk_flags END, ' | ') AS reasons,
      ok AND (CASE risk_level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END
            > CASE v_level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS raised_by_rules
    FROM valid"""
)
def verdict_guardrail(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers as fenced JSON are parsed, validated and merged; rules only raise."""
    ruled = assessed(labelled(Tables(spark, sf)))
    level = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    answer = F.to_json(
        F.struct(
            F.when(F.col("n_chars") % 7 == 0, "unknown").when(F.col("quality") == 1, "technical").otherwise("billing").alias("category"),
            F.lit(True).alias("is_support_request"),
            ((F.col("n_chars") % 120) / 100.0).alias("confidence"),
            level.alias("risk_level"),
            F.array(F.concat(F.lit("model: "), level)).alias("risk_flags"),
            (F.col("toxic") == 1).alias("should_escalate"),
            F.lit("as labelled").alias("reason"),
        )
    )
    cut = F.when(F.col("n_chars") % 11 == 0, F.left(answer, F.length(answer) - 1)).otherwise(answer)
    answers = ruled.filter((F.col("n_chars") % 5 != 4) & F.col("quality").isNotNull()).select(
        "doc_id", F.concat(F.lit("```json\n"), cut, F.lit("\n```")).alias("answer")
    )
    verdicts = ex.parse_verdicts(answers, "answer").filter(F.col("verdict").isNotNull())
    return tr.apply_verdicts(ruled, verdicts, "doc_id").select(
        "doc_id",
        F.col("verdict").isNotNull().alias("has_verdict"),
        "category",
        F.round("confidence", 4).alias("confidence"),
        "risk_level",
        F.array_join("risk_flags", " | ").alias("reasons"),
        "raised_by_rules",
    )


@query(
    f"""WITH {_LABELLED_SQL}, {assessed_sql('mails')},
    hits AS (SELECT *, [((n_chars % 97) / 100.0)::DOUBLE, ((n_chars % 53) / 100.0)::DOUBLE, ((n_chars % 31) / 100.0)::DOUBLE] AS scores
             FROM assessed),
    banded AS (SELECT *, list_transform(scores, lambda x: CASE WHEN x >= 0.6 THEN 'strong' WHEN x >= 0.35 THEN 'medium' ELSE 'weak' END) AS bands
             FROM hits)
    SELECT doc_id, array_to_string(bands, ',') AS bands,
      len(list_filter(bands, lambda b: b IN ('strong', 'medium'))) AS grounded_hits,
      CASE WHEN risk_level = 'low' AND coalesce(toxic, 0) = 0 AND category <> 'other' AND confidence >= 0.7
                AND list_contains(bands, 'strong') THEN 'ready_to_send' ELSE 'human_review' END AS status
    FROM banded"""
)
def review_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Route each message by risk, certainty and the reliability of its evidence."""
    ready = assessed(labelled(Tables(spark, sf)))
    scores = F.array(*[(F.col("n_chars") % m) / 100.0 for m in (97, 53, 31)])
    hits = F.transform(scores, lambda s: F.struct(s.alias("score"), sc.reliability(s).alias("reliability")))
    ready = ready.withColumn("knowledge_hits", hits)
    status = tr.review_route(
        F.col("risk_level"), F.coalesce("toxic", F.lit(0)) == 1, F.col("category"), F.col("confidence"), F.col("knowledge_hits")
    )
    return ready.select(
        "doc_id",
        F.array_join(F.transform("knowledge_hits", lambda h: h["reliability"]), ",").alias("bands"),
        F.size(tr.reliable_hits(F.col("knowledge_hits"), "medium", 3)).cast("long").alias("grounded_hits"),
        status.alias("status"),
    )


@query()
def best_alternative(spark: SparkSession, sf: str) -> DataFrame:
    """Best decoded of two alternative bodies per document: as is, and read as Latin-1."""
    from postroom.operators.layout import pick_best

    docs = Tables(spark, sf).spread("documents", "doc_id", "text")
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    parts = docs.select(
        "doc_id",
        F.posexplode_outer(
            F.array(
                F.struct(wrong.alias("text"), F.lit("text/plain").alias("content_type"), F.lit("latin1").alias("name")),
                F.struct(F.col("text"), F.lit("text/html").alias("content_type"), F.lit("utf8").alias("name")),
            )
        ).alias("position", "part"),
    ).select("doc_id", "position", "part.*")
    score = ql.part_score(F.col("text"), F.col("content_type"))
    return pick_best(parts, ["doc_id"], score, "position", "name").withColumnRenamed("name", "best_part")
