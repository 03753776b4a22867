"""Term matching over text columns. Text is expected in lower case.

Rule sets hold hundreds of terms. Conditions are therefore written as SQL text and
parsed once per rule, instead of being put together column by column. ``text``
arguments name a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.lexicon import DEFAULT_LANGUAGE, LANGUAGE_SCRIPTS, Rule

_WORDLIKE = re.compile("[a-z0-9]")


def literal(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _alternatives(terms: Iterable[str]) -> str:
    return "|".join(rf"\Q{term}\E" for term in terms)


def bounded_pattern(terms: Sequence[str]) -> str:
    """One alternation for all terms.

    A term holding an ASCII letter or digit may not touch another one; terms of
    other scripts match anywhere.
    """
    lowered = [term.lower() for term in terms]
    words = [term for term in lowered if _WORDLIKE.search(term)]
    others = [term for term in lowered if not _WORDLIKE.search(term)]
    parts = []
    if words:
        parts.append(f"(?<![a-z0-9])(?:{_alternatives(words)})(?![a-z0-9])")
    if others:
        parts.append(_alternatives(others))
    return "|".join(parts)


def raw_sql(text: str, terms: Sequence[str]) -> str:
    """Substring match. ``contains`` scans bytes, so an OR of it beats a regex."""
    return "(" + " OR ".join(f"contains({text}, {literal(term)})" for term in terms) + ")"


def bounded_sql(text: str, terms: Sequence[str]) -> str:
    """Bounded match. Most texts hold none of the terms at all, and the substring
    test finds that out much faster than the regex, which then is not run."""
    return f"({raw_sql(text, [t.lower() for t in terms])} AND {text} RLIKE {literal(bounded_pattern(terms))})"


def _compact_sql(branches: Iterable[str]) -> str:
    return f"array_compact(array({', '.join(branches)}))"


def matched_sql(text: str, terms: Sequence[str]) -> str:
    """Sorted array of the terms found in the text."""
    return _compact_sql(f"CASE WHEN contains({text}, {literal(t)}) THEN {literal(t)} END" for t in sorted(terms))


def has_raw(text: str, terms: Sequence[str]) -> Column:
    return F.expr(raw_sql(text, terms))


def has_bounded(text: str, terms: Sequence[str]) -> Column:
    return F.expr(bounded_sql(text, terms))


def matched_labels(text: str, labelled: Iterable[tuple[str, Sequence[str]]]) -> Column:
    """Labels, in order, whose bounded terms occur."""
    return F.expr(
        _compact_sql(f"CASE WHEN {bounded_sql(text, terms)} THEN {literal(label)} END" for label, terms in labelled)
    )


def rule_sql(rule: Rule, signals: Mapping[str, str]) -> str:
    """Condition text of a rule over the texts of its signals."""
    groups = " OR ".join("(" + " AND ".join(signals[name] for name in group) + ")" for group in rule.any_of)
    return "(" + " AND ".join([f"({groups})", *(f"NOT {signals[name]}" for name in rule.unless)]) + ")"


def case_sql(branches: Iterable[tuple[str, str]], default: str) -> str:
    """First branch whose condition holds."""
    whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {whens} ELSE {default} END"


def language_tag(text: str, scripts=LANGUAGE_SCRIPTS, default: str = DEFAULT_LANGUAGE) -> Column:
    """Tag of the first script whose pattern occurs in the text."""
    return F.expr(case_sql(((f"{text} RLIKE {literal(p)}", literal(tag)) for p, tag in scripts), literal(default)))


def first_match(text: str, rules: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """Label of the first rule with a term in the text."""
    return F.expr(case_sql(((raw_sql(text, terms), literal(label)) for label, terms in rules), literal(default)))


def best_ballot(text: str, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Struct (votes, priority, category, matched): most matched terms win, earlier rule on ties."""
    ballots = ", ".join(
        f"named_struct('votes', size({matched_sql(text, terms)}), 'priority', {-order}, "
        f"'category', {literal(name)}, 'matched', {matched_sql(text, terms)})"
        for order, (name, terms) in enumerate(rules)
    )
    return F.expr(f"array_max(array({ballots}))")


def relabel(text: Column, labels: Sequence[tuple[str, str]], separator: str = "，") -> Column:
    """Distinct labels whose keyword occurs in ``text``, or the text itself."""
    lowered = F.lower(text)
    found = F.array_distinct(
        F.array_compact(F.array(*[F.when(lowered.contains(k), F.lit(label)) for k, label in labels]))
    )
    return F.when(F.size(found) > 0, F.array_join(found, separator)).otherwise(text)
