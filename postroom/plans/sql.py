"""SQL text for the twins: term tests and rule conditions in the dialect of the checker.

Its regex engine has no lookaround, so a bounded term is written with the
neighbouring characters, which is the same for a yes/no test.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from postroom.functions.lexicon import Rule


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def raw(column: str, terms: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(term)})" for term in terms) + ")"


def bounded(column: str, terms: Sequence[str]) -> str:
    words = [re.escape(term) for term in terms if re.search("[a-z0-9]", term)]
    others = [term for term in terms if not re.search("[a-z0-9]", term)]
    parts = []
    if words:
        parts.append(f"regexp_matches({column}, {text('(^|[^a-z0-9])(?:' + '|'.join(words) + ')([^a-z0-9]|$)')})")
    if others:
        parts.append(raw(column, others))
    return "(" + " OR ".join(parts) + ")"


def holds(rule: Rule) -> str:
    """Condition over columns named like the signals; ':' becomes '_'."""

    def name(signal: str) -> str:
        return signal.replace(":", "_")

    any_of = " OR ".join("(" + " AND ".join(name(s) for s in group) + ")" for group in rule.any_of)
    return f"(({any_of})" + "".join(f" AND NOT {name(s)}" for s in rule.unless) + ")"


def first_match(column: str, rules, default: str = "other") -> str:
    branches = " ".join(f"WHEN {raw(column, terms)} THEN {text(label)}" for label, terms in rules)
    return f"CASE {branches} ELSE {text(default)} END"


def language(column: str, scripts, default: str) -> str:
    branches = " ".join(f"WHEN regexp_matches({column}, {text(p)}) THEN {text(tag)}" for p, tag in scripts)
    return f"CASE {branches} ELSE {text(default)} END"


def compact(items: Iterable[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def labels(column: str, labelled) -> str:
    return compact(f"CASE WHEN {bounded(column, terms)} THEN {text(label)} END" for label, terms in labelled)


def lister(values: Iterable[str]) -> str:
    return "[" + ", ".join(text(value) for value in values) + "]"
