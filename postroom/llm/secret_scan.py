"""Secret scans: three base patterns, and windows of high entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import arrow_map, enter, sliced, visible

# FIXED VALUES: the base patterns and the least lengths of what they match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_FIRST = re.compile(r"passw|secret|token|api", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "entropy")

# Candidate strings, and per character class the window and the least entropy in bits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES: tuple[tuple[str, re.Pattern, int, float], ...] = (
    ("hex", re.compile(r"[0-9a-fA-F]+\Z"), 20, 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]+\Z"), 20, 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 20, 3.9),
)

# Strings that are no secrets although they look like it: whole candidates that match are left out.
ALLOW: tuple[str, ...] = (
    r"[A-Za-z_=/+-]+",  # no digit: a word, a path, a rule
    r"[0-9_=/+-]+",  # digits only: a number, a date, a phone
    r"(?i:.*(example|placeholder|changeme|dummy|xxxx|your[_-]).*)",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"(?i:sha(1|256|512)[-=].*)",  # integrity digests
)

Span = tuple[int, int, int]


@lru_cache(maxsize=4096)
def plog(n: int) -> float:
    return n * math.log2(n) if n else 0.0


def entropy_spans(value: str, width: int, least: float) -> list[tuple[int, int]]:
    """Stretches of ``value`` covered by windows whose entropy is at least ``least`` bits.

    The sum of n*log2(n) is kept while the window moves: one character in, one out.
    """
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    full = math.log2(width)
    for i, char in enumerate(value):
        n = counts.get(char, 0)
        total += plog(n + 1) - plog(n)
        counts[char] = n + 1
        if i >= width:
            old = value[i - width]
            n = counts[old]
            total += plog(n - 1) - plog(n)
            counts[old] = n - 1
        if i + 1 >= width and full - total / width >= least - 1e-9:
            start = i + 1 - width
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[Span]:
    """Base matches as (start, end, kind index); leftmost and non-overlapping per kind."""
    found: list[Span] = []
    if ASSIGN_FIRST.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def method_spans(text: str, allow: re.Pattern) -> list[Span]:
    """Windows of high entropy inside candidates that the allow list does not name."""
    found = []
    for m in CANDIDATE.finditer(text):
        value = m.group()
        if allow.fullmatch(value):
            continue
        for _, pattern, width, least in CLASSES:
            if pattern.match(value):
                found += [(m.start() + a, m.start() + b, 3) for a, b in entropy_spans(value, width, least)]
                break
    return found


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: Sequence[Span], mark: str) -> str:
    """``text`` with each stretch of overlapping spans replaced once; the rest is untouched."""
    pieces, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            pieces += [text[at:start], mark]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def scan(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", allow: Sequence[str] = ALLOW, redact: str | None = None
) -> DataFrame:
    """Spans per row: ``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans`` and, with
    ``redact``, ``clean``: the text with secrets replaced by that mark.

    Positions are code points, ends exclusive. Null text counts as empty (``clean`` stays null). Rows
    repeat as they come; an empty table gives an empty result; other columns are not read. The allow
    list suppresses entropy windows only; base matches stay. Whole texts, one scan, no shuffle.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    allowed = re.compile("|".join(f"(?:{a})" for a in allow) or r"(?!)")

    def run(batch: dict[str, list]):
        for doc_id, value in zip(batch["doc_id"], batch["text"], strict=True):
            body = value or ""
            base = base_spans(body)
            more = method_spans(body, allowed)
            n = [sum(s[2] == k for s in base) for k in range(3)]
            every = sorted(base + more, key=lambda s: (s[0], s[2]))
            row = (doc_id, *n, len(more), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))
            if redact is not None:
                row += (None if value is None else redacted(body, every, redact) if every else value,)
            yield row

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return arrow_map(rows, run, schema + (", clean string" if redact is not None else ""))


def redact_documents(docs: DataFrame, *, text: str = "text", chars: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``mark`` and ``chars``, if there, counted anew.

    Every row and column stays, in one map over whole rows: no join, so null or repeated keys and
    columns of any name are no matter.
    """
    allowed = re.compile("|".join(f"(?:{a})" for a in ALLOW))

    def clean(batches):
        import pyarrow as pa

        enter(__name__)
        for batch in sliced(batches):
            at = batch.schema.get_field_index(text)
            values = []
            for value in batch.column(at).to_pylist():
                spans = base_spans(value) + method_spans(value, allowed) if value else []
                values.append(redacted(value, spans, mark) if spans else value)
            arrays = list(batch.columns)
            arrays[at] = pa.array(values, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    done = visible(docs).mapInArrow(clean, docs.schema)
    if chars in docs.columns and chars != text:
        counted = F.length(F.col(text)).cast(docs.schema[chars].dataType)
        done = done.withColumn(chars, F.when(F.col(text).isNull(), F.col(chars)).otherwise(counted))
    return done
