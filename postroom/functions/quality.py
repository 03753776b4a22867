"""Text damage detectors, decode-quality scores and edit guards."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions.text import strip


# FIXED VALUES: character ranges of damaged text.
C1_CONTROLS = r"[\u0080-\u009f]"
PRIVATE_USE = r"[\ue000-\uf8ff]"
ABOVE_LATIN = r"[\u2000-\uffff]"
HANGUL = r"[\uac00-\ud7af]"
ASCII_TEXT = string.ascii_letters + string.digits + " .,;:/-_@<>"
LATIN1_UPPER = r"[\u0080-\u00ff]"


def _total(columns) -> Column:
    return reduce(add, columns)


def count_marks(text: Column, marks: Sequence[str]) -> Column:
    """Occurrences of any of the marks.

    Marks are single characters, so one ``translate`` counts all of them.
    """
    return F.length(text) - F.length(F.translate(text, "".join(marks), ""))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_wide(text: Column, pattern: str) -> Column:
    """Matches of a pattern that only holds characters above Latin scripts; most texts have none."""
    return F.when(text.rlike(ABOVE_LATIN), count_of(text, pattern)).otherwise(0)


def mojibake_score(text: Column) -> Column:
    runs = [
        (count_wide(text, pattern) if "浣" in pattern else count_of(text, pattern)) * weight
        for pattern, weight in lx.MOJIBAKE_RUNS
    ]
    return (count_marks(text, lx.MOJIBAKE_MARKERS) + _total(runs)).cast("long")


def is_corrupted(value: Column, common: str = lx.COMMON_HANZI) -> Column:
    """Does the text look like the product of a wrong decode?"""
    text = strip(F.coalesce(value, F.lit("")))
    hanzi = count_of(text, "[一-鿿]")
    rare_hanzi = (hanzi >= 30) & (count_marks(text, list(common)) / F.greatest(hanzi, F.lit(1)) < 0.08)
    questions = count_marks(text, ["?"]) / F.greatest(F.length(text), F.lit(1))
    return (text != "") & (
        text.contains("�")
        | text.contains("????")
        | text.contains("锟")
        | text.contains("瑞-偶")
        | (count_marks(text, lx.CORRUPT_MARKERS) >= 3)
        | (mojibake_score(text) >= 4)
        | rare_hanzi
        | (count_of(text, C1_CONTROLS) >= 2)
        | (count_of(text, PRIVATE_USE) >= 2)
        | (count_of(text, HANGUL) >= 2)
        | (questions > 0.25)
    )


def decode_score(text: Column, common: str = lx.COMMON_HANZI, english=lx.COMMON_ENGLISH) -> Column:
    """Higher is better decoded text. ``common`` lists frequent Chinese characters.

    Single characters outside ordinary ASCII are counted in what is left of the text without ordinary ASCII, a few
    hundredths of most texts. No count stands in a branch of its own, so that Spark evaluates those used twice once.
    """
    odd = F.regexp_replace(text, r"[\t\n\r\x20-\x7e]+", "")
    hanzi = count_of(odd, "[一-鿿]")
    common_count = count_marks(odd if _outside_ascii(common) else text, list(common))
    latin1 = count_of(odd, LATIN1_UPPER)
    pairs = count_wide(odd, f"[{_ascii_pair_class()}]")
    printable = F.length(text) - count_of(odd, r"[\p{C}\p{Z}&&[^ \r\n\t]]")
    addresses = F.when(
        text.contains("@") | text.contains("://"), count_of(text, r"(?U)https?://|[\w.+-]+@[\w.-]+")
    ).otherwise(0)
    bonus = (
        printable
        + common_count * 4
        + count_marks(text, ASCII_TEXT) * 2
        + _count_words(F.lower(text), english) * 6
        + addresses * 12
    )
    penalty = (
        count_marks(odd, ["�"]) * 20
        + count_of(odd, "\\x00") * 10
        + F.when(text.contains("????"), count_of(text, r"\?\?\?\?")).otherwise(0) * 10
        + pairs * 80
        + _mojibake_of(text, odd) * 35
        + F.when(odd.rlike("[ÃÂÄÅäåæçèé]"), count_of(text, lx.LATIN1_PAIR_RUN)).otherwise(0) * 45
        + F.when((hanzi >= 20) & (common_count / F.greatest(hanzi, F.lit(1)) < 0.08), hanzi * 4).otherwise(0)
        + F.when(latin1 >= 4, latin1 * 12).otherwise(0)
        + count_of(odd, HANGUL) * 12
        + count_of(odd, PRIVATE_USE) * 20
    )
    score = bonus - penalty - F.when(F.length(text) == 0, 100).otherwise(0)  # an empty text has nothing to count
    return F.coalesce(score, F.lit(-100)).cast("long")


def _outside_ascii(marks: Sequence[str]) -> bool:
    return all(ord(c) > 0x7F for mark in marks for c in mark)


def _count_words(lowered: Column, words: Sequence[str]) -> Column:
    """Runs of the letters a to z that are one of ``words``; these have two letters at least, other words are never found."""
    known = "|".join(sorted(w for w in set(words) if re.fullmatch("[a-z]{2,}", w)))
    return count_of(lowered, f"(?<![a-z])(?:{known})(?![a-z])") if known else lowered.isNull().cast("int") * 0


def _mojibake_of(text: Column, odd: Column) -> Column:
    """:func:`mojibake_score`, by what the text has outside ordinary ASCII; its markers all lie there."""
    runs = [
        F.when(odd.rlike(re.match(r"\[[^]]+\]", pattern)[0]), count_of(text, pattern)).otherwise(0) * weight
        for pattern, weight in lx.MOJIBAKE_RUNS
    ]
    return count_marks(odd if _outside_ascii(lx.MOJIBAKE_MARKERS) else text, lx.MOJIBAKE_MARKERS) + _total(runs)


def _ascii_pair_class() -> str:
    """Characters whose two UTF-16 bytes are both printable ASCII, outside CJK."""
    rows = [high for high in range(0x20, 0x7F) if not 0x4E <= high <= 0x9F]
    return "".join(f"\\u{high:02x}20-\\u{high:02x}7e" for high in rows)


def part_score(text: Column, content_type: Column) -> Column:
    """Rank of one alternative body: decode quality, plain text first, longer first."""
    plain = F.when(content_type == "text/plain", 50).otherwise(0)
    return decode_score(text) + plain + F.floor(F.least(F.length(text), F.lit(1000)) / 10)


def protected_tokens(text: Column) -> Column:
    """URLs, addresses, amounts, dates, ids and numbers, in order of appearance."""
    return F.regexp_extract_all(text, F.lit("(?iU)" + lx.PROTECTED_TOKEN), F.lit(0))


def edit_is_safe(
    original: Column, edited: Column, limit: float = lx.EDIT_LENGTH_LIMIT, tokens: tuple[Column, Column] | None = None
) -> Column:
    """An edit may not touch protected tokens nor change the length by more than ``limit``.

    ``tokens`` are the protected tokens of both texts, where they are at hand.
    """
    before, after = tokens or (protected_tokens(original), protected_tokens(edited))
    change = F.abs(F.length(edited) - F.length(original)) / F.greatest(F.length(original), F.lit(1))
    return (edited != "") & (before == after) & (change <= limit)
