"""Text cleaning, splitting and display as column expressions.

``(?U)`` makes the Java classes follow Unicode. Nothing here shuffles: every
function reads one row's text and stays inside the scan's stage.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx

# FIXED VALUES: patterns that decide what counts as noise, a heading or a sentence.
CONTROL_RUN = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]+"
SPACE_RUN = r"(?U)\s+"
RULE_LINE = "^[-_—=]{3,}$"
PAGE_NUMBER_LINE = r"(?iU)^(page\s*)?\d+(/\d+)?$"
CJK_PAGE_LINE = r"(?U)^第\s*\d+\s*页\s*(共\s*\d+\s*页)?$"
WRAPPED_LINE = r"(?<![。！？.!?:：；;])\n(?!\n|[#\-*0-9])"
WRAPPED_LINE_IN_PARAGRAPH = r"(?<![。！？.!?:：；;\n])\n(?!\n|[#\-*0-9])"
MARKDOWN_HEADING = r"(?U)^#{1,4}\s+(.+)$"
NUMBERED_HEADING = r"(?U)^\d+(\.\d+)*[.、 ]+[一-鿿A-Za-z].+"
LEAD_HEADING = r"(?U)^(\d+(\.\d+)*[、. ]*)?[一-鿿A-Za-z].*"
SENTENCE = r"[^。！？!?；;.\n]+[。！？!?；;.]?"
BLANK_LINES = r"(?U)\n\s*\n"
HIDDEN_TAGS = ("head", "style", "script", "noscript", "template")
BREAK_BEFORE_TAGS = "br|p|div|tr|li|table|section|article|h1|h2|h3"
BREAK_AFTER_TAGS = "p|div|tr|li|table|section|article|h1|h2|h3"
HTML_HINT = r"(?is)</?(html|body|div|table|style|p|br|span|a|meta|head)\b"


# FIXED VALUES: the white space that Unicode knows.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim all Unicode white space; only the ends of the text are looked at."""
    return F.btrim(text, F.lit(WHITE))


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE_RUN, " "))


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def clean_line(line: Column) -> Column:
    return collapse_space(F.regexp_replace(line, CONTROL_RUN, " "))


def is_noise_line(line: Column) -> Column:
    return line.rlike(RULE_LINE) | line.rlike(PAGE_NUMBER_LINE) | line.rlike(CJK_PAGE_LINE)


def clean_lines(text: Column) -> Column:
    return F.transform(F.split(unify_newlines(text), "\n"), clean_line)


def without_noise(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~is_noise_line(line))


def join_lines(kept: Column, keep_paragraphs: bool = True) -> Column:
    """Join wrapped lines and squeeze blanks.

    With ``keep_paragraphs`` a blank line always separates paragraphs; without it, a
    blank line before an ordinary word turns into a newline and a space.
    """
    wrapped = WRAPPED_LINE_IN_PARAGRAPH if keep_paragraphs else WRAPPED_LINE
    joined = F.regexp_replace(F.array_join(kept, "\n"), wrapped, " ")
    squeezed = F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(squeezed)


def clean_text(text: Column, keep_paragraphs: bool = True) -> Column:
    return join_lines(without_noise(clean_lines(text)), keep_paragraphs)


def squeeze_text(text: Column) -> Column:
    """The light cleaner: newlines, runs of blanks, runs of empty lines."""
    return strip(F.regexp_replace(F.regexp_replace(unify_newlines(text), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def readable_ratio(text: Column) -> Column:
    readable = F.length(F.regexp_replace(text, f"(?U)[^{lx.READABLE_CLASS}]", ""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(readable / F.length(text))


def readable_runs(text: Column, minimum_ratio: float = 0.55, minimum_chars: int = 4) -> Column:
    """Distinct readable stretches of a damaged text, in order."""
    marked = F.regexp_replace(text, CONTROL_RUN, "\n")
    runs = F.transform(F.regexp_extract_all(marked, F.lit(f"(?U)[{lx.READABLE_CLASS}]{{4,}}"), F.lit(0)), clean_line)
    return F.array_distinct(
        F.filter(runs, lambda run: (F.length(run) >= minimum_chars) & (readable_ratio(run) >= minimum_ratio))
    )


def blocks(text: Column, separator: str = BLANK_LINES) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda block: block != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def sentences(text: Column) -> Column:
    """Sentences with their stop; empty for a text of stops only."""
    found = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda piece: piece != ""
    )
    return found


def fixed_width(text: Column, width: int) -> Column:
    """Pieces of ``width`` characters. One regex pass; ``substr`` would rescan the text per piece."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), strip)
    return F.filter(pieces, lambda piece: piece != "")


def tail_overlap(text: Column, chars: int) -> Column:
    """Last ``chars`` characters, from the sentence start if one lies inside."""
    if chars <= 0:
        return F.lit("")
    tail = strip(F.right(text, F.lit(chars)))
    after_stop = strip(F.regexp_extract(tail, r"(?s)^(?:.*[。.\n])?(.*)$", 1))
    return F.when(F.length(text) <= chars, F.lit("")).otherwise(after_stop)


def snippet(text: Column, limit: int = 260) -> Column:
    flat = collapse_space(text)
    cut = F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def preview(text: Column, limit: int = 3000) -> Column:
    return strip(F.left(text, F.lit(limit)))


def _prettified(name: Column) -> Column:
    return F.initcap(F.translate(name, "_-", "  "))


def title(text: Column, fallback: Column, *, strict: bool = True) -> Column:
    """First usable line without heading marks, else the prettified fallback.

    ``strict`` skips noise lines and gives up on a first line above 80 characters.
    """
    candidates = F.transform(lines(text), lambda line: strip(strip_chars(line, "# ")))
    usable = F.filter(
        candidates, (lambda line: (line != "") & ~is_noise_line(line)) if strict else (lambda line: line != "")
    )
    first = F.get(usable, 0)
    good = first.isNotNull() & (F.length(first) <= 80) if strict else first.isNotNull()
    return F.when(good, F.left(first, F.lit(120))).otherwise(_prettified(fallback))


def _first_line(block: Column) -> Column:
    return strip(F.substring_index(block, "\n", 1))


def _is_single_line(block: Column) -> Column:
    return ~block.contains("\n")


def section_heading(block: Column) -> Column:
    """Heading that opens a section: markdown, or a numbered / colon line on its own."""
    first = _first_line(block)
    markdown = F.regexp_extract(first, MARKDOWN_HEADING, 1)
    alone = _is_single_line(block) & (F.length(first) <= 80)
    marked = first.rlike(NUMBERED_HEADING) | first.rlike("[:：]$")
    return F.coalesce(
        F.left(strip(F.nullif(markdown, F.lit(""))), F.lit(120)),
        F.when(alone & marked, F.left(strip_chars(first, ":："), F.lit(120))),
        F.lit(""),
    )


def loose_heading(block: Column) -> Column:
    """Heading for display: also accepts a short lone line without marks."""
    first = _first_line(block)
    markdown = F.regexp_extract(first, MARKDOWN_HEADING, 1)
    short = (F.length(first) <= 60) & first.rlike(LEAD_HEADING)
    alone = _is_single_line(block) | first.rlike("[:：]$")
    return F.coalesce(
        F.left(strip(F.nullif(markdown, F.lit(""))), F.lit(120)),
        F.when(short & alone, F.left(strip_chars(first, ":："), F.lit(120))),
        F.lit(""),
    )


def is_standalone_heading(block: Column) -> Column:
    return _is_single_line(block) & _first_line(block).rlike(MARKDOWN_HEADING)


def title_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^0-9a-z一-鿿]+", "")


def content_key(value: Column) -> Column:
    """Body without blanks and punctuation: letters, digits, underscore of any script."""
    return F.regexp_replace(F.lower(value), r"(?U)[^\w一-鿿]+", "")


def word_count_tokens(text: Column) -> Column:
    """Token estimate of the corpus: CJK characters plus latin words."""
    return F.regexp_count(text, F.lit("[一-鿿]")) + F.regexp_count(text, F.lit("[a-zA-Z0-9_]+"))


def byte_class_tokens(text: Column) -> Column:
    """Token estimate of messages: ASCII characters by 4, others by 1.6."""
    other = F.length(F.regexp_replace(text, "[\\x00-\\x7f]", ""))
    ascii_chars = F.length(text) - other
    estimate = F.bround(ascii_chars / F.lit(4.0) + other / F.lit(1.6), 0).cast("long")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), estimate)
    )


def document_source(source: Column) -> Column:
    return F.replace(F.substring_index(source, "#chunk-", 1), F.lit("\\"), F.lit("/"))


def source_stem(source: Column) -> Column:
    """Lower-case file name without directory and last suffix."""
    return F.lower(F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"(?<=.)\.[^.]*$", ""))


def safe_source_name(value: Column, suffixes=lx.CORPUS_SUFFIXES) -> Column:
    kept = strip_chars(F.regexp_replace(strip(value), r"[^a-zA-Z0-9_\-.一-鿿]+", "_"), "._")
    named = F.when(kept == "", F.lit("knowledge_document")).otherwise(kept)
    known = F.lower(named).rlike("(" + "|".join(rf"\Q{s}\E" for s in suffixes) + ")$")
    return F.left(F.when(known, named).otherwise(F.concat(named, F.lit(".md"))), F.lit(120))


def safe_asset_name(value: Column) -> Column:
    kept = F.left(strip_chars(F.regexp_replace(value, "[^0-9A-Za-z一-鿿._-]+", "-"), "-._"), F.lit(80))
    return F.when(kept == "", F.lit("pdf")).otherwise(kept)


def image_extension(value: Column) -> Column:
    kept = F.regexp_replace(F.lower(value), "[^0-9a-z]+", "")
    return F.when(kept == "", F.lit("png")).when(kept == "jpeg", F.lit("jpg")).otherwise(F.left(kept, F.lit(8)))


def document_suffix(filename: Column, content_type: Column, mapping=lx.SUFFIX_BY_CONTENT_TYPE) -> Column:
    own = F.lower(F.regexp_extract(filename, r"[^/.](\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return F.when(own != "", own).otherwise(F.coalesce(F.try_element_at(table, content_type), F.lit("")))


def join_words(words: Column) -> Column:
    """Join words; a blank only where ASCII letters or digits would meet."""
    glued = F.array_join(F.filter(words, lambda word: word != ""), "\u0001")
    spaced = F.regexp_replace(glued, "(?<=[A-Za-z0-9])\u0001(?=[A-Za-z0-9])", " ")
    return strip(F.replace(spaced, F.lit("\u0001"), F.lit("")))


def unescape_html(text: Column) -> Column:
    """Decode character references once: named (the standard table), decimal and hexadecimal.

    ``&amp;`` goes last so nothing is decoded twice; code points that are none stay as they are.
    """
    amp = ("amp", "AMP")
    # One-letter tables grow the plan, so the names travel as one map literal.
    known = {name.rstrip(";"): value for name, value in html5.items() if name.endswith(";")}
    named = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    others = F.array_except(names, F.array(*[F.lit(a) for a in amp]))

    def put_named(acc, name):
        reference = F.concat(F.lit("&"), name, F.lit(";"))
        return F.replace(acc, reference, F.coalesce(F.try_element_at(named, name), reference))

    def character(code):
        point = F.lpad(F.hex(code.cast("long")), 8, "0")
        valid = code.cast("long").between(1, 0x10FFFF) & ~code.cast("long").between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(point), "UTF-32"))

    def put(prefix, base):
        def step(acc, digits):
            reference = F.concat(F.lit("&#"), F.lit(prefix), digits, F.lit(";"))
            code = F.conv(digits, base, 10)
            return F.replace(acc, reference, F.coalesce(character(code), reference))

        return step

    decimals = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,7});"), F.lit(1)))
    step = F.aggregate(others, text, put_named)
    step = F.aggregate(F.filter(decimals, lambda d: d.cast("long") != 38), step, put("", 10))
    for prefix in ("x", "X"):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"&#{prefix}([0-9A-Fa-f]{{1,6}});"), F.lit(1)))
        step = F.aggregate(F.filter(found, lambda d: F.conv(d, 16, 10) != "38"), step, put(prefix, 16))
    step = F.regexp_replace(step, "&(?:#0*38|#[xX]0*26|amp|AMP);", "&")
    return F.when(text.contains("&"), step).otherwise(text)


def _visible(html: Column) -> Column:
    out = html
    for tag in HIDDEN_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?=[\s>/])[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, "<![^>]*>", "")
    out = F.regexp_replace(out, r"(?U)>\s+<", "><")
    out = F.regexp_replace(out, r"(?i)<li(?=[\s>/])[^>]*>", "\n- ")
    out = F.regexp_replace(out, rf"(?i)<(?:{BREAK_BEFORE_TAGS})(?=[\s>/])[^>]*>", "\n")
    out = F.regexp_replace(out, rf"(?i)</(?:{BREAK_AFTER_TAGS})\s*>", "\n")
    return F.regexp_replace(out, "</?[A-Za-z][^>]*>", "")


def with_visible_text(df: DataFrame, html: str, name: str) -> DataFrame:
    """Add the readable text of a message body or page: markup, hidden parts and CSS preambles removed.

    The steps are columns of their own, so that none is computed twice.
    """
    shown = F.when(F.col("_raw").rlike(HTML_HINT), strip(_visible(F.col("_raw")))).otherwise(F.lit(""))
    plain = unify_newlines(F.coalesce(F.nullif(F.col("_shown"), F.lit("")), F.col("_raw")))
    plain = F.regexp_replace(plain, r"(?i)<br\s*/?>|</p\s*>", "\n")
    plain = F.regexp_replace(plain, r"(?i)<li\s*>", "\n- ")
    plain = F.regexp_replace(plain, "<[^>]+>", "")
    readable = strip_css_preamble(F.col("_plain"))
    readable = F.regexp_replace(F.regexp_replace(readable, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return (
        df.withColumn("_raw", unescape_html(F.col(html)))
        .withColumn("_shown", shown)
        .withColumn("_plain", strip(plain))
        .withColumn(name, strip(readable))
        .drop("_raw", "_shown", "_plain")
    )


def _offset(text: Column, pattern: str) -> Column:
    """Characters before the first match, null without one."""
    before = F.regexp_extract(text, rf"(?isU)^(.*?)(?:{pattern})", 1)
    return F.when(text.rlike(f"(?iU){pattern}"), F.length(before))


def strip_css_preamble(text: Column) -> Column:
    """Cut leaked CSS up to the first greeting, if the head looks like a style sheet."""
    trimmed = strip(text)
    signals = F.regexp_count(F.left(trimmed, F.lit(lx.CSS_HEAD_CHARS)), F.lit(lx.CSS_SIGNAL))
    start = None
    for group in lx.GREETING_ANCHORS:
        found = F.array_min(
            F.filter(F.array(*[_offset(trimmed, p) for p in group]), lambda at: at > lx.CSS_ANCHOR_AFTER)
        )
        start = found if start is None else F.coalesce(start, found)
    cut = F.substr(trimmed, start + 1)
    return F.when((signals >= lx.CSS_SIGNAL_MINIMUM) & start.isNotNull(), strip(cut)).otherwise(trimmed)


def sanitize_reply(text: Column, prefixes=lx.INTERNAL_LINE_PREFIXES) -> Column:
    """Drop internal reference lines and markdown emphasis from a reply."""
    internal = "^(" + "|".join(rf"\Q{p}\E" for p in prefixes) + ")"
    kept = F.filter(lines(unify_newlines(text)), lambda line: ~strip(line).rlike(internal))
    out = strip(F.array_join(kept, "\n"))
    for pattern in (r"\*\*(.*?)\*\*", "__(.*?)__", r"(?U)(?<!\*)\*(?!\s)(.*?)(?<!\s)\*(?!\*)", "`([^`]+)`"):
        out = F.regexp_replace(out, pattern, "$1")
    return strip(out)


def _fixed(value: Column, pattern: str) -> Column:
    """Decimal text, rounded on the exact binary value."""
    return F.call_function("format_number", value, F.lit(pattern))


def display_bytes(value: Column) -> Column:
    return (
        F.when(F.coalesce(value, F.lit(0)) == 0, F.lit("0 B"))
        .when(value < 1024, F.format_string("%d B", value.cast("long")))
        .when(value < 1024 * 1024, F.concat(_fixed(value / 1024.0, "0.0"), F.lit(" KB")))
        .otherwise(F.concat(_fixed(value / 1024.0 / 1024.0, "0.0"), F.lit(" MB")))
    )


def display_latency(milliseconds: Column) -> Column:
    return (
        F.when(F.coalesce(milliseconds, F.lit(0)) == 0, F.lit("0 ms"))
        .when(milliseconds >= 10000, F.concat(_fixed(milliseconds / 1000.0, "0.0"), F.lit(" s")))
        .when(milliseconds >= 1000, F.concat(_fixed(milliseconds / 1000.0, "0.00"), F.lit(" s")))
        .otherwise(F.format_string("%d ms", milliseconds.cast("long")))
    )


def display_cost(cost: Column) -> Column:
    return (
        F.when(F.coalesce(cost, F.lit(0.0)) == 0, F.lit("¥0"))
        .when(cost < 0.000001, F.lit("<¥0.000001"))
        .when(cost < 0.01, F.concat(F.lit("¥"), _fixed(cost, "0.000000")))
        .otherwise(F.concat(F.lit("¥"), _fixed(cost, "0.0000")))
    )
