"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses.

DataFrame and SQL functions only. A value keeps its length, its separators and what makes it valid (check
digits, calendar, ranges of octets); the same value under the same key always becomes the same pseudonym,
in whichever document it stands, and two values never become one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What may be a value, most specific first; digits and letters next to it would make it something else.
FORMATS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![0-9./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"),
    ("day", r"(?<![0-9./-])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z])"),
)
QUICK = r"[0-9][ ./()-]{0,2}[0-9]|@"

# Dates are permuted among 270 * 270 days from here on.
FIRST_DAY, SIDE = "1900-01-01", 270


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digest(key: str, *parts: str) -> str:
    return f"sha2(concat_ws('|', {key}, {', '.join(parts)}), 256)"


def shift(char: str, by: str) -> str:
    """A digit to a digit, a letter to a letter of its case; anything else stays."""
    return (
        f"CASE WHEN {char} BETWEEN '0' AND '9' THEN chr(48 + (ascii({char}) - 48 + {by}) % 10) "
        f"WHEN {char} BETWEEN 'a' AND 'z' THEN chr(97 + (ascii({char}) - 97 + {by}) % 26) "
        f"WHEN {char} BETWEEN 'A' AND 'Z' THEN chr(65 + (ascii({char}) - 65 + {by}) % 26) ELSE {char} END"
    )


def feistel(text: str, key: str, tweak: str) -> str:
    """Permutation of strings of one shape: each round shifts one half by a digest of the other."""

    def half(mine: str, other: str) -> str:
        by = "CAST(conv(substr(hx, 1 + (4 * (ci - 1)) % 60, 4), 16, 10) AS INT)"
        body = f"array_join(transform(sequence(1, length({mine})), ci -> {shift(f'substr({mine}, ci, 1)', by)}), '')"
        hashed = digest(key, f"'{tweak}'", "CAST(rd AS STRING)", f"CAST(length({mine}) AS STRING)", other)
        return f"IF(length({mine}) = 0, '', {let('hx', hashed, body)})"

    start = f"named_struct('a', left({text}, length({text}) DIV 2), 'b', substr({text}, length({text}) DIV 2 + 1))"
    step = f"IF(rd % 2 = 1, named_struct('a', {half('fs.a', 'fs.b')}, 'b', fs.b), named_struct('a', fs.a, 'b', {half('fs.b', 'fs.a')}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (fs, rd) -> {step}, fs -> concat(fs.a, fs.b))"


def feistel_number(number: str, side: int, key: str, tweak: str) -> str:
    """Permutation of 0 .. side * side - 1."""

    def moved(mine: str, other: str) -> str:
        hashed = digest(key, f"'{tweak}'", "CAST(rn AS STRING)", f"CAST({other} AS STRING)")
        return f"pmod({mine} + CAST(conv(substr({hashed}, 1, 12), 16, 10) AS BIGINT), {side}L)"

    start = f"named_struct('a', CAST({number} AS BIGINT) DIV {side}, 'b', pmod(CAST({number} AS BIGINT), {side}L))"
    step = f"IF(rn % 2 = 1, named_struct('a', {moved('ns.a', 'ns.b')}, 'b', ns.b), named_struct('a', ns.a, 'b', {moved('ns.b', 'ns.a')}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (ns, rn) -> {step}, ns -> ns.a * {side} + ns.b)"


def refill(shape: str, chars: str, which: str) -> str:
    """``shape`` with those of its characters that match the class ``which`` replaced by ``chars`` in turn."""
    step = (
        f"IF(rc RLIKE '^{which}$', named_struct('o', concat(rs.o, substr({chars}, rs.j, 1)), 'j', rs.j + 1), "
        f"named_struct('o', concat(rs.o, rc), 'j', rs.j))"
    )
    return f"aggregate(split({shape}, ''), named_struct('o', '', 'j', 1), (rs, rc) -> {step}, rs -> rs.o)"


def luhn(digits: str) -> str:
    """Luhn sum of digits that a check digit follows."""
    x = f"CAST(substr({digits}, li, 1) AS INT)"
    return (
        f"aggregate(sequence(1, length({digits})), 0, (ls, li) -> ls + "
        f"IF((length({digits}) - li) % 2 = 0, 2 * {x} - IF({x} > 4, 9, 0), {x}))"
    )


def mod97(text: str) -> str:
    """Remainder by 97 of letters and digits read as a number, A being 10."""
    return (
        f"aggregate(split({text}, ''), 0, (ms, mc) -> IF(mc = '', ms, IF(mc BETWEEN '0' AND '9', "
        f"(ms * 10 + ascii(mc) - 48) % 97, (ms * 100 + ascii(mc) - 55) % 97)))"
    )


def email(m: str, key: str) -> str:
    return f"concat({feistel(f'substring_index({m}, {literal(chr(64))}, 1)', key, 'email')}, '@', substring_index({m}, '@', -1))"


def iban(m: str, key: str) -> str:
    plain = f"replace({m}, ' ', '')"
    new = let("ib", feistel("substr(ip, 5)", key, "iban"), f"concat(left(ip, 2), lpad(CAST(98 - {mod97('concat(ib, left(ip, 2), {z})').replace('{z}', literal('00'))} AS STRING), 2, '0'), ib)")
    done = let("ip", plain, f"IF({mod97('concat(substr(ip, 5), left(ip, 4))')} = 1, {let('iq', new, refill(m, 'iq', '[A-Z0-9]'))}, {m})")
    return done


def day_number(iso: str) -> str:
    return f"datediff(try_cast({iso} AS DATE), DATE'{FIRST_DAY}')"


def date(m: str, key: str) -> str:
    new = f"CAST(date_add(DATE'{FIRST_DAY}', CAST({feistel_number('dn', SIDE, key, 'date')} AS INT)) AS STRING)"
    return let("dn", day_number(m), f"IF(dn BETWEEN 0 AND {SIDE * SIDE - 1}, {new}, {m})")


def day(m: str, key: str) -> str:
    """Day, month, year; month and day where only that is a date. One or two digits as the value had them, at least."""
    a, b, y, s = (f"regexp_extract({m}, '^([0-9]+)([./])([0-9]+)[./]([0-9]+)$', {i})" for i in (1, 3, 4, 2))
    iso = f"concat(lpad({y}, 4, '0'), '-', lpad({{}}, 2, '0'), '-', lpad({{}}, 2, '0'))"
    number = f"coalesce({day_number(iso.format(b, a))}, {day_number(iso.format(a, b))})"
    moved = f"date_add(DATE'{FIRST_DAY}', CAST({feistel_number('dn', SIDE, key, 'date')} AS INT))"
    first = f"IF({day_number(iso.format(b, a))} IS NOT NULL, 'dd', 'MM')"
    written = let("dm", moved, f"concat(date_format(dm, {first}), {s}, date_format(dm, IF({first} = 'dd', 'MM', 'dd')), {s}, date_format(dm, 'yyyy'))")
    return let("dn", number, f"IF(dn BETWEEN 0 AND {SIDE * SIDE - 1}, {written}, {m})")


def ip(m: str, key: str) -> str:
    octets = [f"CAST(element_at(split({m}, '[.]'), {i}) AS BIGINT)" for i in range(1, 5)]
    number = f"({octets[0]} * 16777216 + {octets[1]} * 65536 + {octets[2]} * 256 + {octets[3]})"
    new = let("iv", feistel_number(number, 65536, key, "ip"), "concat_ws('.', iv DIV 16777216, (iv DIV 65536) % 256, (iv DIV 256) % 256, iv % 256)")
    valid = f"greatest({', '.join(octets)}) <= 255"
    return f"IF({valid}, {new}, {m})"


def ssn(m: str, key: str) -> str:
    def valid(d: str) -> str:
        return f"({d} NOT RLIKE '^(000|666|9)' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6) <> '0000')"

    # outside the valid numbers the permutation is applied again, until it is back among them
    walk = f"aggregate(sequence(1, 40), {feistel('sd', key, 'ssn')}, (sw, si) -> IF({valid('sw')}, sw, {feistel('sw', key, 'ssn')}))"
    return let("sd", f"replace({m}, '-', '')", f"IF({valid('sd')}, {let('sn', walk, refill(m, 'sn', '[0-9]'))}, {m})")


def card(m: str, key: str) -> str:
    """The first digit (the network) stays; the check digit is made anew."""
    body = let("cb", f"concat(left(cd, 1), {feistel('substr(cd, 2, length(cd) - 2)', key, 'card')})", f"concat(cb, CAST((10 - {luhn('cb')} % 10) % 10 AS STRING))")
    valid = f"({luhn('left(cd, length(cd) - 1)')} + CAST(right(cd, 1) AS INT)) % 10 = 0"
    return let("cd", f"regexp_replace({m}, '[^0-9]', '')", f"IF({valid}, {let('cn', body, refill(m, 'cn', '[0-9]'))}, {phone(m, key)})")


def phone(m: str, key: str) -> str:
    """The country code and the first digit of each group stay."""
    code = f"regexp_extract({m}, '^[+][0-9]{{1,3}}(?=[^0-9])', 0)"
    marked = "regexp_replace(pr, '(?<![0-9])[0-9]', 'x')"  # x: a digit that stays
    free = f"regexp_replace({marked}, '[^0-9]', '')"
    filled = let("pf", feistel(free, key, "phone"), refill(marked, "pf", "[0-9]"))
    kept = "regexp_replace(regexp_replace(pr, '(?<=[0-9])[0-9]', ''), '[^0-9]', '')"
    whole = let("pm", filled, refill("pm", kept, "x"))
    digits = f"length(regexp_replace({m}, '[^0-9]', ''))"
    return let("pc", code, f"IF({digits} BETWEEN 7 AND 15, concat(pc, {let('pr', f'substr({m}, length(pc) + 1)', whole)}), {m})")


MAKERS = {"email": email, "iban": iban, "date": date, "day": day, "ip": ip, "ssn": ssn, "card": card, "phone": phone}


def pattern() -> str:
    """One pattern for all formats; groups are counted so that the back reference fits."""
    parts, groups = [], 0
    for _, p in FORMATS:
        parts.append(re.sub(r"\\1", rf"\\{groups + 1}", p))
        groups += len(re.findall(r"(?<!\\)\((?!\?)", p))
    return "|".join(parts)


def pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of a matched value, or the value itself where it is not valid."""
    cases = " ".join(f"WHEN {m} RLIKE {literal(f'^(?:{p})$')} THEN {MAKERS[name](m, key)}" for name, p in FORMATS)
    return f"CASE {cases} ELSE {m} END"


def pseudonymize(docs: DataFrame, secret: str, *, text: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the number of values replaced in a new column ``count``.

    ``secret`` keys the permutations. Null texts stay null with a count of 0, empty ones empty; rows and
    other columns stay as they are; an existing column ``count`` is an error. Whole texts; no shuffle.
    """
    if count in docs.columns:
        raise ValueError(f"there is a column {count} already")
    names = {}
    for name in ("gaps", "found", "made"):
        fresh = f"_{name}"
        while fresh in docs.columns:
            fresh = f"_{fresh}"
        names[name] = fresh
    gaps, found, made = names["gaps"], names["found"], names["made"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = body.rlike(QUICK)
    cut = docs.withColumns({
        gaps: F.when(some, F.split(body, pattern(), -1)),
        found: F.when(some, F.regexp_extract_all(body, F.lit(pattern()), F.lit(0))),
    })
    done = cut.withColumn(made, F.expr(f"transform(`{found}`, v -> {pseudonym('v', literal(secret))})"))
    joined = F.expr(f"array_join(zip_with(`{gaps}`, `{made}`, (g, p) -> concat(g, coalesce(p, ''))), '')")
    changed = F.expr(f"size(filter(zip_with(`{found}`, `{made}`, (a, b) -> a <> b), c -> c))")
    return done.withColumns({
        text: F.when(F.col(made).isNotNull() & (F.size(made) > 0), joined).otherwise(F.col(f"`{text}`")),
        count: F.when(F.col(made).isNotNull(), changed).otherwise(0).cast("long"),
    }).drop(gaps, found, made)
