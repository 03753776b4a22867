"""Search terms, keyword and category scores, vectors, hash buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def char_ngrams(text: Column, size: int) -> Column:
    """All character n-grams in order. A capturing lookahead walks the text once."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def token_ngrams(tokens: Column, size: int) -> Column:
    count = F.size(tokens) - (size - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, size), " ")),
    ).otherwise(F.array().cast("array<string>"))


def with_search_terms(
    df: DataFrame,
    text: str,
    name: str = "terms",
    *,
    stop_words: Sequence[str] = lx.STOP_WORDS,
    cjk_stop_words: Sequence[str] = lx.CJK_STOP_WORDS,
    short_terms: Sequence[str] = lx.SHORT_SEARCH_TERMS,
) -> DataFrame:
    """Add the distinct words, word pairs and triples, and CJK 2-4-grams of a text.

    The words are a column of their own: inside the n-gram lambda they would be
    extracted again for every position.
    """
    words = F.filter(
        F.regexp_extract_all(F.col("_lowered"), F.lit("[a-z0-9_]+"), F.lit(0)),
        lambda word: ((F.length(word) >= 3) | word.isin(*short_terms)) & ~word.isin(*stop_words),
    )
    runs = F.regexp_extract_all(F.col("_lowered"), F.lit("[一-鿿]+"), F.lit(0))
    cjk = F.flatten(F.transform(runs, lambda run: F.concat(*[char_ngrams(run, size) for size in (2, 3, 4)])))
    cjk = F.array_except(cjk, F.array(*[F.lit(word) for word in cjk_stop_words]))
    held = F.col("_words")
    return (
        df.withColumn("_lowered", F.lower(text))
        .withColumn("_words", words)
        .withColumn(name, F.array_distinct(F.concat(held, token_ngrams(held, 2), token_ngrams(held, 3), cjk)))
        .drop("_lowered", "_words")
    )


def _terms_literal(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(term) for term in terms]) if terms else F.array().cast("array<string>")


def expand_terms(terms: Column, groups: Sequence[Sequence[str]] = lx.SYNONYM_GROUPS) -> Column:
    """Add every synonym group that shares a term."""
    table = F.array(*[_terms_literal(group) for group in groups])
    touched = F.filter(table, lambda group: F.arrays_overlap(terms, group))
    return F.array_distinct(F.concat(terms, F.flatten(touched)))


def term_weight(term: Column) -> Column:
    """Longer words and phrases tell more."""
    words = F.size(F.split(F.trim(term), " +"))
    return (
        F.when(term.contains(" "), F.least(F.lit(2.4), F.lit(1.4) + F.lit(0.2) * words))
        .when(
            term.rlike("^[一-鿿]+$"),
            F.when(F.length(term) == 2, F.lit(0.8)).when(F.length(term) == 3, F.lit(1.1)).otherwise(F.lit(1.4)),
        )
        .when(F.length(term) >= 9, F.lit(1.4))
        .when(F.length(term) >= 6, F.lit(1.15))
        .otherwise(F.lit(0.8))
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def _weight_sum(terms: Column) -> Column:
    """Sum of term weights. They are multiples of 0.05, so rounding only removes float noise."""
    return F.round(_sum(terms), 4)


def keyword_score(terms: Column, content: Column) -> Column:
    """Weights of the six heaviest terms found in the lower-case content, by 8, at most 1."""
    weights = F.transform(F.filter(terms, lambda term: content.contains(term)), term_weight)
    heaviest = F.slice(F.sort_array(weights, asc=False), 1, lx.KEYWORD_TOP_TERMS)
    return F.least(F.lit(1.0), _weight_sum(heaviest) / F.lit(lx.KEYWORD_DIVISOR))


def category_terms(category: Column, vocabulary: Mapping[str, Sequence[str]] = lx.CATEGORY_TERMS) -> Column:
    chosen = _terms_literal(())
    for name, terms in vocabulary.items():
        chosen = F.when(category == name, _terms_literal(terms)).otherwise(chosen)
    return chosen


def category_score(
    category: Column,
    terms: Column,
    row_category: Column,
    content: Column,
    vocabulary: Mapping[str, Sequence[str]] = lx.CATEGORY_TERMS,
) -> Column:
    """0 across categories; inside one, 0.65 plus the share of its vocabulary that both sides use.

    ``content`` is lower case.
    """
    intent = F.array_intersect(terms, category_terms(category, vocabulary))
    found = _weight_sum(F.transform(F.filter(intent, lambda term: content.contains(term)), term_weight))
    share = safe_ratio(found, _weight_sum(F.transform(intent, term_weight)))
    aligned = F.when(F.size(intent) == 0, F.lit(lx.CATEGORY_BASE)).otherwise(
        F.least(F.lit(1.0), F.lit(lx.CATEGORY_BASE) + F.lit(lx.CATEGORY_RANGE) * share)
    )
    same = category.isNotNull() & (category != "other") & row_category.eqNullSafe(category)
    return F.when(same, aligned).otherwise(F.lit(0.0))


def hybrid_score(vector: Column, keyword: Column, category: Column, weights=lx.RERANK_WEIGHTS) -> Column:
    mixed = (
        vector * F.lit(weights["vector"]) + keyword * F.lit(weights["keyword"]) + category * F.lit(weights["category"])
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(lx.RERANK_CEILING), mixed))
    backed = (category > 0) & ((keyword > 0) | (vector > 0))
    return F.when(backed, F.greatest(clamped, F.lit(lx.RERANK_CATEGORY_FLOOR))).otherwise(clamped)


def reliability(score: Column, bands=lx.RELIABILITY_BANDS, default: str = "weak") -> Column:
    band = F.lit(default)
    for minimum, name in reversed(tuple(bands)):
        band = F.when(score >= minimum, F.lit(name)).otherwise(band)
    return band


def level_rank(level: Column, order: Sequence[str]) -> Column:
    """Position in an ordered list of levels, 0 for unknown ones."""
    return F.greatest(F.array_position(F.array(*[F.lit(name) for name in order]), level) - 1, F.lit(0))


def match_reason(vector: Column, keyword: Column, category: Column, texts=lx.MATCH_REASONS) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(vector >= 0.55, texts["vector_high"]).when(vector >= 0.35, texts["vector_some"]),
            F.when(keyword >= 0.4, texts["keyword_high"]).when(keyword > 0, texts["keyword_some"]),
            F.when(category > 0, texts["category"]),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "；")).otherwise(texts["default"])


def query_text(text: Column, category: Column, vocabulary: Mapping[str, Sequence[str]] = lx.CATEGORY_TERMS) -> Column:
    """Text that is embedded for a query: category, its vocabulary, the message."""
    words = F.array_join(F.array_sort(category_terms(category, vocabulary)), " ")
    return F.concat_ws("\n", F.concat(F.lit("category: "), F.coalesce(category, F.lit("unknown"))), words, text)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays; 0 for empty, unequal or zero vectors."""

    def dot(a, b):
        return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))

    scale = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    comparable = (F.size(left) > 0) & (F.size(left) == F.size(right)) & (scale > 0)
    return F.when(comparable, dot(left, right) / scale).otherwise(F.lit(0.0))


def hash_tokens(text: Column) -> Column:
    """Tokens for hashed vectors: words, single CJK characters, and bigrams that hold one."""
    lowered = F.lower(text)
    words = F.regexp_extract_all(lowered, F.lit("[a-z0-9_]+|[一-鿿]"), F.lit(0))
    bigrams = F.when(
        lowered.rlike("[一-鿿]"), F.filter(char_ngrams(lowered, 2), lambda pair: pair.rlike("[一-鿿]"))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, bigrams)


def _hex_digit(digest: Column, position: int) -> Column:
    return F.position(F.substring(digest, position, 1), F.lit("0123456789abcdef")).cast("long") - 1


def digest_bucket(digest: Column, buckets: int) -> Column:
    """First 32 bits of a hexadecimal digest modulo ``buckets``.

    For 16, 256, 4096, ... buckets the last hex digits of those bits say it at once.
    """
    digits = next((n for n in range(1, 8) if 16**n == buckets), 0)
    if digits:
        hexes = [_hex_digit(digest, 8 - i) * 16**i for i in range(digits)]
        return sum(hexes[1:], hexes[0])
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def digest_sign(digest: Column) -> Column:
    """Sign from the parity of the fifth digest byte: its last hex digit decides."""
    return F.when(F.substring(digest, 10, 1).isin(*"02468ace"), F.lit(1.0)).otherwise(F.lit(-1.0))


def hash_bucket(value: Column, buckets: int) -> Column:
    return digest_bucket(F.sha2(value, 256), buckets)


def evaluation_split(case_id: Column, calibration_buckets: int = 7) -> Column:
    """Stable split by hash of the id: buckets 0-6 calibrate, 7-9 are held out."""
    return F.when(hash_bucket(case_id, 10) < calibration_buckets, F.lit("calibration")).otherwise(F.lit("holdout"))


def vector_literal(vector: Column) -> Column:
    """Fixed six-decimal text form of a vector."""
    return F.to_json(F.transform(vector, lambda value: F.round(value.cast("double"), 6)))


def decode_vector(text: Column) -> Column:
    """Vector from its text form, empty when it cannot be read."""
    parsed = F.from_json(text, "array<double>")
    usable = parsed.isNotNull() & ~F.exists(parsed, lambda value: value.isNull())
    return F.when(usable, parsed).otherwise(F.array().cast("array<double>"))
