"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import arrow_map
from postroom.session import cut_lineage

# Bounds of what is learned from: labelled documents per language, and n-grams in each language's filter.
SAMPLE_DOCUMENTS = 1500
LANGUAGE_GRAMS = 60_000
WORD_BITS = 64

SLOTS_LOG2 = 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Hashes of the 4-grams around each letter: the character before it, itself, and the two after it.

    Anything but letters counts as one blank; behind a blank nothing more is looked at.
    """
    if not text:
        return np.zeros(0, np.uint64)
    code = np.frombuffer(f" {text.lower()}  ".encode("utf-32-le", "replace"), np.uint32)
    letter = letter_table()[code]
    code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    at = np.flatnonzero(letter)
    after = code[at + 1]
    second = np.where(after == 32, np.uint64(32), code[at + np.where(after == 32, 1, 2)])
    h = code[at - 1] | code[at] << np.uint64(21) | after << np.uint64(42)
    h = h * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each n-gram in the filters."""
    mask = np.uint64((1 << SLOTS_LOG2) - 1)
    return h & mask, h >> np.uint64(64 - SLOTS_LOG2)


@dataclass(frozen=True)
class Filters:
    """One Bloom filter per language, sliced by bit: a slot holds masks with the bit of each language.

    ``masks`` has a row for each 64 languages.
    """

    languages: tuple[str, ...]
    masks: np.ndarray
    false_rate: np.ndarray

    def shares(self, h: np.ndarray) -> np.ndarray:
        """Per language the share of n-grams that it contains, less what false positives would give."""
        first, second = slots(h)
        hits: list[int] = []
        for at, word in enumerate(self.masks):
            both = word[first] & word[second]
            n = min(len(self.languages) - at * WORD_BITS, WORD_BITS)
            if both.dtype == np.uint8:
                counts = np.bincount(both, minlength=256)
                values = np.arange(256)
                hits += [counts[values >> i & 1 == 1].sum() for i in range(n)]
            else:
                hits += [np.count_nonzero(both >> both.dtype.type(i) & both.dtype.type(1)) for i in range(n)]
        return np.maximum((np.array(hits) / len(h) - self.false_rate) / (1 - self.false_rate), 0.0)

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language with the largest share, and its part of all shares; ties go to the first name."""
        h = grams(text)
        if not len(h) or not self.languages:
            return UNKNOWN, 0.0
        share = self.shares(h)
        best = int(share.argmax())
        total = float(share.sum())
        return self.languages[best], float(share[best]) / total if total else 0.0


def fit(
    docs: DataFrame, *, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = SAMPLE_DOCUMENTS,
    language_grams: int = LANGUAGE_GRAMS,
) -> Filters:
    """Filters from the rows that ``train`` admits, at most ``bound`` per language (lowest hash of the id first).

    A language's filter takes the n-grams that it has twice and that are at least half as frequent in it
    as in any other language: its ``language_grams`` most frequent ones. All languages are learned.
    """
    rows = docs.filter(train).select(docs[key].alias("doc_id"), docs[lang].alias("lang"), docs[text].alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    ids = [
        (r["doc_id"], i)
        for i, name in enumerate(names)
        for r in rows.filter(F.col("lang") == name).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    ]
    chosen = docs.sparkSession.createDataFrame(ids, f"doc_id {dict(rows.dtypes)['doc_id']}, language int")
    # at most ``bound`` ids per language: small whatever the corpus
    sample = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("language", "text")

    def counted(batch: dict[str, list]):
        for language in sorted(set(batch["language"])):
            every = [grams(t) for t, k in zip(batch["text"], batch["language"], strict=True) if k == language]
            values, counts = np.unique(np.concatenate(every), return_counts=True)
            yield from zip([language] * len(values), values.view(np.int64).tolist(), counts.tolist(), strict=True)

    found = cut_lineage(arrow_map(sample, counted, "language int, gram long, n long").groupBy("gram", "language").agg(F.sum("n").alias("n")))
    # a row per language: small whatever the corpus
    totals = F.broadcast(found.groupBy("language").agg(F.sum("n").alias("total")))
    telling = cut_lineage(
        found.join(totals, "language").withColumn("rate", F.col("n") / F.col("total"))
        .groupBy("gram").agg(F.collect_list(F.struct("language", "n", "rate")).alias("by"), F.max("rate").alias("most"))
        .select("gram", "most", F.explode("by").alias("b")).filter("b.n >= 2 AND b.rate * 2 >= most")
        .select("gram", "b.language", "b.n")
    )
    kind = next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(names) <= bits), np.uint64)
    masks = np.zeros((max(1, -(-len(names) // WORD_BITS)), 1 << SLOTS_LOG2), kind)
    fill = np.zeros(len(names))
    for i in range(len(names)):
        top = telling.filter(F.col("language") == i).orderBy(F.desc("n"), "gram").limit(language_grams).select("gram").collect()
        word, bit = masks[i // WORD_BITS], kind(1 << i % WORD_BITS)
        for places in slots(np.array([r["gram"] for r in top], np.int64).view(np.uint64)):
            word[places] |= bit
        fill[i] = np.count_nonzero(word & bit) / len(word)
    return Filters(tuple(names), masks, fill**2)


def identify(docs: DataFrame, filters: Filters, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row, from the text alone.

    Null texts and texts without letters are ``und`` with score 0, as is everything if nothing was
    learned. Rows repeat as they come, null keys stay null, an empty table gives an empty result;
    other columns are not read. Whole texts; one scan and a map, no shuffle.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def run(batch: dict[str, list]):
        for doc_id, value in zip(batch["doc_id"], batch["text"], strict=True):
            yield doc_id, *filters.decide(value)

    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, run, f"doc_id {kind}, lang_pred string, score double")
