"""Best-fit packing of token sequences into bins of a fixed capacity."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Mapping
from unicodedata import is_normalized

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import arrow_map, held
from postroom.session import cut_lineage

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 200_000
CACHED_LENGTH = 48
PUNCTUATION = ".,;:!?|*#$%&()-"
# Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
BYTE_CHARACTERS = {
    b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256))
}

Placed = tuple[int, int, int, int, int]


class WordIds(dict):
    """Identifier bytes of the words seen by this process, in two generations: when the younger is full it replaces the older.

    Keys are UTF-8, as bytes split at ASCII white space faster. A text between ASCII white space is encoded on its
    own: the tokenizer drops white space before it merges, so the concatenation is the encoding of the whole text.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.tails = self.tokenizer.model, {}
        self.older: dict[bytes, bytes] = {}
        self.held = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def lower(self, low: str) -> bytes:
        """Encoding of lower-case letters by the merges alone, held as a word of its own that its other spellings share."""
        key = low.encode()
        ids = self.get(key)
        if ids is None:
            ids = self.older.get(key)
            if ids is None:
                text = low if len(key) == len(low) else key.decode("latin-1").translate(BYTE_CHARACTERS)
                held = self.held
                ids = b"".join([held[t.id] for t in self.model.tokenize(text)])
            if len(key) <= CACHED_LENGTH:
                self[key] = ids
        return ids

    def plain(self, word: str) -> bytes | None:
        """Encoding of letters with punctuation behind them, by the merges alone; None for any other word.

        The tokenizer lower-cases such a word, cuts it before the punctuation and writes its bytes as
        characters; doing so here saves the bookkeeping of a full encoding.
        """
        core = word if word.isalpha() else word.rstrip(PUNCTUATION)
        low = core.lower()
        if not low.isalpha() or not low.isascii() and ("Σ" in core or not is_normalized("NFC", core)):
            return None  # lower-casing or composing may look at neighbours
        if len(core) == len(word):
            return self.lower(low)
        tail = word[len(core) :]
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = b"".join([self.held[t.id] for t in self.model.tokenize(tail)])
        return self.lower(low) + self.tails[tail]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Encodings of ``words`` (UTF-8) not yet held; short ones are kept, long ones only returned."""
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        older = self.older
        unknown = [w for w in words if w not in self]
        self.update([(w, older[w]) for w in unknown if w in older])
        fresh = [w for w in unknown if w not in older]
        rest, extra, held, plain = [], {}, self.held, self.plain
        for word in fresh:
            if (ids := plain(word.decode())) is None:
                rest.append(word)
            else:
                (self if len(word) <= CACHED_LENGTH else extra)[word] = ids
        if rest:
            coded = self.tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False)
            for word, code in zip(rest, coded, strict=True):
                (self if len(word) <= CACHED_LENGTH else extra)[word] = b"".join([held[i] for i in code.ids])
        return extra


def word_ids(path: str) -> WordIds:
    return held(("ids", path), lambda: WordIds(path))


def tokenize_pieces(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A document is its text's ids followed by ``end_id``; null and empty texts are ``end_id`` alone.
    Only documents that exceed the capacity are cut.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batch: dict[str, list]):
        known = word_ids(path)
        for at in range(0, len(batch["text"]), 500):  # words of few texts at a time, so that little is kept beside the cache
            part = [t.encode().split() if t else [] for t in batch["text"][at : at + 500]]
            extra = known.learn(set().union(*part))
            find = (lambda w: extra[w] if w in extra else known[w]) if extra else known.__getitem__
            for doc_id, words in zip(batch["doc_id"][at : at + 500], part, strict=True):
                ids = b"".join(map(find, words)) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[start : start + 4 * capacity]
                    row = (doc_id, piece, start // 4, len(some) // 4, zlib.crc32(some))
                    yield (*row, [int.from_bytes(some[i : i + 4], "little") for i in range(0, len(some), 4)]) if keep_ids else row

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return arrow_map(rows, run, schema + (", ids array<long>" if keep_ids else ""))


class Bins:
    """Groups of equally filled bins by their gap: runs of consecutive bin numbers."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used = capacity, 0
        self.gaps: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                self.runs[gap] = []
                insort(self.gaps, gap)
            self.runs[gap].append((first, count))

    def open(self, count: int) -> int:
        self.used += count
        return self.used - count

    def tightest(self, length: int) -> int | None:
        at = bisect_left(self.gaps, length)
        return self.gaps[at] if at < len(self.gaps) else None

    def take(self, gap: int, wanted: int) -> tuple[int, int]:
        """Up to ``wanted`` bins of one run of this gap."""
        runs = self.runs[gap]
        first, count = runs.pop()
        if count > wanted:
            runs.append((first + wanted, count - wanted))
            count = wanted
        if not runs:
            del self.runs[gap]
            self.gaps.remove(gap)
        return first, count


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Placed], int]:
    """Where the pieces of each length go: ``(length, rank, count, bin, offset)`` runs, and the bins used.

    A run says that the ``count`` pieces of that length from ``rank`` on go to as many consecutive
    bins from ``bin`` on, each at ``offset``. Pieces above half the capacity open a bin each. Pieces
    above a third are matched: the tightest open bin takes the longest one that fits, and what is
    left is paired; so no bin holds more than two of them. Shorter pieces go, longest first, into
    the tightest gap. The work depends on the number of lengths, not on the number of pieces.
    """
    bins, placed = Bins(capacity), []
    rank = dict.fromkeys(counts, 0)
    left = dict(counts)

    def put(length: int, first: int, count: int, offset: int) -> None:
        placed.append((length, rank[length], count, first, offset))
        rank[length] += count
        left[length] -= count

    large = sorted((n for n in counts if 2 * n > capacity), reverse=True)
    middle = sorted((n for n in counts if 2 * n <= capacity < 3 * n), reverse=True)
    small = sorted((n for n in counts if 3 * n <= capacity), reverse=True)
    at = 0  # tightest gaps first need the shortest of the middle lengths; go on from there to longer ones
    ascending = middle[::-1]
    for length in large:
        first, count, gap = bins.open(left[length]), left[length], capacity - length
        put(length, first, count, 0)
        while at < len(ascending) and ascending[at] <= gap:
            at += 1
        for fits in ascending[:at][::-1]:
            if not count:
                break
            if n := min(count, left[fits]):
                put(fits, first, n, length)
                bins.add(gap - fits, first, n)
                first, count = first + n, count - n
        bins.add(gap, first, count)
    spare = None  # a bin with one middle piece
    for length in middle:
        if spare and left[length]:
            put(length, spare[0], 1, spare[1])
            bins.add(capacity - spare[1] - length, spare[0], 1)
            spare = None
        if pairs := left[length] // 2:
            first = bins.open(pairs)
            put(length, first, pairs, 0)
            put(length, first, pairs, length)
            bins.add(capacity - 2 * length, first, pairs)
        if left[length]:
            spare = (bins.open(1), length)
            put(length, spare[0], 1, 0)
    if spare:
        bins.add(capacity - spare[1], spare[0], 1)
    for length in small:
        while left[length]:
            if (gap := bins.tightest(length)) is not None:
                per = gap // length  # as best fit puts them one after the other: a bin is the tightest until it is full
                first, count = bins.take(gap, max(1, left[length] // per))
                each = min(per, left[length])
                for i in range(each):
                    put(length, first, count, capacity - gap + i * length)
                bins.add(gap - each * length, first, count)
            else:
                each = min(capacity // length, left[length])
                count = left[length] // each
                first = bins.open(count)
                for i in range(each):
                    put(length, first, count, i * length)
                bins.add(capacity - each * length, first, count)
    return placed, bins.used


def in_blocks(placed: list[Placed], counts: Mapping[int, int]) -> tuple[dict[int, int], list[tuple[int, ...]]]:
    """A block width per length, and each run once per block of ranks that it reaches: ``(length, block, *run)``.

    The width is the mean size of a length's runs. So there are at most two rows per run, and a piece that
    looks up its block meets at most three runs on average, however uneven the runs are.
    """
    runs = Counter(length for length, *_ in placed)
    widths = {length: -(-counts[length] // n) for length, n in runs.items()}
    blocks = [
        (length, block, first, count, start, offset)
        for length, first, count, start, offset in placed
        for block in range(first // widths[length], (first + count - 1) // widths[length] + 1)
    ]
    return widths, blocks


def assign(pieces: DataFrame, *, capacity: int = CAPACITY, slots: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` needs ``length`` and is read twice.

    One histogram of at most ``capacity`` rows reaches the driver. Pieces of one length are numbered
    inside hash slots, with the slots' totals added, so that no task sees all of a length.
    """
    spark = pieces.sparkSession
    if slots is None:
        slots = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [c for c in pieces.columns if c not in ("length", "ids")]
    pieces = pieces.withColumn("_slot", F.pmod(F.xxhash64(*order), F.lit(slots)).cast("int"))
    totals = pieces.groupBy("length", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    lengths = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    placed, _ = plan(lengths, capacity)
    widths, blocks = in_blocks(placed, lengths)
    narrow = spark.createDataFrame(list(widths.items()), "length long, _width long")
    runs = spark.createDataFrame(blocks, "length long, _block long, _first long, _count long, _bin long, offset long")
    earlier = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("length", "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")).join(
        F.broadcast(narrow), "length"
    )
    inside = Window.partitionBy("length", "_slot").orderBy(*order)
    ranked = (
        pieces.withColumn("_row", F.row_number().over(inside))
        .join(base, ["length", "_slot"])
        .withColumn("_rank", F.col("_base") + F.col("_row") - 1)
        .withColumn("_block", F.expr("_rank div _width"))
    )
    met = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    return (
        ranked.join(F.broadcast(runs) if len(blocks) <= 1_000_000 else runs, ["length", "_block"])
        .filter(met)
        .withColumn("sequence_id", F.col("_bin") + F.col("_rank") - F.col("_first"))
        .select(*[c for c in pieces.columns if c != "_slot"], "sequence_id", "offset")
    )


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """All documents as pieces with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one token long. Rows repeat as they come, each with a place of its own;
    null keys stay null; an empty table packs into nothing; other columns are not read. The pieces
    (a few numbers each, unless ``keep_ids``) are checkpointed, so that texts are tokenized once.
    """
    return assign(cut_lineage(tokenize_pieces(docs, path, capacity=capacity, **options)), capacity=capacity)
