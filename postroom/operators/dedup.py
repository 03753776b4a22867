"""Exact and near duplicates of documents, and title / file-name collisions.

Results are linear in the documents: each one names the first earlier document it
repeats. Groups of copies never become lists of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions import shingles as sh
from postroom.functions import text as tx
from postroom.functions.scoring import char_ngrams
from postroom.session import cut_lineage, visible


def exact_duplicates(documents: DataFrame, key: str, content: Column) -> DataFrame:
    """Groups with equal content: content_hash, first key, number of copies."""
    hashed = documents.select(key, F.sha2(content, 256).alias("content_hash"))
    return (
        hashed.groupBy("content_hash")
        .agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def _shingles(body: Column, size: int) -> Column:
    """Hashes of the distinct shingles of a body; a short body is one."""
    pieces = F.when(F.length(body) <= size, F.array(body)).otherwise(char_ngrams(body, size))
    return F.array_distinct(F.transform(pieces, lambda piece: F.xxhash64(piece)))


def _keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``id, body, _hash`` of every document: its body and what tells bodies apart."""
    body = tx.content_key(F.col(text))
    return documents.select(F.col(key).alias("id"), body.alias("body")).withColumn("_hash", F.sha2("body", 256))


def _firsts(keyed: DataFrame) -> DataFrame:
    """``id, body`` of the first document of each distinct body."""
    keyed = keyed.filter(F.col("body") != "")
    first = keyed.groupBy("_hash").agg(F.min("id").alias("id")).select("id")
    return keyed.select("id", "body").join(first, "id", "left_semi")


def _mapped(df: DataFrame, body: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``df`` by ``fn``, which sees few rows and few bytes of ``body`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sh.pieces(batch, body):
                yield fn(part)

    return visible(df).mapInArrow(run, schema)


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def _counted(rows: DataFrame, size: int, threshold: tuple[int, int] | None = None) -> DataFrame:
    """``id, body`` with the length of the body and its number of shingles; with a threshold also ``n_ranked``."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bodies = part.column("body").to_pylist()
        sets = sh.shingle_hashes(bodies, size)
        found = [part.column("id"), part.column("body"), pa.array(map(len, sets), pa.int64()), pa.array(map(len, bodies), pa.int64())]
        if threshold is not None:
            found.append(pa.array([_ranked_of(s, *threshold) for s in sets], pa.int64()))
        return pa.record_batch(found, names=["id", "body", "n", "chars", "n_ranked"][: len(found)])

    more = ", n_ranked long" if threshold is not None else ""
    return _mapped(rows, "body", run, f"id {_kind(rows, 'id')}, body string, n long, chars long{more}")


def _bodies(documents: DataFrame, key: str, text: str, size: int, threshold: tuple[int, int] | None = None) -> DataFrame:
    """One row per distinct body: id of its first document, body, its length and number of shingles.

    With a threshold also ``n_ranked``, the number of its shingles that are ranked by frequency.
    """
    return _counted(_firsts(_keyed(documents, key, text)), size, threshold)


RANKED_PARTS = 1000


def _ranked(token: Column, numerator: int, denominator: int) -> Column:
    """Is a token one of those ranked by frequency? About ``2 (1 - t)`` of all are, twice what a prefix holds."""
    return F.pmod(F.xxhash64(token), F.lit(RANKED_PARTS)) * denominator < 2 * RANKED_PARTS * (denominator - numerator)


def _ranked_of(tokens: np.ndarray, numerator: int, denominator: int) -> int:
    """How many of the tokens :func:`_ranked` chooses."""
    part = sh.hashed_longs(tokens).view(np.int64) % RANKED_PARTS
    return int(np.count_nonzero(part * denominator < 2 * RANKED_PARTS * (denominator - numerator)))


MISSED_BITS = 64
MARGIN = 0.02
TURNS = 3
SMALL_SET = 64
CHANCE = 0.21


class Bands:
    """Keys of which two similar bodies share one, but for a chance below ``2 ** -MISSED_BITS``.

    In each turn the shingles are hashed anew and dealt into bins by their leading bits. The least hashes of a bin are equal
    in two sets with the chance of their Jaccard similarity J, or more if both bins are empty. ``rows`` bins make a key, so a
    key is equal with a chance of ``J ** rows``, and all ``bands`` of them differ with ``(1 - J ** rows) ** bands``. So many are
    made that this is less than the chance of two hashes of 64 bits to be equal by accident, from J = ``least`` on, which lies
    ``MARGIN`` below the threshold. Keys of several bins tell bodies apart that only share passages.

    A body inside another can have few of its shingles if one of them repeats itself, or by its own shortness: see :meth:`odd`.
    """

    def __init__(self, numerator: int, denominator: int) -> None:
        self.numerator, self.denominator = numerator, denominator
        threshold = numerator / denominator
        self.least = max(threshold - MARGIN, threshold / 2)
        self.rows = max(1, int(log(CHANCE) / log(self.least)))
        self.turn_bands = ceil(MISSED_BITS * log(2) / -log1p(-(self.least**self.rows)) / TURNS)

    def odd(self, n: int, chars: int) -> bool:
        """May a body lie in this one, or this one in another, at a similarity of the sets below ``least``? Or are they small?

        Two such bodies are compared by :func:`_prefixes` as well.
        """
        inside = chars * (self.denominator - self.numerator) // self.denominator
        around = chars * self.denominator // self.numerator - chars
        return n <= SMALL_SET or n - inside < self.least * n or n < self.least * (n + around)

    def keys(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The keys of each set."""
        found, made = [], []
        for turn in range(TURNS):
            least = sh.least_of_bins(sets, self.rows * self.turn_bands, turn).reshape(len(sets), self.turn_bands, self.rows)
            key = np.zeros((len(sets), self.turn_bands), sh.U) + np.arange(turn * self.turn_bands, (turn + 1) * self.turn_bands, dtype=sh.U)
            for row in range(self.rows):
                key = sh.hashed_longs(least[:, :, row], key)
            found.append(key.view(np.int64))
            made.append((least != sh.NONE).any(axis=2))
        keys, there = np.concatenate(found, axis=1), np.concatenate(made, axis=1)
        return [k[t] for k, t in zip(keys, there, strict=True)]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _signed(rows: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """``id, n, chars, n_ranked, keys, bits`` per body, and ``body, shingles`` of those that are :meth:`Bands.odd`."""
    bands = Bands(numerator, denominator)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bodies = part.column("body").to_pylist()
        sets = sh.shingle_hashes(bodies, size)
        odd = [bands.odd(len(s), len(body)) for s, body in zip(sets, bodies, strict=True)]
        return pa.record_batch(
            [
                part.column("id"), pa.array([b if o else None for b, o in zip(bodies, odd, strict=True)], pa.string()),
                pa.array(map(len, sets), pa.int64()), pa.array(map(len, bodies), pa.int64()),
                pa.array([_ranked_of(s, numerator, denominator) if o else 0 for s, o in zip(sets, odd, strict=True)], pa.int64()),
                _lists(bands.keys(sets)), _lists([sh.parity(s) for s in sets]),
                _lists([s if o else s[:0] for s, o in zip(sets, odd, strict=True)]),
            ],
            names=["id", "body", "n", "chars", "n_ranked", "keys", "bits", "shingles"],
        )

    return _mapped(rows, "body", run, f"id {_kind(rows, 'id')}, body string, n long, chars long, n_ranked long, keys array<long>, bits array<long>, shingles array<long>")


def _prefixes(bodies: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Index entries (token, id, n, chars, place) that every similar pair is bound to share.

    Tokens are ordered: first the ranked ones, chosen by hash, by the number of bodies that hold them, rare ones
    first; then the others by hash. Only the ranked ones are counted, so only they are shuffled; a prefix rarely
    needs more than it has of them. Two sets with Jaccard >= t share a token among their first
    ``n - ceil(t n) + 1``. A text inside a longer one lacks at most ``(1 - t) chars`` of its tokens, so the longer
    text's first ``floor((1 - t) chars) + 1`` hold the shorter text's first. A ranked token of one body only takes
    its place in the prefix but needs no entry. ``place`` counts from 1.
    """
    needed = F.expr(f"(n * {numerator} + {denominator - 1}) div {denominator}")
    lacking = F.expr(f"(chars * {denominator - numerator}) div {denominator}")
    length = F.least(F.col("n"), F.greatest(F.col("n") - needed + 1, lacking + 1))
    ranked = F.filter("shingles", lambda token: _ranked(token, numerator, denominator))
    bodies = bodies.withColumn("_print", F.xxhash64("body"))  # an id may name several bodies
    tokens = bodies.select("id", "_print", F.explode_outer(ranked).alias("token")).filter("token IS NOT NULL")
    tokens = tokens.repartition("token")  # counted and joined where they are: one shuffle for both
    counts = tokens.groupBy("token").agg(F.count("id").alias("df")).filter(F.col("df") > 1)
    common = tokens.join(counts, "token").groupBy("id", "_print").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    single = F.col("n_ranked") - F.size("common")
    left = F.greatest(F.lit(0), length - single).cast("int")
    first = (
        bodies.select("id", "_print", "n", "n_ranked", "chars").distinct().join(common, ["id", "_print"])
        .select("id", "n", "chars", single.alias("_single"), F.posexplode_outer(F.slice("common", F.lit(1), left)).alias("_at", "_token"))
        .select("id", "n", "chars", F.col("_token.token").alias("token"), (F.col("_single") + F.col("_at") + 1).alias("place"))
    )
    others = F.array_sort(F.filter("shingles", lambda token: ~_ranked(token, numerator, denominator)))
    beyond = bodies.filter(length > F.col("n_ranked")).select(
        "id", "n", "chars", "n_ranked", F.posexplode_outer(F.slice(others, F.lit(1), (length - F.col("n_ranked")).cast("int"))).alias("_at", "token")
    ).select("id", "n", "chars", "token", (F.col("n_ranked") + F.col("_at") + 1).alias("place"))
    return first.unionByName(beyond).filter(F.col("token").isNotNull())


MEETING_ROWS = 500_000


def _met(entries: DataFrame) -> DataFrame:
    """The entries of the tokens of two rows or more, with the entry of least id of each as ``lead_*``."""
    names = ["token", "id", "n", "chars", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [batch for batch in batches if batch.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        token = rows.column("token").to_numpy()
        order = np.argsort(token)
        equal = np.append(token[order][1:] == token[order][:-1], False)
        several = order[equal | np.append(False, equal[:-1])]
        rows = rows.take(pa.array(several)).sort_by([(name, "ascending") for name in names])
        token = rows.column("token").to_numpy()
        heads = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        lead = rows.select(names[1:]).take(pa.array(np.repeat(heads, np.diff(np.append(heads, len(token))))))
        for name in names[1:]:
            rows = rows.append_column(f"lead_{name}", lead.column(name))
        yield from rows.combine_chunks().to_batches(max_chunksize=10_000)

    kind = _kind(entries, "id")
    schema = f"token long, id {kind}, n long, chars long, place long, lead_id {kind}, lead_n long, lead_chars long, lead_place long"
    parts = max(1, entries.count() // MEETING_ROWS)
    dealt = entries.select(*names).repartition(max(parts, entries.sparkSession.sparkContext.defaultParallelism), "token")
    return visible(dealt).mapInArrow(run, schema)


def _verified(pairs: DataFrame, keyed: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """The similar ones of the pairs: length ratio when the shorter body lies in the longer one, else Jaccard of the
    shingle sets; as a fraction of integers, so that it compares exactly with the threshold.

    Bodies travel to their pairs as text, an eighth of their shingles' bytes; the shingles are built
    where a pair is compared, and only if neither body lies in the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sh.pieces(batch, "a", size=1 << 20):
                yield judged(part)

    def judged(part: pa.RecordBatch) -> pa.RecordBatch:
        met = list(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True))
        inside = [a in b if len(a) <= len(b) else b in a for a, b in met]
        texts = list({text: None for pair, i in zip(met, inside, strict=True) if not i for text in pair})
        sets = dict(zip(texts, (s for text in texts for s in sh.shingle_hashes([text], size)), strict=True))
        at, similarity = [], []
        for i, (a, b) in enumerate(met):
            if inside[i]:
                top, bottom = sorted((len(a), len(b)))
            else:
                top = sh.shared_count(sets[a], sets[b])
                bottom = len(sets[a]) + len(sets[b]) - top
            if top * denominator >= bottom * numerator:
                at.append(i)
                similarity.append(top / bottom)
        at = pa.array(at, pa.int64())
        return pa.record_batch([part.column("earlier").take(at), part.column("later").take(at), pa.array(similarity, pa.float64())], names=["earlier", "later", "similarity"])

    pairs = cut_lineage(pairs)
    used = pairs.select(F.explode(F.array("earlier", "later")).alias("id")).distinct()
    sides = keyed.filter(F.col("body") != "").select("id", "body").join(used, "id", "left_semi")
    met = pairs.join(sides.toDF("earlier", "a"), "earlier").join(sides.toDF("later", "b"), "later").select("earlier", "later", "a", "b")
    kind = _kind(pairs, "earlier")
    return visible(met).mapInArrow(run, f"earlier {kind}, later {kind}, similarity double")


def _side(prefix: str) -> list[Column]:
    return [F.col(name).alias(f"{prefix}_{name}") for name in ("id", "n", "chars", "place")]


def _sizes_allow(numerator: int, denominator: int) -> Column:
    """Could the pair (a, b) reach the threshold, by set sizes for Jaccard or by lengths for containment?

    In a list of :func:`_prefixes` a text inside a longer one has its first token, and all others but small sets have a key of
    :class:`Bands` in common as well.
    """

    def close(what: str) -> Column:
        low, high = F.least(f"a_{what}", f"b_{what}"), F.greatest(f"a_{what}", f"b_{what}")
        return low * denominator >= high * numerator

    def inside(low: str, high: str) -> Column:
        more = F.col(f"{high}_n") - F.col(f"{low}_n")
        longer = F.col(f"{high}_chars") - F.col(f"{low}_chars")
        return (longer >= 0) & (more >= 0) & (more <= longer) & (F.col(f"{low}_place") <= 1)

    small = (F.greatest("a_n", "b_n") <= SMALL_SET) | (F.col("a_place") == 0)
    return (close("n") & small) | (close("chars") & (inside("a", "b") | inside("b", "a")))


def _near_enough(pairs: DataFrame, bodies: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs without those that cannot be similar, as their sets differ in too many parity bits of the shingles."""

    def side(prefix: str, name: str) -> DataFrame:
        return bodies.select(F.col("id").alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "chars", "bits")])

    flips = F.expr(" + ".join(f"bit_count(a_bits[{i}] ^ b_bits[{i}])" for i in range(sh.PARITY_BITS // 64)))
    jaccard = flips * (numerator + denominator) <= (F.col("a_n") + F.col("b_n")) * (denominator - numerator)
    more = F.when(F.col("a_chars") <= F.col("b_chars"), F.col("b_n") - F.col("a_n")).otherwise(F.col("a_n") - F.col("b_n"))
    low, high = F.least("a_chars", "b_chars"), F.greatest("a_chars", "b_chars")
    inside = (low * denominator >= high * numerator) & ((flips <= more) | (low < size))
    met = pairs.join(side("a", "earlier"), "earlier").join(side("b", "later"), "later")
    return met.filter(jaccard | inside).select("earlier", "later").distinct()


def _short_containments(bodies: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """Pairs whose shorter body is below the shingle size, found by equal substrings."""
    longest = (size - 1) * denominator // numerator
    small = bodies.filter(F.col("chars") <= longest).select("id", "body", "chars")
    lengths = range(1, size)
    parts = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.when(
                        (F.col("chars") > w) & (F.lit(w * denominator) >= F.col("chars") * numerator),
                        char_ngrams(F.col("body"), w),
                    ).otherwise(F.array().cast("array<string>"))
                    for w in lengths
                ]
            )
        )
    )
    holders = small.select(F.col("id").alias("holder"), F.explode_outer(parts).alias("body")).filter(F.col("body").isNotNull())
    found = holders.join(small.select("id", "body"), "body")
    return found.select(F.least("id", "holder").alias("earlier"), F.greatest("id", "holder").alias("later"))


def stored_bodies(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The bodies of the documents, made once for all steps that read them: what ``keyed`` takes."""
    return cut_lineage(_keyed(documents, key, text))


def similar_bodies(
    documents: DataFrame,
    *,
    key: str,
    text: str,
    threshold: tuple[int, int] = lx.NEAR_DUPLICATE_THRESHOLD,
    size: int = lx.SHINGLE_SIZE,
    keyed: DataFrame | None = None,
) -> DataFrame:
    """For each distinct body (by its first document) the first earlier similar body.

    Rows: id, similar_id, similarity; bodies without one are left out. The threshold is a fraction of integers and every
    candidate is verified exactly. Candidates share a key of :class:`Bands`, or of :func:`_prefixes` where two bodies are small
    or repeat themselves; a similar pair shares none with a chance below ``2 ** -64``, as two hashes are equal by accident.

    In each bucket of a common key every body first meets the earliest member. A
    body that is similar to it is done with that bucket, as no earlier member exists
    there; so a large family of near copies costs one comparison per member. What is
    left meets the members between the earliest one and its best hit so far.
    """
    numerator, denominator = threshold
    keyed = stored_bodies(documents, key, text) if keyed is None else keyed
    bodies = cut_lineage(_signed(_firsts(keyed), size, numerator, denominator))
    small = cut_lineage(_prefixes(bodies.filter("body IS NOT NULL"), numerator, denominator))
    keys = bodies.select("id", "n", "chars", F.lit(0).cast("long").alias("place"), F.explode_outer("keys").alias("token"))
    shared = cut_lineage(_met(keys.filter("token IS NOT NULL").unionByName(small)))
    led = shared.select("token", *_side("b"), *[F.col(f"lead_{n}").alias(f"a_{n}") for n in ("id", "n", "chars", "place")])
    led = led.filter(F.col("a_id") < F.col("b_id"))
    short = bodies.filter("body IS NOT NULL")  # all that are shorter than a shingle are small
    candidates = (
        led.filter(_sizes_allow(numerator, denominator)).select(F.col("a_id").alias("earlier"), F.col("b_id").alias("later"))
        .unionByName(_short_containments(short, size, numerator, denominator))
    )
    sketches = bodies.select("id", "n", "chars", "bits")

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(_near_enough(pairs.distinct(), sketches, size, numerator, denominator), keyed, size, numerator, denominator)

    first = cut_lineage(verified(candidates))
    every = first.unionByName(verified(_leftover(shared, led, first, numerator, denominator)))
    return (
        every.groupBy(F.col("later").alias("id"))
        .agg(F.min(F.struct("earlier", "similarity")).alias("_hit"))
        .select("id", F.col("_hit.earlier").alias("similar_id"), F.col("_hit.similarity").alias("similarity"))
    )


def _leftover(shared: DataFrame, led: DataFrame, first: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs that the comparison with the earliest members did not settle."""
    best = first.groupBy(F.col("later").alias("b_id")).agg(F.min("earlier").alias("_best"))
    settled = first.select(F.col("earlier").alias("a_id"), F.col("later").alias("b_id"))
    pending = led.join(settled, ["a_id", "b_id"], "left_anti").join(best, "b_id", "left")
    return (
        pending.select("token", F.col("a_id").alias("_leader"), "_best", *[F.col(f"b_{n}") for n in ("id", "n", "chars", "place")])
        .join(shared.select("token", *_side("a")), "token")
        .filter(
            (F.col("a_id") > F.col("_leader"))
            & (F.col("a_id") < F.least("b_id", F.coalesce("_best", "b_id")))
            & _sizes_allow(numerator, denominator)
        )
        .select(F.col("a_id").alias("earlier"), F.col("b_id").alias("later"))
    )


BANDS, BAND_ROWS = 32, 4


def _band_keys(bodies: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(token, id, n, chars): one row per body and band of its minwise signature.

    One pass over the shingle hashes: their leading bits name one of ``bands * rows`` bins, whose signature is its
    smallest hash; an empty bin takes the next one's. Equal runs of ``rows`` bins make equal keys.
    """
    bins = bands * rows
    if bins & (bins - 1):
        raise ValueError("bands * rows must be a power of two")
    shift = 64 - (bins.bit_length() - 1)

    def signature(found: np.ndarray) -> np.ndarray:
        place = (found >> shift) + bins // 2 if bins > 1 else np.zeros(len(found), np.int64)
        heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        after = np.searchsorted(place[heads], np.arange(bins))
        return found[heads[after % len(heads)]]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bodies = part.column("body").to_pylist()
        sets = sh.shingle_hashes(bodies, size)
        signed = np.array([signature(s) for s in sets], np.int64).reshape(len(sets), bands, rows)
        key = np.broadcast_to(sh.hashed_ints(np.arange(bands)), (len(sets), bands))
        for row in range(rows):
            key = sh.hashed_longs(np.ascontiguousarray(signed[:, :, row]), key)
        return pa.record_batch(
            [part.column("id"), pa.array(map(len, sets), pa.int64()), pa.array(map(len, bodies), pa.int64()), _lists(list(key.view(np.int64)))],
            names=["id", "n", "chars", "keys"],
        )

    found = _mapped(bodies.select("id", "body"), "body", run, f"id {_kind(bodies, 'id')}, n long, chars long, keys array<long>")
    return found.select("id", "n", "chars", F.explode_outer("keys").alias("token"))


def similar_bodies_approximate(
    documents: DataFrame,
    *,
    key: str,
    text: str,
    threshold: tuple[int, int] = lx.NEAR_DUPLICATE_THRESHOLD,
    size: int = lx.SHINGLE_SIZE,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    keyed: DataFrame | None = None,
) -> DataFrame:
    """Approximate form of :func:`similar_bodies`: an earlier similar body, not always the first, for most that have one.

    Bodies whose minwise signatures agree in a band share a key. Each meets the earliest body of its keys only, so there are
    at most ``bands`` comparisons per body whatever the size of a family or the number of bodies with a common line; every
    hit is verified, so nothing is called similar that is not. Bodies shorter than a shingle are compared exactly.
    """
    numerator, denominator = threshold
    keyed = stored_bodies(documents, key, text) if keyed is None else keyed
    bodies = _firsts(keyed)
    entries = cut_lineage(_band_keys(bodies, size, bands, rows))
    short = bodies.withColumn("chars", F.length("body").cast("long"))
    met = _met(entries.withColumn("place", F.lit(0).cast("long")))
    led = met.select(*_side("b"), *[F.col(f"lead_{n}").alias(f"a_{n}") for n in ("id", "n", "chars", "place")])
    near = led.filter((F.col("a_id") < F.col("b_id")) & _sizes_allow(numerator, denominator))
    candidates = near.select(F.col("a_id").alias("earlier"), F.col("b_id").alias("later")).unionByName(
        _short_containments(short, size, numerator, denominator)
    )
    hits = _verified(candidates.distinct(), keyed, size, numerator, denominator)
    return (
        hits.groupBy(F.col("later").alias("id"))
        .agg(F.min(F.struct("earlier", "similarity")).alias("_hit"))
        .select("id", F.col("_hit.earlier").alias("similar_id"), F.col("_hit.similarity").alias("similarity"))
    )


def near_duplicates(
    documents: DataFrame, *, key: str, text: str, threshold: tuple[int, int] = lx.NEAR_DUPLICATE_THRESHOLD,
    approximate: bool = False,
) -> DataFrame:
    """Per document: ``first_id`` of its body and the earliest similar other body (an early one in approximate mode)."""
    keyed = stored_bodies(documents, key, text)
    hashed = keyed.select(F.col("id").alias(key), "_hash")
    first = hashed.groupBy("_hash").agg(F.min(key).alias("first_id"))
    find = similar_bodies_approximate if approximate else similar_bodies
    similar = find(documents, key=key, text=text, threshold=threshold, keyed=keyed)
    return (
        hashed.join(first, "_hash")
        .join(similar.withColumnRenamed("id", "first_id"), "first_id", "left")
        .select(key, "first_id", "similar_id", "similarity")
    )


def same_file_name(documents: DataFrame, key: str, source: str) -> DataFrame:
    """(key, same_name_id): first earlier document with the same file stem."""
    stems = documents.select(key, tx.source_stem(F.col(source)).alias("_stem"))
    first = stems.groupBy("_stem").agg(F.min(key).alias("same_name_id"))
    return stems.join(first, "_stem").filter(F.col("same_name_id") < F.col(key)).select(key, "same_name_id")


TITLE_GRAMS = (1, 3, 8, 20, 50)


def similar_titles(documents: DataFrame, key: str, title: str) -> DataFrame:
    """(key, similar_title_id): first earlier document whose title holds this one's or lies in it.

    Distinct titles only. The start of the shorter title, at the largest gram size
    that fits, is looked up among the grams of the longer ones. Grams are shuffled as
    hashes; titles are joined to those that some title starts with, and compared whole.
    """
    # the title comes out of the whole text: stored once, read by the steps below
    titled = cut_lineage(documents.select(key, tx.title_key(F.col(title)).alias("_title")).filter(F.col("_title") != ""))
    distinct = titled.groupBy("_title").agg(F.min(key).alias("_id"))
    start = F.lit(None).cast("string")
    for size in TITLE_GRAMS:
        start = F.when(F.length("_title") >= size, F.left("_title", F.lit(size))).otherwise(start)
    grams = F.array_distinct(F.flatten(F.array(*[char_ngrams(F.col("_title"), size) for size in TITLE_GRAMS])))
    inner = distinct.select(F.xxhash64(start).alias("_gram"), F.col("_title").alias("_short"), F.col("_id").alias("_short_id"))
    hashed = F.array_distinct(F.transform(grams, lambda gram: F.xxhash64(gram)))
    outer = distinct.select(F.explode_outer(hashed).alias("_gram"), F.col("_id").alias("_long_id"))
    met = outer.join(inner.select("_gram").distinct(), "_gram", "left_semi")
    longer = distinct.select(F.col("_title").alias("_long"), F.col("_id").alias("_long_id"))
    related = inner.join(met.join(longer, "_long_id"), "_gram").filter(F.col("_long").contains(F.col("_short")))
    both = related.select(
        F.inline(
            F.array(
                F.struct(F.col("_short").alias("_title"), F.col("_long_id").alias("_other")),
                F.struct(F.col("_long").alias("_title"), F.col("_short_id").alias("_other")),
            )
        )
    )
    first = both.groupBy("_title").agg(F.min("_other").alias("similar_title_id"))
    return titled.join(first, "_title").filter(F.col("similar_title_id") < F.col(key)).select(key, "similar_title_id")


def upload_decision(strong: Column, weak: Column, force_weak: bool = False) -> Column:
    """Strong duplicates are rejected; weak ones need confirmation unless forced."""
    weak_result = F.lit("accept" if force_weak else "confirm")
    return F.when(strong, F.lit("reject")).when(weak, weak_result).otherwise(F.lit("accept"))


def precheck(
    documents: DataFrame,
    *,
    key: str,
    text: str,
    title: str,
    source: str,
    threshold: tuple[int, int] = lx.NEAR_DUPLICATE_THRESHOLD,
    force_weak: bool = False,
    content: str | None = None,
) -> DataFrame:
    """Per document the first earlier candidate of each kind and the upload decision.

    Strong duplicates have equal ``content``, the cleaned text; without it, equal ``text``.
    """
    hashed = documents.select(key, F.sha2(F.col(content or text), 256).alias("_hash"))
    first = hashed.groupBy("_hash").agg(F.min(key).alias("strong_id"))
    strong = hashed.join(first, "_hash").filter(F.col("strong_id") < F.col(key)).select(key, "strong_id")
    near = near_duplicates(documents, key=key, text=text, threshold=threshold).select(
        key,
        F.when(F.col("first_id") < F.col(key), F.least("first_id", F.coalesce("similar_id", "first_id")))
        .otherwise(F.col("similar_id"))
        .alias("similar_id"),
    )
    joined = (
        documents.select(key)
        .join(strong, key, "left")
        .join(near, key, "left")
        .join(same_file_name(documents, key, source), key, "left")
        .join(similar_titles(documents, key, title), key, "left")
    )
    weak = F.coalesce("similar_id", "same_name_id", "similar_title_id").isNotNull()
    reason = (
        F.when(F.col("strong_id").isNotNull(), "content_hash")
        .when(F.col("similar_id").isNotNull(), "content_similarity")
        .when(F.col("same_name_id").isNotNull(), "same_filename")
        .when(F.col("similar_title_id").isNotNull(), "similar_title")
        .otherwise("")
    )
    return joined.withColumns(
        {"reason": reason, "decision": upload_decision(F.col("strong_id").isNotNull(), weak, force_weak)}
    )
