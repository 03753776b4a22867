"""N-gram Jaccard join: size-aware, subsets for small sets and inverted lists for large ones.

Sets A and B of sizes m <= n reach a similarity of T percent exactly if their difference has at most
D(m, n) = (m + n) * (100 - T) / (100 + T) members. From that:

* Small sets: both hold a common subset that lacks few members of either. A set lists all its subsets
  with that many members left out; two sets that link share one of them.
* Large sets: the members are dealt by hash into D + 1 classes; a difference of at most D leaves one class
  equal in both. An inverted list is kept per content of a class. Lists per single shingle would hold every
  document that repeats a common passage; a class mixes about ten shingles from all over the document.
  Of very large sets the members are dealt into ``GROUPS`` groups first: one group differs in at most D / ``GROUPS`` members,
  and has that many classes and one more. So sets that meet in a list of a group need to be that close in this group alone,
  which a few parity bits of the group tell, where those of the whole set would all be used up.

The boundary between the two is where listing the subsets costs more than the lists. Both are exact.
Sets that share a list are compared with the list's first and last member, then, for sets that are
not yet in one component, with other members, so that a group of copies costs a comparison per copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import lru_cache
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import arrow_map, checked_broadcast, enter, folder_exists, fresh_names, held, remove_folder, visible
from postroom.llm.graph import connected_components
from postroom.session import cut_lineage, estimated_bytes, shared_folder

SHINGLE_WORDS = 3
PERCENT = 90

# What an entry of an inverted list costs in entries of a subset list: lists are longer and need more verifying.
LIST_WEIGHT = 8
LEVEL_RATIO = 1.5
PARITY_BITS = 512
GROUPS, LEAST_QUOTA = 8, 16  # groups of the members of a large set; the difference of a group from which on sets are grouped
MARK = 15  # bits of a key that name its group, from 1 on; 0 for none
CACHED_WORDS = 100_000
LEADER_ROUNDS = 1
BUCKET_BYTES, LEAST_BUCKETS, MOST_PARTITIONS = 16 << 20, 16, 20_000  # texts of a bucket of keys
UNKNOWN_BYTES = 1 << 60
THINNED = 16  # sets of a batch that send a key to its bucket
PENDING = 2_000_000  # entries a bucket gathers before it hands on those of very long lists
SENT_NODES = 100_000  # sets whose sizes and parity bits are broadcast, some 150 bytes each

U = np.uint64
MIX_1, MIX_2, MIX_3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(30)) * MIX_2
    h = (h ^ h >> U(27)) * MIX_3
    return h ^ h >> U(31)


class WordHashes(dict):
    """64-bit hashes of the words seen by this process; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles: lower-case A-Z, words between ASCII white space.

    Fewer words than a shingle are one shingle; no words are none.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    known = held(("words",), WordHashes)
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, U)
    for i in range(n):
        total = mixed(total + h[i : len(h) - n + 1 + i] * MIX_1 + U(i))
    return np.unique(total)


class Scheme:
    """Which keys a set of a given size lists, for a threshold in percent."""

    def __init__(self, percent: int = PERCENT) -> None:
        if not 50 < percent < 100:
            raise ValueError("the threshold must lie between 50 and 100 percent")
        self.percent = percent
        size = 1
        while self.subset_cost(size + 1) <= self.list_cost(size + 1):
            size += 1
        self.boundary = size

    def difference(self, m: int, n: int) -> int:
        return (m + n) * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def left_out(self, n: int) -> int:
        """Most members that a common subset lacks of a set of this size."""
        return n * (100 - self.percent) // 100

    def subset_cost(self, n: int) -> int:
        return sum(comb(n, j) for j in range(self.left_out(n) + 1))

    def list_cost(self, n: int) -> int:
        return LIST_WEIGHT * (self.difference(n, n) + 1)

    def classes(self, low: int, high: int) -> tuple[int, int, int]:
        """Groups for larger sizes from ``low`` to ``high``, classes of a group, and how many of them a set may leave empty.

        With D + 1 + e classes, e + 1 are equal in both sets of a pair; so if one of them has at most e empty
        classes, a class with content is equal. e is what a set rarely exceeds. D is the share of a group.
        """
        groups = GROUPS if self.difference(high, high) >= GROUPS * LEAST_QUOTA else 1
        needed = self.difference(high, high) // groups + 1
        smallest = -(-low * self.percent // 100) / groups
        for spare in range(needed // 4 + 1):
            mean = (needed + spare) * exp(-smallest / (needed + spare))
            if spare >= mean + 3 * sqrt(mean) - 0.5:
                break
        return groups, needed + spare, spare

    @lru_cache(maxsize=None)  # noqa: B019 - one scheme per process
    def levels(self, n: int) -> tuple[tuple[int, int, int, int], ...]:
        """(level, groups, classes, spare) of each range of sizes that holds a possible larger partner of a set of size n."""
        found, low, level = [], self.boundary + 1, 0
        top = self.largest_partner(n)
        while low <= top:
            high = int(low * LEVEL_RATIO)
            if high >= n:
                found.append((level, *self.classes(low, high)))
            low, level = high + 1, level + 1
        return tuple(found)

    def grouped(self, n: int) -> bool:
        return any(groups > 1 for _, groups, _, _ in self.levels(n))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of the lists this set is in: two sets that link share a key, or are equal."""
        n = len(shingles)
        token = mixed(shingles)
        found: list[np.ndarray] = []
        if n <= self.boundary and (self.left_out(n) or self.largest_partner(n) > n):
            total = token.sum(dtype=U)
            for j in range(self.left_out(n) + 1):
                out = np.fromiter((token[list(c)].sum(dtype=U) for c in combinations(range(n), j)), U)
                found.append(mixed((total - out) ^ np.array(n - j, U) * MIX_1) & ~U(MARK))
        for level, groups, classes, spare in self.levels(n):
            first = group_of(token) * U(classes) if groups > 1 else U(0)
            by = first + ((shingles >> U(32)) * U(classes) >> U(32))
            tag = U(level + 1) << U(40)
            place = np.arange(groups * classes, dtype=U)
            mark = place // U(classes) + U(1) if groups > 1 else np.zeros(classes, U)
            keys = mixed(mixed(class_sums(token, by, groups * classes) + tag) + place * MIX_1) & ~U(MARK) | mark
            full = np.bincount(by.astype(np.int64), minlength=groups * classes) > 0
            found.append(keys[full])
            second = None
            for at in range(0, groups * classes, classes):
                empty = at + np.flatnonzero(~full[at : at + classes])
                if len(empty) > spare:  # an empty class is no evidence: it counts with each class of a second dealing
                    if second is None:
                        second = class_sums(token, first + ((shingles & U(0xFFFFFFFF)) * U(classes) >> U(32)), groups * classes)
                    part = slice(at, at + classes)
                    found.extend(
                        mixed(mixed(second[part] + tag + U(e + 1)) + (place[part] + U(1) << U(24)) * MIX_1) & ~U(MARK) | mark[part]
                        for e in empty.tolist()
                    )
        return np.unique(np.concatenate(found)) if found else np.zeros(0, U)


def group_of(token: np.ndarray) -> np.ndarray:
    """The group of each member, from bits that neither its class nor its parity bit depends on."""
    return (token >> U(32)) * U(GROUPS) >> U(32)


def class_sums(token: np.ndarray, by: np.ndarray, classes: int) -> np.ndarray:
    """Sum of the tokens in each class: a hash of the class's content that needs no order."""
    sums = np.zeros(classes, U)
    np.add.at(sums, by.astype(np.int64), token)
    return sums


def parity(shingles: np.ndarray) -> np.ndarray:
    """Per bit, whether the set has an odd number of members there; two sets differ in at least as many members as bits."""
    odd = np.bincount((shingles & U(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_by_group(shingles: np.ndarray) -> np.ndarray:
    """The parity bits of each group's members, one group after the other."""
    at = group_of(mixed(shingles)) * U(PARITY_BITS) + (shingles & U(PARITY_BITS - 1))
    odd = np.bincount(at.astype(np.int64), minlength=GROUPS * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def bucket_count(docs: DataFrame, text: str) -> int:
    """Buckets for the keys, in proportion to the bytes of the texts, so that one bucket fits a task at any size."""
    size = estimated_bytes(docs.select(text))
    if size >= UNKNOWN_BYTES:  # no statistics: measure
        size = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    return max(LEAST_BUCKETS, size // BUCKET_BYTES)


def described(rows: DataFrame, scheme: Scheme, width: int, buckets: int) -> DataFrame:
    """Rows of two kinds. ``part = 'rows'``: ``doc_id, print, n, node``, the set's size and hash, and for the first of
    equal sets of a batch ``bits``, its parity bits, and for large sets ``wide``, those by group. ``part = 'keys'``: the batch's keys of one ``bucket``, packed: the low 32 bits
    of each (``keys``) and which of the ``nodes`` lists it (``places``).

    At most ``THINNED`` sets of a batch send a key to its bucket; the others hold it in ``later``. So a key of very
    many sets arrives thinned, and one that is in any ``later`` is known to its bucket as one of many sets.
    """

    def run(batch: dict[str, list]) -> Iterable[tuple]:
        texts: dict[str | None, tuple] = {}
        nodes: dict[int, int] = {}
        keys, found = [], []
        for doc_id, mark, value in zip(batch["doc_id"], batch["print"], batch["text"], strict=True):
            bits = wide = None
            if value not in texts:
                s = shingle_set(value, width)
                n, node = texts[value] = len(s), set_hash(s)
                if n and node not in nodes:
                    nodes[node] = len(nodes)
                    bits = parity(s).tolist()
                    wide = parity_by_group(s).tolist() if scheme.grouped(n) else None
                    keys.append(scheme.keys(s))
            found.append((doc_id, mark, *texts[value], bits, wide))
        later: dict[int, list[int]] = {}
        if keys:
            key = np.concatenate(keys)
            place = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            at = np.arange(len(key))
            rank = at - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]][: len(key)], at, 0))
            bucket = (key >> U(32)) * U(buckets) >> U(32) if len(key) else key
            low = key & U(0xFFFFFFFF)
            for i in np.flatnonzero(rank >= THINNED).tolist():
                later.setdefault(int(place[i]), []).append(int(bucket[i]) << 32 | int(low[i]))
            sent = rank < THINNED
            bucket, low, place = bucket[sent], low[sent].astype(np.uint32), place[sent]
            hashes = np.fromiter(nodes, np.int64, len(nodes))
            ends = np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)] if len(bucket) else ()
            start = 0
            for end in ends:
                used, where = np.unique(place[start:end], return_inverse=True)
                packed = low[start:end].tobytes(), where.astype(np.uint8).tobytes(), hashes[used].tobytes()
                yield None, None, None, None, None, None, None, int(bucket[start]), *packed, "keys"
                start = end
        for doc_id, mark, n, node, bits, wide in found:
            more = later.get(nodes[node]) if bits is not None else None
            yield doc_id, mark, n, node, bits, wide, more, None, None, None, None, "rows"

    return arrow_map(rows, run, described_schema(rows) + ", part string")


def described_schema(rows: DataFrame) -> str:
    kind = dict(rows.dtypes)["doc_id"]
    return (
        f"doc_id {kind}, print long, n long, node long, bits array<long>, wide array<long>, later array<long>, "
        "bucket long, keys binary, places binary, nodes binary"
    )


def parted(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by key and node, each once; per entry its place in its list; per entry the list's size."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    size = np.diff(np.r_[heads, len(key)])
    return key, node, np.arange(len(key)) - np.repeat(heads, size), np.repeat(size, size)


class Bucket:
    """Lists of one bucket, from packed keys that arrive bit by bit.

    Of a key of very many sets only ``THINNED`` entries are held, the others are handed on, so memory
    is bounded by the bucket's different keys.
    """

    def __init__(self, number: int) -> None:
        self.number, self.limit, self.waiting = number, PENDING, 0
        self.key: list[np.ndarray] = []
        self.node: list[np.ndarray] = []

    def add(self, keys: bytes, places: bytes, nodes: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        self.key.append(np.frombuffer(keys, np.uint32))
        self.node.append(np.frombuffer(nodes, np.int64)[np.frombuffer(places, np.uint8)])
        self.waiting += len(self.key[-1])
        if self.waiting < self.limit:
            return None
        key, node, place, size = parted(np.concatenate(self.key), np.concatenate(self.node))
        held_back = place < THINNED
        self.key, self.node = [key[held_back]], [node[held_back]]
        self.waiting = len(self.key[0])
        self.limit = max(PENDING, 2 * self.waiting)
        return self.named(key[~held_back]), node[~held_back]

    def named(self, key: np.ndarray) -> np.ndarray:
        return key.astype(np.int64) | np.int64(self.number << 32)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the lists of two sets or more. A list of few members is named after them, so that equal lists fall together; it belongs to no group."""
        key, node, place, size = parted(np.concatenate(self.key), np.concatenate(self.node))
        many = size > 1
        key, node, place, size = key[many], node[many], place[many], size[many]
        if not len(key):
            return key.astype(np.int64), node
        heads = np.flatnonzero(place == 0)
        members = (mixed(np.add.reduceat(mixed(node.view(U)), heads)) & ~U(MARK)).view(np.int64)
        short = size < THINNED
        name = np.where(short, np.repeat(members, size[heads]), self.named(key))
        _, one = np.unique(members, return_index=True)
        first = np.zeros(len(heads), bool)
        first[one] = True
        keep = ~short | np.repeat(first, size[heads])
        return name[keep], node[keep]


def entries_of(batches: Iterable) -> Iterable:
    """Arrow batches of packed keys, ordered by bucket, to batches of ``key, node``."""
    import pyarrow as pa

    enter(__name__)

    def batch_of(entries: tuple[np.ndarray, np.ndarray] | None) -> Iterable:
        if entries is not None:
            for at in range(0, len(entries[0]), 100_000):
                yield pa.record_batch([pa.array(e[at : at + 100_000]) for e in entries], names=["key", "node"])

    bucket = None
    for batch in batches:
        for number, *packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "places", "nodes")), strict=True):
            if bucket is None or bucket.number != number:
                if bucket is not None:
                    yield from batch_of(bucket.close())
                bucket = Bucket(number)
            yield from batch_of(bucket.add(*packed))
    if bucket is not None:
        yield from batch_of(bucket.close())


def prepared(docs: DataFrame, rows: DataFrame, text: str, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The described rows (``doc_id, print, n, node, bits, wide, later``) and the entries of the lists of several sets.

    Keys lie in the shared folder only until their buckets have been read; the rows stay.
    """
    spark = docs.sparkSession
    buckets = bucket_count(docs, text)
    folder = f"{shared_folder(spark)}/jaccard-{uuid.uuid4().hex}"
    described(rows, Scheme(percent), width, buckets).write.partitionBy("part").parquet(folder)
    schema = described_schema(rows)

    def part(name: str) -> DataFrame:
        empty = spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{folder}/part={name}") if folder_exists(spark, f"{folder}/part={name}") else empty

    base = part("rows").select("doc_id", "print", "n", "node", "bits", "wide", "later")
    parts = min(buckets, MOST_PARTITIONS)
    packed = part("keys").select("bucket", "keys", "places", "nodes")
    met = packed.repartitionById(parts, F.expr(f"int(bucket % {parts})")).sortWithinPartitions("bucket")
    found = visible(met).mapInArrow(entries_of, "key long, node long")
    others = base.filter("later IS NOT NULL").select(F.explode("later").alias("key"), "node")
    entries = cut_lineage(found.unionByName(others).distinct())
    remove_folder(spark, f"{folder}/part=keys")
    return base, entries


def shared_lists(entries: DataFrame) -> DataFrame:
    """Entries ``key, node, low, high, members`` of the lists with two sets or more; low and high are two of them."""
    ends = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("node").alias("members"))
    return cut_lineage(entries.join(ends.filter("low < high"), "key"))


def close_enough(percent: int, groups: str = "1") -> str:
    """SQL over columns na, bits_a, nb, bits_b: false only for pairs that cannot link.

    Where the bits are those of one of several ``groups``, also for pairs whose difference there is over the group's share.
    """
    flips = " + ".join(f"bit_count(bits_a[{i}] ^ bits_b[{i}])" for i in range(PARITY_BITS // 64))
    return (
        f"100 * least(na, nb) >= {percent} * greatest(na, nb) "
        f"AND ({flips}) * {groups} * {100 + percent} <= (na + nb) * {100 - percent}"
    )


def verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the threshold, counted exactly.

    The texts ``pa, pb`` that the pairs name travel to them, which is less than half of their sets' bytes and
    compresses; the sets are built where a pair is compared.
    """

    def run(batch: dict[str, list]) -> Iterable[tuple]:
        sets = {t: shingle_set(t, width) for t in {*batch["ta"], *batch["tb"]}}
        for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
            both = len(np.intersect1d(sets[ta], sets[tb], assume_unique=True))
            if 100 * both >= percent * (len(sets[ta]) + len(sets[tb]) - both):
                yield a, b

    met = pairs.join(texts.select(F.col("print").alias("pa"), F.col("text").alias("ta")), "pa").join(
        texts.select(F.col("print").alias("pb"), F.col("text").alias("tb")), "pb"
    )
    return arrow_map(met.select("a", "b", "ta", "tb"), run, "a long, b long")


def join(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the smallest id that a row reaches by links, itself included.

    Rows link when the sets' intersection is at least ``percent`` percent of their union. Equal sets
    link; null, empty and blank texts have no shingles and link with nothing, so their component is
    their own id. Rows repeat as they come. A null id takes part but never names a component; if no id
    of a component is known, ``component_id`` is null. An empty table gives an empty result; other
    columns are not read. Sets are told apart by 64-bit hashes.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).withColumn("print", F.xxhash64("text"))
    base, entries = prepared(docs, rows, text, percent, width)
    roots = linked_sets(rows, base, entries, percent, width)
    return labelled(base, roots)


def linked_sets(rows: DataFrame, base: DataFrame, entries: DataFrame, percent: int, width: int) -> DataFrame:
    """``node, root`` for each set that links to a set of a smaller hash."""
    lists = shared_lists(entries)
    long = lists.filter("members > 3")  # of three members, all are compared with the first or the last
    nodes = cut_lineage(
        base.filter("bits IS NOT NULL").join(lists.select("node").distinct(), "node", "left_semi")
        .groupBy("node").agg(F.min("print").alias("print"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("wide").alias("wide"))
    )
    sizes = checked_broadcast(nodes.select("node", "n", "bits"), SENT_NODES)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` that link: by size and parity first, then by their sets, which are built anew from their texts."""
        a = sizes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        b = sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        near = cut_lineage(pairs.join(a, "a").join(b, "b").filter(close_enough(percent)).select("a", "b"))
        if near.isEmpty():
            return near
        prints = nodes.select("node", "print")
        named = near.join(prints.toDF("a", "pa"), "a").join(prints.toDF("b", "pb"), "b")
        used = named.select(F.explode(F.array("pa", "pb")).alias("print")).distinct()
        wanted = rows.select("print", "text").join(checked_broadcast(used), "print", "left_semi").dropDuplicates(["print"])
        return cut_lineage(verified(named, wanted, percent, width))

    first = lists.select(
        F.inline(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b"))))
    ).filter("a < b").distinct()
    roots = connected_components(linked(first))
    for turn in range(LEADER_ROUNDS + 1):
        placed = long.join(checked_broadcast(roots, 10 * SENT_NODES), "node", "left").select("key", "node", "low", "high", F.coalesce("root", "node").alias("root"))
        parted = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key")
        left = cut_lineage(placed.join(parted, "key"))  # a list is done when its members lie in one component
        if left.isEmpty():
            break
        if turn < LEADER_ROUNDS:
            leaders = left.filter("node != low AND node != high").groupBy("key").agg(
                F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("lead")
            )
            pairs = left.join(leaders, "key").filter("root != lead.root").select(
                F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")
            )
            pairs = pairs.distinct()
        else:
            # in a list of a group only that group's bits are compared: sets that link share a list of the group they differ least in
            known = checked_broadcast(nodes.join(left.select("node").distinct(), "node", "left_semi"), SENT_NODES // GROUPS)
            mark, longs = F.expr(f"int(key & {MARK})"), PARITY_BITS // 64
            side = left.filter("node != low AND node != high").join(known, "node").select(
                "key", "node", "root", "n", mark.alias("mark"), F.when(mark > 0, F.slice("wide", (mark - 1) * longs + 1, F.lit(longs))).otherwise(F.col("bits")).alias("bits")
            )
            a = side.select("key", "mark", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
            b = side.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
            near = F.expr(close_enough(percent, f"IF(mark > 0, {GROUPS}, 1)"))
            pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near).select("a", "b").distinct()
        more = linked(pairs)
        if not more.isEmpty():
            roots = connected_components(more.unionByName(roots.toDF("a", "b")))
    return roots


def labelled(base: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the smallest id of their component."""
    own = base.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    top = own.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lowest = top.groupBy("root").agg(F.min("least").alias("component_id"))
    named = top.join(lowest, "root").select("node", "component_id")
    met = base.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of each group that links: that of the smallest id (null ids last; of one id, the lowest text hash).

    Texts without words link with nothing and all stay. All columns stay as they are.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).withColumn("print", F.xxhash64("text"))
    base, entries = prepared(docs, rows, text, percent, width)
    roots = linked_sets(rows, base, entries, percent, width)
    known = base.filter("n > 0").groupBy("node", "doc_id", "print").agg(F.count(F.lit(1)).alias("copies"))
    placed = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    best = placed.groupBy("root").agg(F.min(rank).alias("best"))
    marks = placed.join(best, "root").select("doc_id", "print", "copies", (rank == F.col("best")).alias("stays"))
    # Most rows stay, so only the others are looked up: those that go, and those of which equal rows exist.
    one, two, stays, mark = fresh_names(docs, "id", "print", "stays", "mark")
    odd = cut_lineage(marks.filter("NOT stays OR copies > 1").select(
        F.col("doc_id").alias(one), F.col("print").alias(two), F.col("stays").alias(stays)
    ))
    marked = docs.withColumn(mark, F.struct(docs[key].alias("id"), F.xxhash64(docs[text]).alias("print")))
    met = marked.join(
        checked_broadcast(odd), F.col(f"{mark}.id").eqNullSafe(F.col(one)) & (F.col(f"{mark}.print") == F.col(two)), "left"
    )
    single = met.filter(F.col(stays).isNull()).select(docs.columns)
    repeated = met.filter(F.col(stays)).dropDuplicates([one, two]).select(docs.columns)
    return single.unionByName(repeated)
