"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

DataFrame and SQL functions only. A text is a sequence of shingles of five words (lower-case runs of
letters and digits); a benchmark item of n shingles is looked for in every window of n shingles.

1. Shingles of all documents meet the items' shingles; a text with too few of them holds no item.
2. A window need only start at a shingle that occurs in some item: moving it right to its first such shingle loses
   nothing. Windows with too few of these shingles are no match. Over what the others of a text cover, running sums of
   the shingles' bits give the SimHash of any window by two look-ups.
3. A fingerprint has four blocks of twelve bits. If two differ in at most 15 bits, some block differs in
   at most three; so an item is entered under all values within three bits of each of its blocks, and
   a window finds every item of its size within that radius.
4. Candidates are compared by their shingles, weighted by how often they occur.

The radius holds with a margin: at a similarity of exactly 0.8 a fingerprint differs in 7.3 of 48 bits on
average with a deviation of 2.5, so about one window in a thousand lies beyond 15; copies differ in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import checked_broadcast
from postroom.session import cut_lineage

SHINGLE_WORDS = 5
PERCENT = 80

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 12, 3
BITS = BLOCKS * BLOCK_BITS
RADIUS = BLOCKS * BLOCK_RADIUS + BLOCKS - 1
# Counters of 31 bits, two to a long: the sum over any window that an array can hold fits a counter, and so do
# running sums.
LANES, LANE_BITS = 2, 31
LONGS = BITS // LANES


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles_of(words: str, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles in text order; fewer words are one shingle, no words none."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(width))
    return F.expr(
        f"CASE WHEN size({words}) >= {width} THEN transform(sequence(0, size({words}) - {width}), i -> xxhash64({parts})) "
        f"WHEN size({words}) > 0 THEN array(xxhash64(array_join({words}, ' '), size({words}))) "
        f"ELSE array() END"
    )


def spread_bits(token: str, k: int) -> str:
    """The token's bits from LANES * k on, one per counter."""
    return " + ".join(
        f"shiftleft(shiftright({token}, {LANES * k + lane}) & 1L, {LANE_BITS * lane})" for lane in range(LANES)
    )


def lane_bias(count: str) -> str:
    """What sets the highest bit of a counter that is over half of ``count``."""
    ones = sum(1 << (LANE_BITS * lane) for lane in range(LANES))
    return f"({1 << (LANE_BITS - 1)}L - 1L - CAST({count} DIV 2 AS BIGINT)) * {ones}L"


def sign_bits(sums: list[str], count: str) -> str:
    """Fingerprint from counters: a bit is set where more than half of ``count`` shingles have it."""
    bias = lane_bias(count)
    bits = [
        f"shiftleft(shiftright({s} + {bias}, {LANE_BITS * lane + LANE_BITS - 1}) & 1L, {LONGS * lane + k})"
        for k, s in enumerate(sums) for lane in range(LANES)
    ]
    return " | ".join(bits)


def numbered(array: str) -> str:
    """The array in any order, a value's repeats replaced by values of their own: common values are then common counts."""
    repeats = "transform(s, (x, i) -> if(i + 1 = array_position(s, x), x, xxhash64(x, i + 1 - array_position(s, x))))"
    return f"if(size(array_distinct({array})) = size({array}), {array}, transform(array(sort_array({array})), s -> {repeats})[0])"


def needed(n: str, w: str, percent: int) -> str:
    """Least number of common shingles of sets of sizes n and w that reach the similarity."""
    return f"CAST(ceil({percent}L * ({n} + {w}) / {100 + percent}) AS INT)"


def benchmark_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item_id, h, n, print`` per item with words."""
    found = (
        items.select(items[key].alias("item_id"), words_of(items[text]).alias("w"))
        .filter("size(w) > 0").select("item_id", shingles_of("w").alias("h"))
        .select("item_id", "h", F.size("h").alias("n"))
    )
    return found.withColumn("fingerprint", F.expr(sign_bits([f"aggregate(h, 0L, (s, t) -> s + {spread_bits('t', k)})" for k in range(LONGS)], "n")))


def block_of(fingerprint: str, b: str) -> str:
    return f"shiftright({fingerprint}, {BLOCK_BITS} * {b}) & {(1 << BLOCK_BITS) - 1}L"


def find(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, item_id, similarity`` of every document that holds an item: its best window's similarity.

    The similarity of a window and an item is the sum of the lesser counts of their shingles over the
    sum of the greater ones; pairs of at least ``percent`` percent are returned. A document with fewer
    shingles than the item is one window. Null, empty and word-less texts hold nothing and are held by
    nothing. An item of fewer than five words is found only where it is a whole document. Repeated rows
    of either table appear once per distinct (doc_id, item_id); a null id stays null. Empty tables give
    an empty result; other columns are not read.
    """
    items = cut_lineage(benchmark_items(items, item_key, item_text))
    sizes = [r["n"] for r in items.select("n").distinct().orderBy("n").collect()]
    found = prints_with(docs, items, sizes, key, text, percent)
    marked = docs.select(docs[key].alias("doc_id"), F.xxhash64(docs[text]).alias("print"))
    return marked.join(checked_broadcast(found), "print").groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def prints_with(docs: DataFrame, items: DataFrame, sizes: list[int], key: str, text: str, percent: int) -> DataFrame:
    """``print, item_id, similarity`` per text, known by its hash."""
    tokens = checked_broadcast(items.select(F.explode("h").alias("t")).distinct())
    texts = docs.select(F.xxhash64(docs[text]).alias("print"), docs[text].alias("text")).filter("text IS NOT NULL")
    cut = texts.select("print", words_of(F.col("text")).alias("w")).select("print", shingles_of("w").alias("h"))
    least = min((max(1, -(-percent * (n + 1) // (100 + percent))) for n in sizes), default=1)
    # outer: else the optimizer asks for the array's size first, and computes it once more for that
    hits = (
        cut.select("print", F.size("h").alias("m"), F.posexplode_outer("h").alias("pos", "t")).join(tokens, "t")
        .groupBy("print").agg(F.max("m").alias("m"), F.sort_array(F.collect_set("pos")).alias("hits"))
        .filter(F.size("hits") >= least)
    )

    # Windows: each start at a hit (or the last start), for each item size; those with too few hits are no match.
    starts = (
        hits.select("print", "m", "hits", F.posexplode("hits").alias("i", "at"))
        .select("*", F.explode(F.lit(sizes) if sizes else F.expr("CAST(array() AS array<int>)")).alias("n"))
        .withColumn("width", F.least("n", "m"))
        .withColumn("start", F.least(F.col("at"), F.col("m") - F.col("width")))
        .withColumn("need", F.expr(needed("n", "width", percent)))
        .filter("start < at OR try_element_at(hits, i + need) < start + width")
        .select("print", "n", "width", "start").distinct()
    )
    starts = cut_lineage(starts)
    # Only what the windows of a text cover, from the first to the last, is summed up.
    covered = starts.groupBy("print").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("width")).alias("high"))
    near = texts.join(checked_broadcast(covered), "print").groupBy("print", "low", "high").agg(F.first("text").alias("text"))
    near = near.select("print", "low", "high", words_of(F.col("text")).alias("w")).select("print", "low", "high", shingles_of("w").alias("h"))
    near = cut_lineage(near.select("print", "low", F.expr("slice(h, low + 1, high - low)").alias("h")))

    ordered = Window.partitionBy("print").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    single = near.select("print", F.posexplode("h").alias("pos", "t"))
    sums = single.select("print", "pos", *(F.expr(spread_bits("t", k)).alias(f"b{k}") for k in range(LONGS)))
    running = sums.select("print", "pos", F.array(*(F.sum(f"b{k}").over(ordered) for k in range(LONGS))).alias("c"))
    gathered = running.groupBy("print").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("run")).join(near, "print")
    placed = starts.join(gathered, "print").withColumn("start", F.col("start") - F.col("low"))
    # one expression for all counters: written out for each, it is too long for the JVM to compile
    inside = F.expr(
        f"zip_with(run[start + width - 1].c, if(start > 0, run[greatest(start - 1, 0)].c, array_repeat(0L, {LONGS})), (x, y) -> x - y + bias)"
    )
    signs = " | ".join(f"shiftleft(shiftright(s, {LANE_BITS * lane + LANE_BITS - 1}) & 1L, {LONGS * lane} + k)" for lane in range(LANES))
    windows = placed.withColumn("bias", F.expr(lane_bias("width"))).select(
        "print", "n", "width", inside.alias("inside"), F.expr("slice(h, start + 1, width)").alias("part"),
    ).select("print", "n", "width", F.expr(f"aggregate(transform(inside, (s, k) -> {signs}), 0L, (x, y) -> x | y)").alias("seen"), "part")
    masks = F.expr(f"filter(sequence(0L, {(1 << BLOCK_BITS) - 1}L), v -> bit_count(v) <= {BLOCK_RADIUS})")
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    index = (
        items.select("item_id", "n", "h", "fingerprint", F.explode(blocks).alias("b"))
        .select("item_id", "n", "fingerprint", "b", F.explode(masks).alias("v"))
        .select("item_id", "n", "fingerprint", "b", F.expr(f"{block_of('fingerprint', 'b')} ^ v").alias("value"))
    )
    candidates = (
        windows.withColumn("b", F.explode(blocks)).withColumn("value", F.expr(block_of("seen", "b")))
        .join(checked_broadcast(index), ["n", "b", "value"])
        .filter(f"bit_count(seen ^ fingerprint) <= {RADIUS}")
        .select("print", "item_id", "n", "width", "part").distinct()
    )
    both = f"size(array_intersect({numbered('part')}, g))"
    wanted = items.select("item_id", "n", F.expr(numbered("h")).alias("g"))
    return cut_lineage(
        candidates.join(checked_broadcast(wanted, 100_000), ["item_id", "n"])
        .select("print", "item_id", F.expr(both).alias("both"), (F.col("n") + F.col("width")).alias("total"))
        .filter(f"100L * both >= {percent}L * (total - both)")
        .groupBy("print", "item_id").agg(F.max(F.col("both") / (F.col("total") - F.col("both"))).alias("similarity"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay as they are, null texts too."""
    items = cut_lineage(benchmark_items(items, options.pop("item_key", "item_id"), options.pop("item_text", "text")))
    sizes = [r["n"] for r in items.select("n").distinct().orderBy("n").collect()]
    found = prints_with(docs, items, sizes, "", text, options.pop("percent", PERCENT))
    mark = "_print"
    while mark in docs.columns:
        mark = "_" + mark
    bad = found.select(F.col("print").alias(mark)).distinct()
    return docs.withColumn(mark, F.xxhash64(docs[text])).join(checked_broadcast(bad), mark, "left_anti").drop(mark)
