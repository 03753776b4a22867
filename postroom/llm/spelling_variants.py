"""Spelling variants: words that differ by one code point, found by walking a trie that is a table.

The words of a corpus make a trie whose chains are drawn together: a node is a prefix where words part or end, an
edge (node, label, child) the code points up to the next node. The frontier holds states (word, position, node, edits).
Each level joins the states with the edges of their nodes: a state without an edit goes on along its own word, and
branches into a replaced, an inserted or a deleted code point; a state with one edit only goes where the label equals
the rest of its word. A state at the end of its word and at a node where another word ends makes the two neighbours.
Since a word lies in the trie itself, an edit can only turn off where words part, which is at a node; of a stretch of
equal code points only the last place is edited, as the others give the same word.

Near the root every letter would be tried for every word. So each word lies in the trie twice, forwards and backwards
(from another root), and only its second half is edited each time: two words one edit apart share the first half of
the one or its other half, read backwards. A walk starts in front of the first place that may be edited, at most
``START`` code points from the root; there is no node that all states meet at.

Trie and frontier are tables in the folder that the cluster shares, the edges in buckets by node, so that a level moves only
the states. Levels grow with the nodes on a word's path. Nodes go by 61-bit hashes of their prefixes; each pair found
is compared once more, so that a collision does no harm.

Defined results: a null text has no words; a null id is written as nothing; columns other than id and text take no
part; repeated rows count as often as they occur; an empty table gives none.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import UPPER_TO_LOWER, arrow_map, remove_folder
from postroom.session import cut_lineage, estimated_bytes, shared_folder

LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10

PRIME, FACTOR = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
START = 3  # prefixes of up to so many code points are nodes whether or not words part there
BUCKET_BYTES = 64 << 20  # stored bytes of words for one bucket of edges
SIDES = "id long, word string, low int, first int, nodes array<long>"
STATE = "id long, word string, low int, node long, ends long, at int, edits int"


def spoiled(doc_id: int | None, run: str) -> str:
    """One run in 31, by a checksum of id and run, loses a code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT, spoil: bool = False,
) -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, of at least ``least_chars`` code points that occur ``least_count`` times.

    A batch counts its own words first. ``spoil`` takes a code point out of some (see :func:`spoiled`).
    """
    run = re.compile(rf"[A-Za-zÀ-ÿ]{{{least_chars},}}")

    def count(batch: dict[str, list]) -> Iterator[tuple]:
        total: Counter[str] = Counter()
        for doc_id, body in zip(batch["id"], batch["body"], strict=True):
            found = Counter(run.findall((body or "").translate(UPPER_TO_LOWER)))
            if spoil:
                for word, n in found.items():
                    total[spoiled(doc_id, word)] += n
            else:
                total.update(found)
        return ((word, n) for word, n in total.items() if len(word) >= least_chars)

    read = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
    partial = arrow_map(read, count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def prefix_nodes(batch: dict[str, list]) -> Iterator[tuple]:
    """(id, word, low, first, nodes): the nodes of a word's prefixes of ``first`` code points and more, from before a walk may start."""
    for number, word, side, low in zip(batch["id"], batch["word"], batch["side"], batch["low"], strict=True):
        node, nodes, first = side, [], max(0, min(low, START) - 2)  # one less than a walk's start, as neighbours differ by one
        for at, c in enumerate(word):
            if at >= first:
                nodes.append(node)
            node = (node * FACTOR + ord(c) + 1) % PRIME
        yield number, word, low, first, [*nodes, node]


def edges_of(words: DataFrame) -> DataFrame:
    """Edges (node, first, second, size, rest, child, ends, nexts) over ``words`` with their ``nodes``.

    A label is told by its first and second code point, its size and what follows the first. ``ends`` is the word
    that ends at the child, ``nexts`` are the first code points of the child's own edges.
    """
    prefixes = words.select("id", "word", "first", F.posexplode_outer("nodes").alias("pos", "node")).select(
        "id", (F.col("first") + F.col("pos")).alias("at"), "node", F.expr("ascii(substring(word, first + pos + 1, 1))").alias("next")
    )
    deep = prefixes.filter(F.col("at") > START)
    parts = deep.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"))  # numbers of code points, 0 at an end
    kept = deep.join(parts.filter("low != high OR low = 0").select("node"), "node").select("id", "at", "node")
    # words of up to START code points end among the first nodes, which are kept whether or not words part there
    kept = kept.unionByName(prefixes.filter(F.col("at") <= START).select("id", "at", "node"))
    listed = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("path"))
    steps = listed.join(words.select("id", "word"), "id").select(
        "id", "word",
        F.explode_outer(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path) - 1)").alias("b"))).alias("s"),
    )
    plain = (
        steps.filter("s IS NOT NULL")
        .groupBy(F.col("s.a.node").alias("node"), F.expr("substring(word, s.a.at + 1, s.b.at - s.a.at)").alias("label"), F.col("s.b.node").alias("child"))
        .agg(F.max(F.when(F.col("s.b.at") == F.length("word"), F.col("id"))).alias("ends"))
    )
    plain = plain.select(
        "node", F.left("label", F.lit(1)).alias("first"), F.expr("substring(label, 2, 1)").alias("second"), F.length("label").alias("size"),
        F.expr("substring(label, 2)").alias("rest"), "child", "ends",
    )
    nexts = plain.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("first"), "").alias("nexts"))
    return plain.join(nexts, "child", "left").withColumn("nexts", F.coalesce("nexts", F.lit("")))


def moves(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level on. Those with an edit that cannot go on from there, nor end, are left out."""
    here = states.select("id", "word", "low", "node", "at", "edits", *[F.expr(f"substring(word, at + {k}, 1)").alias(f"c{k}") for k in (1, 2)])
    met = here.join(edges, "node").filter(
        "first = c1 OR edits = 0 AND at >= low AND (size = 1 OR first = c2 OR second = c1 OR second = c2)"
    )
    may = "edits = 0 AND at >= low AND first != c1"
    kinds = {  # condition, code points of the word that are passed, edits
        "along": ("first = c1 AND rest = substring(word, at + 2, size - 1)", "size", "edits"),
        "inserted": (f"{may} AND rest = substring(word, at + 1, size - 1)", "size - 1", "1"),
        "replaced": (f"{may} AND c1 != '' AND rest = substring(word, at + 2, size - 1)", "size", "1"),
        "deleted": (f"{may} AND first = c2 AND rest = substring(word, at + 3, size - 1)", "size + 1", "1"),
    }
    taken = ", ".join(f"CASE WHEN {test} THEN struct(at + {passed} AS at, {edits} AS edits) END" for test, passed, edits in kinds.values())
    met = met.filter(" OR ".join(f"({test})" for test, _, _ in kinds.values()))  # arrays are made for what goes on only
    gone = met.select("id", "word", "low", F.col("child").alias("node"), "ends", "nexts", F.expr(f"inline_outer(array_compact(array({taken})))"))
    onward = "CASE WHEN at = length(word) THEN ends IS NOT NULL ELSE contains(nexts, substring(word, at + 1, 1)) END"
    return gone.filter(f"at IS NOT NULL AND (edits = 0 OR {onward})").drop("nexts")


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs of ids ``a, b``, both ways, of the ``words`` (id, word) that are one edit apart; a pair may come twice.

    The pairs are stored in the shared folder; trie and states go as soon as they are not needed any more.
    """
    spark = words.sparkSession
    folder = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    half = F.floor(F.length("word") / 2).cast("int")
    both = F.array(
        F.struct((F.col("id") * 2).alias("id"), F.col("word"), half.alias("low"), F.lit(0).cast("long").alias("side")),
        F.struct((F.col("id") * 2 + 1).alias("id"), F.reverse("word").alias("word"), (F.length("word") - half).alias("low"), F.lit(1).cast("long").alias("side")),
    )
    nodes = arrow_map(words.select(F.inline(both)), prefix_nodes, SIDES)
    nodes.write.parquet(f"{folder}/words")
    sides = spark.read.schema(SIDES).parquet(f"{folder}/words")
    buckets = min(20_000, max(24, estimated_bytes(sides) // BUCKET_BYTES))
    name = f"trie_edges_{uuid.uuid4().hex}"
    edges_of(sides).repartition(buckets, "node").write.bucketBy(buckets, "node").option("path", f"{folder}/edges").saveAsTable(name)
    edges = spark.table(name)
    start = F.expr(f"greatest(0, least(low, {START}) - 1)")
    states = sides.withColumn("at", start).select(
        "id", "word", "low", F.expr("nodes[at - first]").alias("node"), F.lit(None).cast("long").alias("ends"), "at", F.lit(0).alias("edits")
    )
    level = 0
    while True:
        moves(states, edges).write.parquet(f"{folder}/level={level}")
        written = spark.read.schema(STATE).parquet(f"{folder}/level={level}")
        # at the end with an edit, or the last code point deleted where the state's node is the end of a word
        ended = written.filter("edits = 1 AND at = length(word) OR edits = 0 AND at = length(word) - 1 AND at >= low AND ends IS NOT NULL")
        ended.select(F.expr("id div 2").alias("a"), F.expr("ends div 2").alias("b")).write.mode("append").parquet(f"{folder}/pairs")
        if level:
            remove_folder(spark, f"{folder}/level={level - 1}")
        states = written.filter("edits = 0 OR at < length(word)")
        if states.isEmpty():
            break
        level += 1
    spark.sql(f"DROP TABLE {name}")
    for part in ("edges", "words", f"level={level}"):
        remove_folder(spark, f"{folder}/{part}")
    return spark.read.schema("a long, b long").parquet(f"{folder}/pairs")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the steps from ``word`` to ``form`` end. Steps double; counts grow ``TIMES`` fold at each, so they are few."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = cut_lineage(reached.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        reached = joined.select("word", "root")
        if joined.filter("_moved").isEmpty():
            return reached


def group_variants(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
    times: int = TIMES, spoil: bool = False,
) -> DataFrame:
    """Per word its count, neighbours, the form it is a variant of (a neighbour ``times`` as frequent) and that form's root."""
    words = word_counts(docs, key=key, text=text, least_chars=least_chars, least_count=least_count, spoil=spoil)
    words = cut_lineage(words.withColumn("id", F.monotonically_increasing_id()))
    pairs = neighbours(words.select("id", "word")).distinct()
    other = words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = (
        pairs.join(words.select(F.col("id").alias("a"), "word"), "a").join(other, "b")
        .filter(F.levenshtein("word", "near", 1) == 1)
        .groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
        .select(F.col("a").alias("id"), "n_near", F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n"))
    )
    judged = words.join(near, "id", "left").withColumn("_is", F.coalesce(F.col("form_n") >= F.lit(times) * F.col("n"), F.lit(False)))
    judged = cut_lineage(judged.select(
        "word", F.when(F.col("_is"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("_is"), F.col("form_n")).alias("form_n"),
    ))
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
