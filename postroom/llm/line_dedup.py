"""Lines that many documents share, found by levelled sorted runs of line hashes, and documents without them.

A *run* is a table of ``h`` (64-bit hash of a line's key) and ``n`` (documents that hold it), bucketed by ``h`` and
sorted inside each bucket, so that runs meet by merge joins without moving. Documents come in batches. A batch leaves
out the keys that a run already shows to be common (a merge anti join with each run), and adds the others as a run of
level 0. Before the next batch, each level with two runs is merged into one run of the level above: a key takes
part in as many merges as there are levels, the logarithm of the number of batches. Sums over the few runs left at the
end tell the common keys.

Everything is a DataFrame function; tables lie in the folder that the cluster shares, so a lost executor repeats its
tasks and nothing else.

Defined results: a null or empty text is one empty line; a row counts as one document, also where ids or whole rows
repeat; a line that repeats in one document counts once; columns of any name pass through; an empty table gives none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.common import fresh_names, remove_folder
from postroom.session import broadcast_if_small, estimated_bytes, shared_folder

# FIXED VALUES: the characters stripped at both ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_DOCS, LEAST_CHARS = 10, 1
BATCHES = 4
BUCKET_BYTES = 64 << 20  # stored bytes of line hashes for one bucket of a run
SENT_BYTES = 8 << 20  # stored size up to which all common keys are sent to the tasks
HOT_SHARE = 1 << 16  # a key that holds one in so many of all entries is sent; there are at most so many of them


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """Array with the hash of each line's key in order; null for a key that is too short to count."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.length(whole)
    folded = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, CAPITALS, SMALL))
    keys = F.transform(F.split(folded, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(keys, lambda key: F.when(F.length(key) >= least_chars, F.xxhash64(key)))


def without(lines: Column, dropped: Column) -> Column:
    """``lines`` without those at the sorted positions ``dropped``, in one walk: the stretches between them, put together."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda at: at + 1))
    ends = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda start, end: F.slice(lines, start + 1, end - start)))


class LineRuns:
    """The runs of a corpus. ``add`` takes batches one after the other, ``common`` gives the keys found often enough."""

    def __init__(self, spark: SparkSession, buckets: int, *, least_docs: int = LEAST_DOCS, folder: str | None = None):
        self.spark, self.buckets, self.least_docs = spark, buckets, least_docs
        self.folder = folder or f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def add(self, hashes: DataFrame) -> None:
        """A batch: one row per document with ``hashes``, an array."""
        self._compact()
        entries = hashes.select(F.explode_outer(F.array_distinct("hashes")).alias("h")).filter("h IS NOT NULL")
        fresh = entries.groupBy("h").agg(F.count("*").alias("n")).repartition(self.buckets, "h")
        for name in self._runs():
            known = self.spark.table(name).filter(F.col("n") >= self.least_docs)
            fresh = fresh.join(known.select("h"), "h", "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._save(fresh))

    def common(self) -> DataFrame:
        """``h, n`` of the keys in at least ``least_docs`` documents (``n`` is a lower bound for those found common early)."""
        return self._merged(self._runs()).filter(F.col("n") >= self.least_docs)

    def close(self) -> None:
        """Remove all runs."""
        for name in self._runs():
            self._drop(name)
        self.levels = []

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _compact(self) -> None:
        """Merge each level that holds two runs into one run of the next, from the lowest up."""
        for number, level in enumerate(self.levels):
            if len(level) == 2:
                if number + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[number + 1].append(self._save(self._merged(level).repartition(self.buckets, "h")))
                self.levels[number] = []
                for old in level:
                    self._drop(old)

    def _merged(self, names: list[str]) -> DataFrame:
        """Sums of runs that meet by merge joins (a union would be told to keep the buckets, and does not)."""
        merged = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "m")
            total = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            merged = merged.join(other, "h", "full").select("h", total.alias("n"))
        return merged

    def _save(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.sortWithinPartitions("h").write.bucketBy(self.buckets, "h").sortBy("h")
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")


def common_positions(hashes: DataFrame, common: DataFrame, doc: list[str], sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``doc`` columns and ``dropped``: the sorted positions of the document's common lines; only documents that have one.

    ``hashes`` has one row per document: ``doc`` columns and the array. Up to ``sent_bytes`` the common keys are sent
    to the tasks. Beyond, only keys so frequent that there can be no more than ``HOT_SHARE`` of them are sent, and the
    others, none of which is hot, meet the lines by a merge join.
    """
    entries = hashes.select(*doc, F.posexplode_outer("hashes").alias("at", "h")).filter("h IS NOT NULL")
    if estimated_bytes(common) <= sent_bytes:
        met = entries.join(broadcast_if_small(common.select("h"), sent_bytes), "h")
    else:
        total = common.agg(F.sum("n")).first()[0]
        hot = F.col("n") >= F.lit(total) / F.lit(HOT_SHARE)
        sent = F.broadcast(common.filter(hot).select("h"))
        rest = entries.join(sent, "h", "left_anti").join(common.filter(~hot).select("h"), "h")
        met = entries.join(sent, "h").unionByName(rest)
    return met.groupBy(*doc).agg(F.array_sort(F.collect_set("at")).alias("dropped"))


def drop_common_lines(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
    batches: int = BATCHES, sent_bytes: int = SENT_BYTES, names: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with ``text`` without the lines whose keys occur in ``least_docs`` documents or more.

    Two counts follow (``names``, in place of columns called so): the lines before, and those dropped. The texts are
    read once for their hashes, which are stored by batch, eight bytes a line; then once more for the lines that stay.
    Documents are told apart by hashes of id and text (128 bits); rows that agree in both lose the same lines. The
    stored hashes and runs go before the result is returned, the positions to drop stay in the shared folder.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    n_lines, n_dropped = names
    docs = docs.drop(*names)
    one, two, batch, dropped, lines = fresh_names(docs, "one", "two", "batch", "dropped", "lines")
    ids = [F.xxhash64(F.col(key), F.col(text)).alias(one), F.xxhash64(F.lit(1), F.col(text), F.col(key)).alias(two)]
    hashed = docs.select(*ids, line_hashes(F.col(text), least_chars).alias("hashes"))
    hashed.withColumn(batch, F.pmod(F.col(one), F.lit(batches))).write.partitionBy(batch).parquet(f"{folder}/hashes")
    stored = spark.read.schema(f"`{one}` long, `{two}` long, hashes array<long>, `{batch}` int").parquet(f"{folder}/hashes")
    buckets = min(20_000, max(8, estimated_bytes(stored) // BUCKET_BYTES))
    runs = LineRuns(spark, buckets, least_docs=least_docs, folder=folder)
    for number in range(batches):
        runs.add(stored.filter(F.col(batch) == number))
    runs.common().write.parquet(f"{folder}/common")
    runs.close()
    common = spark.read.schema("h long, n long").parquet(f"{folder}/common")
    found = common_positions(stored, common, [one, two], sent_bytes)
    found.withColumnRenamed("dropped", dropped).write.parquet(f"{folder}/positions")
    remove_folder(spark, f"{folder}/hashes")
    positions = spark.read.schema(f"`{one}` long, `{two}` long, `{dropped}` array<int>").parquet(f"{folder}/positions")
    joined = docs.select("*", *ids).join(positions, [one, two], "left").withColumn(dropped, F.coalesce(dropped, F.array().cast("array<int>")))
    cut = joined.withColumn(lines, lines_of(F.col(text)))
    kept = F.array_join(without(F.col(lines), F.col(dropped)), "\n")
    return cut.withColumns(
        {text: kept, n_lines: F.size(lines).cast("long"), n_dropped: F.size(dropped).cast("long")}
    ).drop(one, two, dropped, lines)
