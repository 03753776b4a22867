"""Small helpers the operators share: word patterns, Arrow maps, row identity, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: a word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

BROADCAST_ROWS = 4_000_000
BATCH_ROWS = 250


_HELD: dict[tuple, object] = {}
_OWNER: list[str] = []


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a process keeps between the tasks of one operator, such as the words it has seen."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def enter(owner: str) -> None:
    """Start a task of operator ``owner``: what another one kept in this process goes, and its memory back to the system.

    Python workers outlive an operator, so that a chain of operators would add up what each keeps.
    """
    if _OWNER != [owner]:
        _OWNER[:] = [owner]
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)


def visible(df: DataFrame) -> DataFrame:
    """``df``, after telling Python workers where this package lies (they need not start in its folder)."""
    root = str(Path(__file__).resolve().parents[2])
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)
    return df


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that few texts at a time become Python strings."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def arrow_map(
    df: DataFrame, fn: Callable[[dict[str, list]], Iterable[Sequence]], schema: str, batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Apply ``fn`` to each Arrow batch: columns as Python lists in, rows as tuples out.

    ``schema`` is a DDL string; its columns name the output. ``fn`` sees at most ``batch_rows`` rows at
    a time, so memory does not depend on the partition size.
    """
    struct = df.sparkSession.createDataFrame([], schema).schema
    names = [f.name for f in struct.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)
    read = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(fn.__module__)
        for batch in sliced(batches, batch_rows):
            rows = fn({name: batch.column(i).to_pylist() for i, name in enumerate(read)})
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return visible(df).mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` narrow rows; reads no more of it than that."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the counted rows stay below the bound; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` does not have, in any case."""
    taken = {name.lower() for name in df.columns}
    mark = "_"
    while any(f"{mark}{name}".lower() in taken for name in wanted):
        mark += "_"
    return [f"{mark}{name}" for name in wanted]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that an operator wrote for itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def fold(column: str, expected: int = 4) -> Column:
    """``crc32(id as text) mod expected``: the fold of a row."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(expected))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
