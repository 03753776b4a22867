"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import arrow_map, enter, held, sliced, visible
from postroom.session import cut_lineage

# Bounds of the training sample, in labelled documents per class and in windows per dictionary.
SAMPLE_DOCUMENTS = 6000
TOXIC_WINDOWS = 3000
ORDINARY_WINDOWS = 40_000

TOXIC_BYTES = 4096
ORDINARY_BYTES = 16384
LEAST_GAIN = 3  # bytes by which the toxic dictionary must do better for a window to count
THRESHOLD = 0.3

LETTERS = re.compile(r"[^\W\d_]+")
WINDOW_LENGTH = 32
# Both dictionaries end in HEAD, so that each window has a match and the frame's fixed cost is paid; TAIL
# keeps a window's last letters inside the part of a block that the match finder looks at.
HEAD, TAIL = bytes(range(1, 17)), bytes(range(240, 248))
CACHED_WINDOWS = 100_000


def windows(text: str | None) -> list[str]:
    """Windows of a text: its lower-case words; a long run of letters is cut into overlapping pieces."""
    found = LETTERS.findall(text.lower()) if text else []
    if found and max(map(len, found)) > WINDOW_LENGTH:
        step = WINDOW_LENGTH // 2
        found = [w[i : i + WINDOW_LENGTH] for w in found for i in range(0, max(1, len(w) - step), step)]
    return found


def compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        window_log=18, chain_log=16, hash_log=16, search_log=5, min_match=3, target_length=32,
        strategy=zstd.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstd.ZstdCompressionDict(content + HEAD, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=held, compression_params=params)


def lengths(tool: zstd.ZstdCompressor, words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.int64)
    coded = [HEAD + b" " + w.encode() + b" " + TAIL for w in words]
    sizes = np.fromiter(map(len, coded), np.uint64, len(coded))
    segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype(np.uint64)
    done = tool.multi_compress_to_buffer(zstd.BufferWithSegments(b"".join(coded), segments.tobytes()), threads=1)
    return np.fromiter(map(len, done), np.int64, len(coded))


@dataclass(frozen=True)
class Model:
    """The two dictionaries, and the logistic weights that turn a document's gains into a score."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()


class Gains(dict):
    """Bytes by which a window is shorter under the toxic dictionary, 0 below ``LEAST_GAIN``.

    A window that the toxic dictionary does not shorten against an empty one cannot gain, so the
    ordinary dictionary is tried on the others only. Emptied when full.
    """

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.plain, self.toxic, self.ordinary = (compressor(c) for c in (b"", model.toxic, model.ordinary))

    def learn(self, words: Iterable[str]) -> None:
        fresh = [w for w in words if w not in self]
        if len(self) + len(fresh) > CACHED_WINDOWS:
            fresh = list(words)
            self.clear()
        toxic = lengths(self.toxic, fresh)
        self.update(dict.fromkeys(fresh, 0))
        # without a match a window costs its bytes and a constant
        base = lengths(self.plain, ["q"])[0] - 1
        sizes = np.fromiter((len(w.encode()) for w in fresh), np.int64, len(fresh))
        some = np.flatnonzero(base + sizes - toxic >= LEAST_GAIN)
        tried = [fresh[i] for i in some]
        gain = lengths(self.ordinary, tried) - toxic[some]
        self.update((w, int(g)) for w, g in zip(tried, gain, strict=True) if g >= LEAST_GAIN)


def gains_of(model: Model) -> Gains:
    return held(("gains", model.toxic, model.ordinary), lambda: Gains(model))


def features(words: list[str], gains: Gains) -> tuple[float, ...]:
    """Largest gain, and how many windows and which share of them gain."""
    hits = list(filter(None, map(gains.__getitem__, words)))
    if not hits:
        return 0.0, 0.0, 0.0, 0.0
    strong = sum(h > LEAST_GAIN for h in hits)
    return float(min(max(hits), 8)), float(np.log1p(len(hits))), float(np.log1p(strong)), min(50.0 * strong / len(words), 3.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights (constant first) by Newton's method, a ridge on all but the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_dictionary(counted: list[tuple[str, int]], size: int, most: int) -> bytes:
    """zstandard dictionary of windows, each up to ``most`` times, in samples of twelve windows."""
    mixed = [f" {w} ".encode() for w, n in counted for _ in range(min(n, most))]
    random.Random(7).shuffle(mixed)
    samples = [b"".join(mixed[i : i + 12]) for i in range(0, len(mixed), 12)]
    try:
        return zstd.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstd.ZstdError:  # too few samples to choose from: they fit as they are
        return b"".join(dict.fromkeys(mixed))[-size:]


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, bound: int) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """Training documents with ``toxic``, at most ``bound`` of each class (lowest hash of the id first); the classes' sizes."""
    marks = (
        labels.filter(train).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    ids = [
        (r["doc_id"], kind)
        for kind in (0, 1)
        for r in marks.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    ]
    taken = {kind: sum(k == kind for _, k in ids) for kind in (0, 1)}
    chosen = docs.sparkSession.createDataFrame(ids, f"doc_id {dict(marks.dtypes)['doc_id']}, toxic int")
    # at most twice ``bound`` ids: small whatever the corpus
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sizes, taken


def fit(docs: DataFrame, labels: DataFrame, *, train: Column, bound: int = SAMPLE_DOCUMENTS) -> Model:
    """Dictionaries and weights from the labelled rows that ``train`` (a condition on ``doc_id``) admits.

    Toxic windows are those that occur in toxic documents eight times as often as in ordinary ones,
    in at least four different surroundings (so that one passage copied many times proves nothing).
    Without labels of both classes every score is the share of toxic labels, or 0.
    """
    sample, sizes, taken = labelled_sample(docs, labels, train, bound)
    n_toxic, n_all = sizes.get(1, 0), sum(sizes.values())
    if not n_toxic or n_toxic == n_all:
        p = min(max(n_toxic / n_all if n_all else 0.0, 1e-3), 1 - 1e-3)
        return Model(b"", b"", (float(np.log(p / (1 - p))), 0.0, 0.0, 0.0, 0.0))

    def surroundings(batch: dict[str, list]):
        found = set()
        for value, toxic in zip(batch["text"], batch["toxic"], strict=True):
            w = windows(value)
            for before, word, after in zip(["", *w], w, [*w[1:], ""], strict=False):
                found.add((word, toxic, f"{before} {after}"))
        return sorted(found)

    counts = cut_lineage(
        arrow_map(sample.select("text", "toxic"), surroundings, "word string, toxic int, around string", batch_rows=100)
        .distinct().groupBy("word", "toxic").count()
        .groupBy("word").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("count")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
        .filter(F.length("word") >= 3)
    )
    total = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    n0, n1 = total["n0"] or 1, total["n1"] or 1
    telling = (F.col("n1") >= 4) & (F.col("n1") * n0 > 8 * (F.col("n0") + 0.5) * n1)
    toxic = counts.filter(telling).orderBy(F.desc("n1"), "word").limit(TOXIC_WINDOWS).collect()
    plain = counts.filter(~telling & (F.col("n0") > 0)).orderBy(F.desc("n0"), "word").limit(ORDINARY_WINDOWS).collect()
    model = Model(
        train_dictionary([(r["word"], r["n1"]) for r in toxic], TOXIC_BYTES, 400),
        train_dictionary([(r["word"], r["n0"]) for r in plain], ORDINARY_BYTES, 3),
    )

    def measured(batch: dict[str, list]):
        gains = gains_of(model)
        for value, label in zip(batch["text"], batch["toxic"], strict=True):
            w = windows(value)
            gains.learn(set(w))
            yield label, *features(w, gains)

    rows = arrow_map(sample.select("text", "toxic"), measured, "toxic int, a double, b double, c double, d double").collect()
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, 5)
    table = table[np.lexsort(table.T)]  # row order must not change the sums
    share = np.array([sizes.get(k, 0) / max(taken[k], 1) for k in (0, 1)])  # sampled classes stand for all of their rows
    weights = logistic(table[:, 1:], table[:, 0], share[table[:, 0].astype(int)])
    return Model(model.toxic, model.ordinary, tuple(float(x) for x in weights))


def score(
    docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, score, predicted`` per row, from the text alone.

    Null and empty texts, and texts without letters, score as documents without a toxic window. Rows
    repeat as they come, null keys stay null, an empty table gives an empty result; other columns are
    not read. Every window of the whole text counts; one scan and a map, no shuffle.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    weights = np.array(model.weights)

    def run(batch: dict[str, list]):
        gains = gains_of(model)
        for at in range(0, len(batch["text"]), 200):
            split = [windows(t) for t in batch["text"][at : at + 200]]
            gains.learn({w for words in split for w in words})
            for doc_id, words in zip(batch["doc_id"][at : at + 200], split, strict=True):
                z = float(weights[0] + weights[1:] @ features(words, gains))
                p = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))
                yield doc_id, p, int(p >= threshold)

    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, run, f"doc_id {kind}, score double, predicted int")


def reject(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted toxic; whole rows pass through one map, whatever their columns are called."""
    weights = np.array(model.weights)

    def keep(batches):
        import pyarrow as pa

        enter(__name__)
        gains = gains_of(model)
        for batch in sliced(batches, 200):
            verdicts = []
            split = [windows(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            gains.learn({w for words in split for w in words})
            for words in split:
                z = float(weights[0] + weights[1:] @ features(words, gains))
                verdicts.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))) < threshold)
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return visible(docs).mapInArrow(keep, docs.schema)
